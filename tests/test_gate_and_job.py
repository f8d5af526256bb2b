"""Division by zero, the gate, the registry and the gated job."""

import hashlib
import json
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersum.functions import scratch
from tiersum.jobs import publication
from tiersum.operators import backtest, clean, factors, hierarchy, inference, metrics, reconcile
from tiersum.sources import raw

NOW = datetime(2024, 1, 1)
FORECASTS = "origin timestamp, unique_id string, ds timestamp, horizon int, method string, y_hat double, y double"


def rows(method, values, steps=5, actual=None):
    """values: by series; the total is T, leaves are a, b and c."""
    return [(NOW, u, NOW + timedelta(days=k), k + 1, method, float(v), float((actual or values)[u])) for u, v in values.items() for k in range(steps)]


SOUND = {"T": 60.0, "a": 10.0, "b": 20.0, "c": 30.0}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("T", u, 0) for u in "abc"] + [(u, u, 1) for u in "abc"], "unique_id string, leaf_id string, level int")


def levels_of(spark, methods):
    return spark.createDataFrame([(NOW, lv, m, float(v)) for m, values in methods.items() for lv, v in enumerate(values)], "origin timestamp, level int, method string, mase double")


def failures(spark, edges, forecasts, levels, **options):
    got = metrics.gate(spark.createDataFrame(forecasts, FORECASTS), edges, levels_of(spark, levels), "bu", **options)
    out = {}
    for r in got.collect():
        out.setdefault(r.method, set())
        if not r.passed:
            out[r.method].add(r.check)
    assert got.filter("blocking").count() == 5 * len(out)  # no method lacks a row
    return out


def test_every_rule_can_fail_and_missing_values_do(spark, edges):
    base = rows("bu", SOUND)
    fine = {"bu": (1, 1), "m": (1.01, 0.9)}
    assert failures(spark, edges, base + rows("m", SOUND), fine) == {"bu": set(), "m": set()}
    assert failures(spark, edges, base + rows("m", SOUND | {"T": 60.001}), fine)["m"] == {"coherence"}
    assert failures(spark, edges, base + rows("m", SOUND | {"T": 60.001}), fine, rel_tol=1e-3)["m"] == set()
    assert failures(spark, edges, base + rows("m", {"T": float("nan")}), {"bu": (1, 1)})["m"] == {"complete", "coherence", "finite", "accuracy"}
    assert failures(spark, edges, base + rows("m", {u: v for u, v in SOUND.items() if u != "c"}), fine)["m"] >= {"complete", "coherence"}
    assert failures(spark, edges, base + rows("m", {"T": 18, "a": -2, "b": 10, "c": 10}), fine)["m"] == {"negative"}
    assert failures(spark, edges, base + rows("m", {"T": 18, "a": -2, "b": 10, "c": 10}), fine, negative_share=0.25)["m"] == set()
    assert failures(spark, edges, base + rows("m", SOUND), {"bu": (1, 1), "m": (0.7, 1.05)})["m"] == {"accuracy"}
    assert failures(spark, edges, base + rows("m", SOUND), {"bu": (1, 1), "m": (0.7, 1.05)}, worse_by=0.06)["m"] == set()
    assert failures(spark, edges, rows("m", SOUND), {"m": (1, 1)})["m"] == {"accuracy"}  # no baseline
    assert failures(spark, edges, rows("m", SOUND), {"bu": (1, 1), "m": (1,)})["m"] == {"accuracy"}  # a level is missing
    assert failures(spark, edges, rows("m", SOUND), {"bu": (1, 1), "m": (1, float("nan"))})["m"] == {"accuracy"}


def test_weighted_change_is_told_and_verdict_counts_absent_methods(spark, edges):
    got = metrics.gate(spark.createDataFrame(rows("m", SOUND), FORECASTS), edges, levels_of(spark, {"bu": (1, 2), "m": (0.5, 2.2)}), "bu", worse_by=0.2, weights={0: 1, 1: 3})
    (w,) = got.filter("not blocking").collect()
    assert w.passed and w.value == pytest.approx((-0.5 + 3 * 0.1) / 4)
    methods = spark.createDataFrame([("m",), ("gone",)], "method string")
    assert dict(metrics.verdict(got, methods).collect()) == {"m": True, "gone": False}


def test_assertions_name_what_is_wrong(spark, edges):
    fine = spark.createDataFrame(rows("m", SOUND), FORECASTS)
    assert metrics.assert_coherent(fine, edges) is fine
    for bad in (SOUND | {"a": float("inf")}, SOUND | {"T": 61.0}, {"T": 60.0, "a": 10.0}):
        with pytest.raises(ValueError, match="m at"):
            metrics.assert_coherent(spark.createDataFrame(rows("m", bad), FORECASTS), edges)


def test_every_ratio_is_defined(spark, edges):
    f = spark.createDataFrame(rows("bu", SOUND) + rows("m", SOUND), FORECASTS)  # both perfect
    nodes = edges.groupBy("unique_id").agg(F.min("level").alias("level"))
    zero = spark.createDataFrame([(NOW, u, 0.0 if u == "a" else 2.0) for u in "Tab"], "origin timestamp, unique_id string, scale double")
    per = metrics.mase(f, zero, nodes)
    assert {(r.unique_id, r.mase) for r in per.collect()} == {("T", 0.0), ("a", None), ("b", 0.0), ("c", None)}
    assert {r.unique_id for r in metrics.missing_scales(f, zero).collect()} == {"a", "c"}
    with pytest.raises(ValueError, match="no scale for a"):
        metrics.refuse_missing_scales(f, zero)
    levels = metrics.by_level(per)
    for table in (metrics.relative_change(levels, "bu"), metrics.aggregate_gain(levels, "bu"), metrics.gain_table(levels, ["bu"]), metrics.running_gain(levels, "m", "bu"), metrics.mase_by_horizon(f, zero, nodes), metrics.change_by_series(per, "bu", ["m"])):
        assert table.count()
        table.collect()
    long = metrics.error_metrics(f.withColumn("y", F.when(F.col("unique_id") == "a", 0.0).otherwise(F.col("y"))), zero, nodes)
    assert {r.metric for r in long.collect()} == {"mae", "rmse", "mape", "zero_share", "mase"}
    metrics.gain_by_metric(long, "bu").collect()
    flat = spark.createDataFrame([("u", NOW + timedelta(days=k), 3.0) for k in range(9)] + [("one", NOW, 1.0)], "unique_id string, ds timestamp, e double")
    assert {(r.unique_id, r.t) for r in inference.bias_table(flat, "unique_id").collect()} == {("u", None), ("one", None)}
    assert {(r.t, r.p) for r in inference.hac_mean(flat, ["unique_id"]).collect()} == {(None, None)}
    same = flat.select("unique_id", F.lit(0.0).alias("d"))
    got = {r.unique_id: r for r in inference.paired_test(same, ["unique_id"]).collect()}
    assert got["u"].t is None and got["u"].p_wilcoxon is None and got["u"].nonzero == 0
    assert inference.ljung_box(flat, ["unique_id"], [3]).count() == 0
    single = flat.filter("unique_id = 'one'").withColumn("origin", F.lit(1)).select("origin", "unique_id", "ds", "e")
    two = single.union(single.withColumn("unique_id", F.lit("two")))
    assert [r.intensity for r in factors.shrinkage(two).collect()] == [1.0]


def test_infinite_values_are_violations(spark):
    series = spark.createDataFrame([("a", NOW, float("inf")), ("a", NOW + timedelta(days=1), 1.0), ("b", NOW, None)], "unique_id string, ds timestamp, y double")
    assert dict(clean.completeness(series).collect()) == {"values": 2, "first_dates": 0, "last_dates": 1, "lengths": 1}


def leaves(spark, months=84, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for r, n in (("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")):
        level = 100 + np.cumsum(rng.normal(size=months))
        for t in range(months):
            out.append((r, n, datetime(2015 + t // 12, t % 12 + 1, 1), float(level[t] + 9 * np.sin(t * np.pi / 6))))
    return spark.createDataFrame(out, "region string, nation string, ds timestamp, y double")


def test_job_publishes_once_blocks_and_refuses_a_changed_hierarchy(spark, tmp_path):
    table, path = leaves(spark), str(tmp_path / "out")
    contract = publication.Contract(["region", "nation"], 6, 12, worse_by=10.0)
    (row,) = publication.run_job(table, contract, path, "v1", "r1").collect()
    assert row.published and row.failures == "" and row.checks == 5
    got = spark.read.parquet(f"{path}/forecast_reconciled")
    assert got.count() == 7 * 6 and {r.run_id for r in got.select("run_id").distinct().collect()} == {"r1"} and "forecast_date" in got.columns
    (lineage,) = [json.loads(x) for f in Path(f"{path}/lineage/run_id=r1").glob("*.json") for x in f.read_text().splitlines()]
    assert lineage["lineage"]["s_hash"] == row.s_hash and lineage["lineage"]["method_used"] == row.method and lineage["lineage"]["published"] == "true"
    with pytest.raises(Exception, match="exist"):
        publication.run_job(table, contract, path, "v1", "r1")
    contract.worse_by = -1.0
    (row,) = publication.run_job(table, contract, path, "v1", "r2").collect()
    assert not row.published and row.failures == "accuracy"
    assert {r.run_id for r in spark.read.parquet(f"{path}/forecast_reconciled").select("run_id").distinct().collect()} == {"r1"}
    assert spark.read.json(f"{path}/gate_report/run_id=r2").filter("not passed").count() == 1
    renamed = table.replace("b", "z", "nation")
    with pytest.raises(ValueError, match="changed"):
        publication.run_job(renamed, contract, path, "v1", "r3")
    contract.worse_by = 10.0
    assert publication.run_job(renamed, contract, path, "v2", "r3").first().published
    assert publication.registry(spark, f"{path}/registry").count() == 2


def test_unknown_studies_and_incomplete_splits(spark):
    series = hierarchy.build_hierarchy(leaves(spark), ["region", "nation"])
    studies = {"all": {"every": 1, "history": 36, "ahead": 5}, "two": {"origins": ["2019-01-01", "2020-01-01"]}}
    assert backtest.study_origins(series, studies, "all").count() == 84 - 36 - 5 and backtest.study_origins(series, studies, "two").count() == 2
    with pytest.raises(ValueError, match="unknown study"):
        backtest.study_origins(series, studies, "other")
    split = backtest.rolling_split(series, backtest.study_origins(series, studies, "all").select("origin"), 12, 6)
    assert backtest.split_violations(split, 7, 6).count() == 0
    assert backtest.split_violations(split.filter("unique_id <> 'Total' or ds <> '2021-12-01'"), 7, 6).count() == 1


ZEROS = bytes(4 << 20)


def test_raw_files_and_manifest(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "r1.csv").write_text("﻿code;instant;value\n11;2024-03-31T02:30:00+01:00;5.5\n11;2024-03-31T03:00:00+02:00;\n24;2024-01-01T00:00:00+00:00;1\n")
    got = raw.read_regional(spark, str(tmp_path / "raw"), {"11": "North"}).collect()
    assert {(r.region, r.ds, r.y) for r in got} == {("North", datetime(2024, 3, 31, 1, 30), 5.5), ("North", datetime(2024, 3, 31, 1), None), ("24", datetime(2024, 1, 1), 1.0)}
    manifest = raw.manifest_of(spark, str(tmp_path / "raw")).union(spark.createDataFrame([("r2.csv", "0")], "file string, sha256 string"))
    rows = manifest.collect()
    fixed = spark.createDataFrame(rows, manifest.schema)
    assert [tuple(r) for r in raw.manifest_violations(spark, str(tmp_path / "raw"), fixed).collect()] == [("r2.csv", "missing")]
    (tmp_path / "raw" / "r1.csv").write_text("code;instant;value\n")
    assert {tuple(r) for r in raw.manifest_violations(spark, str(tmp_path / "raw"), fixed).collect()} == {("r1.csv", "changed"), ("r2.csv", "missing")}


def test_scratch_tables_can_be_deleted(spark):
    table = scratch.materialize(spark.range(3).toDF("x"), "gone")
    path = scratch._PATHS[table].removeprefix("file:")
    assert Path(path).exists() and table.count() == 3
    scratch.drop(table)
    assert not Path(path).exists()


def test_files_are_hashed_in_chunks(spark, tmp_path, monkeypatch):
    class Zeros:
        """A stream of three gigabytes that never gives more than is asked for."""

        left, most = 3 << 30, 0

        def read(self, n):
            n = min(n, self.left)
            self.left -= n
            self.most = max(self.most, n)
            return memoryview(ZEROS)[:n]

    zeros = Zeros()
    digest = raw.stream_digest(zeros)
    want = hashlib.sha256()
    for _ in range(768):
        want.update(ZEROS)
    assert digest == want.hexdigest() and zeros.most == raw.CHUNK
    (tmp_path / "in" / "sub folder").mkdir(parents=True)
    data = bytes(range(256)) * 50_000
    (tmp_path / "in" / "sub folder" / "a b%20.bin").write_bytes(data)
    (tmp_path / "in" / "empty").write_bytes(b"")
    got = {r.file: r.sha256 for r in raw.manifest_of(spark, f"{tmp_path}/in").collect()}
    assert got == {"sub folder/a b%20.bin": hashlib.sha256(data).hexdigest(), "empty": hashlib.sha256(b"").hexdigest()}
