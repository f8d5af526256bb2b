"""Holm over ranges and bootstrap quantiles by frequency, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersum.operators import inference, resample


def plain_holm(rows):
    out = {}
    for family in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == family), key=lambda r: (r[2], r[1]))
        top = 0.0
        for k, (_, name, p) in enumerate(own):
            top = max(top, (len(own) - k) * p)
            out[family, name] = min(1.0, top)
    return out


@pytest.mark.parametrize("size", [7, 10_000])
def test_holm_over_ranges(spark, monkeypatch, size):
    monkeypatch.setattr(inference, "RANGE_ROWS", size)
    rng = np.random.default_rng(1)
    rows = [(f, f"s{k}", float(np.round(rng.random() ** 6, 3))) for f, n in (("a", 60), ("b", 5), ("c", 1), (None, 4)) for k in range(n)]
    got = inference.holm(spark.createDataFrame(rows, "family string, name string, p double").repartition(3), ["family"], ["name"])
    want = plain_holm(rows)
    found = {(r.family, r["name"]): r for r in got.collect()}
    assert set(found) == set(want) and all(found[k].adjusted == pytest.approx(want[k]) and found[k].reject == (found[k].adjusted <= 0.05) for k in want)
    assert inference.holm(spark.createDataFrame([], "family string, name string, p double"), ["family"], ["name"]).count() == 0


def test_no_window_holds_a_whole_family(spark, monkeypatch):
    monkeypatch.setattr(inference, "RANGE_ROWS", 500)
    p = spark.range(3_000).select(F.lit("all").alias("family"), F.col("id").alias("name"), (F.rand(1) ** 3).alias("p"))
    got = inference.holm(p, ["family"], ["name"])
    assert got.count() == 3_000
    low = got.agg(F.min_by("adjusted", "p").alias("a"), F.min("p").alias("p")).first()
    assert low.a == pytest.approx(min(1.0, 3_000 * low.p))


def weighted_quantile(values, times, q):
    return float(np.quantile(np.repeat(values, times), q))


@pytest.mark.parametrize("replicates", [11, 500])
def test_bootstrap_quantiles_by_frequency(spark, replicates):
    rng = np.random.default_rng(2)
    edges = [("T", "a"), ("T", "b"), ("a", "a"), ("b", "b")]
    nodes = [(0, "T", None), (1, "a", "T"), (1, "b", "T")]
    resid = [(1, u, t, float(rng.normal())) for u in ("T", "a", "b") for t in range(9)]
    fore = [(1, d, u, float(rng.uniform(5, 9))) for u in ("T", "a", "b") for d in (20, 21)]
    residuals, forecasts = spark.createDataFrame(resid, "origin int, unique_id string, ds int, e double"), spark.createDataFrame(fore, "origin int, ds int, unique_id string, y_hat double")
    counts = {r.past: r.times for r in resample.pick_counts(residuals, replicates, 3).collect()}
    assert sum(counts.values()) == replicates
    past, times = sorted(counts), [counts[t] for t in sorted(counts)]
    e, f = {(u, t): v for _, u, t, v in resid}, {(u, d): v for _, d, u, v in fore}
    got = {(r.unique_id, r.ds): r.q_hat for r in resample.joint_bootstrap_quantiles(forecasts, residuals, spark.createDataFrame(edges, "unique_id string, leaf_id string"), 0.9, replicates, 3).collect()}
    for u, leaves in (("T", "ab"), ("a", "a"), ("b", "b")):
        for d in (20, 21):
            want = weighted_quantile([sum(f[x, d] + e[x, t] for x in leaves) for t in past], times, 0.9)
            assert got[u, d] == pytest.approx(want)
    got = {(r.unique_id, r.ds): r.q_hat for r in resample.projected_bootstrap_quantiles(forecasts, residuals, spark.createDataFrame(nodes, "level int, unique_id string, parent string"), None, 1, 0.9, replicates, 3).collect()}
    s = np.array([[1, 1], [1, 0], [0, 1]])
    p = s @ np.linalg.inv(s.T @ s) @ s.T
    for d in (20, 21):
        samples = np.array([p @ [f[u, d] + e[u, t] for u in ("T", "a", "b")] for t in past])
        for k, u in enumerate(("T", "a", "b")):
            assert got[u, d] == pytest.approx(weighted_quantile(samples[:, k], times, 0.9))
