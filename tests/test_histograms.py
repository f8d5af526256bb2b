"""Histograms of sparse large counts."""

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersum.jobs import count_queries
from tiersum.operators import counts


def test_histogram_takes_time_in_proportion_to_its_reach(spark):
    """300 draws of up to 6,000: every draw is found at its place, and no element is computed from all others."""
    rng = np.random.default_rng(2)
    k = {u: rng.integers(0, 6_000, 300) for u in ("a", "b")}
    rows = [(u, int(x)) for u, xs in k.items() for x in xs]
    draws = spark.createDataFrame(rows, "id string, k int")
    began = time.monotonic()
    got = {r.id: np.array(r.pmf) for r in counts.histogram(draws).collect()}
    plain = {r.id: np.array(r.pmf) for r in counts.histogram_pmf(draws, "id").collect()}
    assert time.monotonic() - began < 20
    for u, xs in k.items():
        want = np.bincount(xs) / 300
        np.testing.assert_allclose(got[u], want, atol=1e-15)
        np.testing.assert_allclose(plain[u], want, atol=1e-15)


def test_weights_and_refused_values(spark):
    draws = spark.createDataFrame([("a", 0, 1.0), ("a", 3, 2.0), ("a", 3, 1.0), ("b", 0, 5.0)], "id string, k int, w double")
    assert {r.id: r.pmf for r in counts.histogram(draws, F.col("w")).collect()} == {"a": [0.25, 0.0, 0.0, 0.75], "b": [1.0]}
    for bad in (float("nan"), float("inf"), -1.0):
        with pytest.raises(Exception, match="not a distribution"):
            counts.histogram(spark.createDataFrame([("a", 2, bad), ("a", 1, 3.0)], "id string, k int, w double"), F.col("w")).collect()


def test_draws_of_one_file_are_many_tasks_work(spark):
    """Draws of items that are one partition are dealt to several tasks, and each is the value at which the cdf reaches its number."""
    pmfs = spark.range(40).select(F.format_string("i%02d", "id").alias("item"), F.expr("array(0.5D, 0.0D, 0.3D, 0.2D)").alias("pmf")).coalesce(1)
    draws = counts.item_draws(pmfs, 50, 3)
    assert draws.select(F.spark_partition_id()).distinct().count() > 1
    rows = draws.collect()
    assert len({(r.item, r.sample) for r in rows}) == len(rows) == 2_000
    for r in rows:
        u = int(hashlib.md5(f"3|{r.item}|{r['sample']}".encode()).hexdigest()[:8], 16) / 2**32
        assert r.k == (0 if u < 0.5 else 2 if u < 0.8 else 3)
    edges = pmfs.select(F.explode(F.array(F.lit("T"), F.lit("G"))).alias("upper_id"), "item")
    sums = np.zeros(50, int)
    for r in rows:
        sums[r["sample"] - 1] += r.k
    for r in counts.bottom_up(pmfs, edges, 50, 3).collect():
        np.testing.assert_allclose(r.pmf, np.bincount(sums) / 50, atol=1e-15)


def test_scores_take_one_pass_and_equal_the_single_scores(spark):
    d = spark.createDataFrame([("a", [0.0, 0.05, 0.9, 0.05]), ("b", [0.5, 0.3, 0.2]), ("c", [1.0])], "id string, pmf array<double>")
    y = spark.createDataFrame([("a", 5), ("b", 0), ("c", 2)], "id string, y int")
    scores = counts.item_scores(d, y, "id")
    assert scores._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    got = {r.id: r for r in scores.collect()}
    mis = {r.id: r.mis for r in counts.interval_score(d, y, "id").collect()}
    rps = {r.id: r.rps for r in counts.ranked_probability_score(d, y, "id").collect()}
    assert {i: (r.median_error, r.mis, r.rps) for i, r in got.items()} == {i: (e, mis[i], rps[i]) for i, e in (("a", 3.0), ("b", 0.0), ("c", 2.0))}


def test_all_methods_share_one_covariance(spark, monkeypatch):
    calls, own = [], counts.upper_covariance
    monkeypatch.setattr(counts, "upper_covariance", lambda residuals: calls.append(1) or own(residuals))
    dists, _, upper, _ = count_queries._all_methods(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    n = {r.method: r["count"] for r in dists.groupBy("method").count().collect()}
    assert set(n) == set(count_queries.METHODS) and len(set(n.values())) == 1 and upper.count() == 11
