"""Covariances in factor form against dense matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersum.operators import factors, reconcile


def tree(regions, leaves):
    nodes = [(0, "T", None, regions * leaves)]
    nodes += [(1, f"r{r}", "T", leaves) for r in range(regions)]
    nodes += [(2, f"r{r}/l{k}", f"r{r}", 1) for r in range(regions) for k in range(leaves)]
    edges = [(a, b) for r in range(regions) for k in range(leaves) for b in [f"r{r}/l{k}"] for a in ("T", f"r{r}", b)]
    return nodes, edges


def tables(spark, regions=3, leaves=4, t=20, seed=1, origins=(1, 2), coherent=False):
    rng = np.random.default_rng(seed)
    nodes, edges = tree(regions, leaves)
    ids = [n[1] for n in nodes]
    resid, fore = [], []
    for o in origins:
        common = rng.normal(size=t)
        for u in ids:
            e = rng.normal(size=t) * rng.uniform(0.5, 3) + common
            resid += [(o, u, k, float(v)) for k, v in enumerate(e)]
            fore += [(o, d, u, float(rng.uniform(5, 50))) for d in (1, 2)]
    return (spark.createDataFrame(nodes, "level int, unique_id string, parent string, n_leaves long"), spark.createDataFrame(edges, "unique_id string, leaf_id string"),
            spark.createDataFrame(resid, "origin int, unique_id string, ds int, e double").repartition(3), spark.createDataFrame(fore, "origin int, ds int, unique_id string, y_hat double"))


def matrix(residuals, origin, t=None):
    own = residuals.filter(F.col("origin") == origin).toPandas().pivot(index="ds", columns="unique_id", values="e")
    return own.columns.tolist(), own.to_numpy()[:t]


def shrunk(e, lam):
    w = e.T @ e / len(e)
    return lam * np.diag(np.diag(w)) + (1 - lam) * w


@pytest.mark.parametrize("t", [2, 5, 40])
def test_intensity_without_pairs(spark, t):
    *_, residuals, _ = tables(spark, t=t)
    want = {r.origin: (r.intensity, r.t) for r in reconcile.intensity_of(reconcile.pair_moments(residuals)).collect()}
    got = {r.origin: (r.intensity, r.t) for r in factors.shrinkage(residuals).collect()}
    assert set(got) == set(want) == {1, 2}
    for o in want:
        assert got[o] == (pytest.approx(want[o][0], rel=1e-9), want[o][1])


def test_expanding_intensity(spark):
    *_, residuals, _ = tables(spark, t=12)
    first = lambda t: reconcile.intensity_of(reconcile.pair_moments(residuals.filter(F.col("ds") < t))).collect()
    want = {(r.origin, t): r.intensity for t in range(2, 13) for r in first(t)}
    got = {(r.origin, r.t): r.intensity for r in factors.expanding_shrinkage(residuals).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_degenerate_residuals(spark):
    zero = spark.createDataFrame([(1, u, k, 0.0) for u in "ab" for k in range(4)] + [(2, "a", 0, 1.0), (2, "b", 0, 2.0)], "origin int, unique_id string, ds int, e double")
    assert {r.origin: (r.intensity, r.t) for r in factors.shrinkage(zero).collect()} == {1: (1.0, 4), 2: (1.0, 1)}
    assert factors.shrinkage(zero.limit(0)).count() == 0
    uneven = spark.createDataFrame([(1, "a", 0, 1.0), (1, "a", 1, 1.0), (1, "b", 0, 2.0)], "origin int, unique_id string, ds int, e double")
    with pytest.raises(Exception, match="unequal length"):
        factors.shrinkage(uneven).collect()


@pytest.mark.parametrize("t, lam, base", [(6, None, "plan"), (40, None, "library"), (8, 0.02, "library"), (8, 1.0, "plan")])
def test_reconciliation_equals_dense(spark, t, lam, base):
    nodes, edges, residuals, forecasts = tables(spark, t=t)
    moments = reconcile.pair_moments(residuals)
    intensity = reconcile.intensity_of(moments).select("origin", "intensity" if lam is None else F.lit(lam).alias("intensity"))
    weights = reconcile.shrunk(moments.select("origin", "i", "j", F.col("plan" if base == "plan" else "sample").alias("w")), intensity)
    want = {(r.origin, r.ds, r.unique_id): r.y_hat for r in reconcile.minimum_trace(forecasts, edges, weights, ("ds",)).collect()}
    got = {(r.origin, r.ds, r.unique_id): r.y_hat for r in factors.minimum_trace(forecasts, nodes, residuals, intensity, 2, ("ds",), base).collect()}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 1e-8


def test_more_series_than_a_matrix_would_allow(spark):
    """5,101 series: coherent results, no row by pairs."""
    nodes, edges, residuals, forecasts = tables(spark, 100, 50, t=3, origins=(1,))
    got = factors.minimum_trace(forecasts, nodes, residuals, factors.shrinkage(residuals), 2, ("ds",))
    assert "moments" not in got._jdf.queryExecution().toString()
    sums = reconcile.bottom_up(got, edges, ("origin", "ds")).withColumnRenamed("y_hat", "s")
    gap = got.join(sums, ["origin", "ds", "unique_id"]).agg(F.count("*").alias("n"), F.max(F.abs(F.col("y_hat") - F.col("s"))).alias("gap")).first()
    assert gap.n == 2 * 5_101 and gap.gap < 1e-7


@pytest.mark.parametrize("t", [5, 60])
def test_spectrum(spark, t):
    *_, residuals, _ = tables(spark, t=t)
    for r in factors.weight_diagnostics(residuals).collect():
        _, e = matrix(residuals, r.origin)
        w1 = e.T @ e / t
        values = np.linalg.eigvalsh(shrunk(e, r.intensity))
        assert (r.t, r.m, r.rank_w1) == (t, 16, np.linalg.matrix_rank(w1))
        assert r.largest == pytest.approx(values[-1], rel=1e-6) and r.smallest == pytest.approx(values[0], rel=1e-6)
        assert r.cond_w == pytest.approx(np.linalg.cond(shrunk(e, r.intensity)), rel=1e-5)
        assert r.cond_w1 == (pytest.approx(np.linalg.cond(w1), rel=1e-5) if t > 16 else np.inf)


def test_spectrum_of_growing_windows(spark):
    *_, residuals, _ = tables(spark, t=6, origins=(1,))
    rows = factors.weight_diagnostics(residuals, least=3).collect()
    assert sorted(r.t for r in rows) == [3, 4, 5, 6]
    for r in rows:
        _, e = matrix(residuals, 1, r.t)
        assert r.cond_w == pytest.approx(np.linalg.cond(shrunk(e, r.intensity)), rel=1e-5) and r.rank_w1 == np.linalg.matrix_rank(e.T @ e)


def test_spectrum_with_a_constant_series(spark):
    *_, residuals, _ = tables(spark, t=5, origins=(1,))
    still = residuals.withColumn("e", F.when(F.col("unique_id") == "r0/l0", 0.0).otherwise(F.col("e")))
    row = factors.weight_diagnostics(still).first()
    assert row.cond_w == np.inf and row.m == 16
