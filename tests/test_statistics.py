"""Tail probabilities, covariances, reconciliation and counts against formulas and enumeration."""

import math
from datetime import datetime, timedelta
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersum.operators import backtest, counts, factors, hierarchy, inference, reconcile, resample, tails

NOW = datetime(2024, 1, 1)
RESIDUALS = "origin timestamp, unique_id string, ds timestamp, e double"


def test_tails_against_known_values(spark):
    one = spark.range(1)
    got = one.select(tails.normal_tail(F.lit(1.959963985)).alias("z"), tails.normal_cdf(F.lit(-1.0)).alias("c"), tails.student_tail(F.lit(2.570582), F.lit(5.0)).alias("t"), tails.student_tail(F.lit(12.7062047), F.lit(1.0)).alias("t1"), tails.chi_square_tail(F.lit(21.02607), F.lit(12)).alias("q"), tails.student_width(F.lit(5.0)).alias("w")).first()
    assert got.z == pytest.approx(0.05, abs=1e-7) and got.c == pytest.approx(0.158655254, abs=1e-7)
    assert (got.t, got.t1, got.q, got.w) == pytest.approx((0.05, 0.05, 0.05, 2.570582), abs=1e-6)
    for n, w in ((6, 0.0), (6, 4.0), (9, 11.0)):  # all sign patterns
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
        low = min(w, n * (n + 1) / 2 - w)
        want = min(1, 2 * np.mean([s <= low for s in sums]))
        assert one.select(tails.wilcoxon_tail(F.lit(w), F.lit(n), F.lit(0.0)).alias("p")).first().p == pytest.approx(want)


def test_small_samples_have_no_rank_test(spark):
    rows = spark.createDataFrame([("four", float(k)) for k in (1, 2, 3, 4)] + [("six", float(k)) for k in (-1, 2, 3, 4, 5, 6)], "name string, d double")
    got = {r.name: r for r in inference.paired_test(rows, ["name"]).collect()}
    assert got["four"].p_wilcoxon is None and got["six"].p_wilcoxon == pytest.approx(2 * 2 / 64)
    assert got["six"].low < got["six"].mean < got["six"].high


def test_naive_test_rejects_too_often_for_dependent_errors(spark):
    rng = np.random.default_rng(0)
    rows = []
    for s in range(60):
        x = np.zeros(500)
        for t in range(1, 500):
            x[t] = 0.9 * x[t - 1] + rng.normal()
        rows += [(s, t, float(v)) for t, v in enumerate(x)]
    got = inference.hac_mean(spark.createDataFrame(rows, "s int, ds int, e double"), ["s"]).collect()
    naive = np.mean([abs(r["mean"] / r.naive_se) > 1.96 for r in got])
    assert naive > 0.4 and np.mean([r.p < 0.05 for r in got]) < 0.25
    with pytest.raises(Exception, match="not finite"):
        inference.hac_mean(spark.createDataFrame([(1, 1, float("nan"))], "s int, ds int, e double"), ["s"]).collect()


def table(spark, e, origin=NOW):
    return spark.createDataFrame([(origin, f"s{i:03d}", NOW + timedelta(days=t), float(e[t, i])) for t in range(len(e)) for i in range(e.shape[1])], RESIDUALS)


def test_blocks_of_series_give_the_whole_covariance(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "BLOCK", 3)
    rng = np.random.default_rng(5)
    e = rng.normal(size=(30, 11)) + rng.normal(size=(30, 1)) + 2
    got = {(r.i, r.j): r for r in reconcile.pair_moments(table(spark, e)).collect()}
    assert len(got) == 66
    plan, sample = e.T @ e / 30, np.cov(e.T)
    for (i, j), r in got.items():
        a, b = int(i[1:]), int(j[1:])
        assert a <= b and r.plan == pytest.approx(plan[a, b]) and r["sample"] == pytest.approx(sample[a, b])
    whole = factors.shrinkage(table(spark, e)).first().intensity
    steps = {r.t: r.intensity for r in factors.expanding_shrinkage(table(spark, e)).collect()}
    assert steps[30] == pytest.approx(whole) and steps[12] == pytest.approx(factors.shrinkage(table(spark, e[:12])).first().intensity)
    corr = {(r.i, r.j): r.r for r in inference.correlations(table(spark, e).drop("origin")).collect()}
    assert corr["s000", "s001"] == pytest.approx(np.corrcoef(e[:, 0], e[:, 1])[0, 1]) and len(corr) == 55


def tree(spark):
    rows = [(r, n, NOW, 1.0) for r, n in [("x", "a"), ("x", "b"), ("x", "c"), ("y", "a"), ("z", "a"), ("z", "b")]]
    leaves = spark.createDataFrame(rows, "region string, nation string, ds timestamp, y double")
    nodes, edges = hierarchy.nodes(leaves, ["region", "nation"]), hierarchy.edges(leaves, ["region", "nation"])
    ids = [r.unique_id for r in nodes.orderBy("level", "unique_id").collect()]
    leaf = [i for i in ids if i.count("/") == 2]
    return nodes, edges, ids, np.array([[float(b == a or b.startswith(a + "/")) for b in leaf] for a in ids])


def test_projection_bias_and_variance_of_a_tree(spark):
    nodes, edges, ids, s = tree(spark)
    v = np.random.default_rng(1).uniform(1, 9, len(ids))
    w1 = np.diag(1 / v)
    p = s @ np.linalg.solve(s.T @ w1 @ s, s.T @ w1)
    variance = spark.createDataFrame(list(zip(ids, map(float, v))), "unique_id string, v double")
    got = {(r.out_id, r.in_id): r.p for r in reconcile.projection(nodes, variance, 2).collect()}
    np.testing.assert_allclose([[got[a, b] for b in ids] for a in ids], p, atol=1e-10)
    assert all(r.error < 1e-10 for r in reconcile.projection_errors(reconcile.projection(nodes, variance, 2), edges).collect())
    var = {r.unique_id: r.v for r in reconcile.reconciled_variance(nodes, variance, 2).collect()}
    np.testing.assert_allclose([var[i] for i in ids], np.diag(p @ np.diag(v) @ p.T), rtol=1e-10)


def test_large_hierarchies_are_refused_a_full_covariance(spark, monkeypatch):
    nodes, edges, *_ = tree(spark)
    monkeypatch.setattr(reconcile, "MAX_SERIES", 5)
    with pytest.raises(ValueError, match="series"):
        reconcile.structure(edges)
    with pytest.raises(ValueError, match="series"):
        reconcile.projection(nodes, None, 2)


def test_singular_covariance_and_method_choice(spark):
    rng = np.random.default_rng(3)
    few, wide = rng.normal(size=(10, 4)), rng.normal(size=(30, 50))
    flat = rng.normal(size=(60, 4))
    flat[:, 2] = 0
    choose = lambda e, **k: tuple(reconcile.choose_method(table(spark, e), 20, **k).first()[1:])
    assert choose(few) == ("wls_struct", "few residuals") and choose(wide)[0] == "mint_shrink"
    assert choose(wide, more_series=True) == ("wls_struct", "more series than residuals") and choose(flat) == ("wls_struct", "a series without variance")
    bad = spark.createDataFrame([(NOW, 1e12)], "origin timestamp, cond_w double")
    assert choose(rng.normal(size=(40, 4)), condition=bad) == ("wls_struct", "ill-conditioned") == choose(rng.normal(size=(40, 4)), condition=bad.limit(0))
    w = np.ones((3, 3))
    c = np.array([[1.0, -1, -1]])
    assert np.isfinite(reconcile._gain(w * 0, c)).all()


def past_frame(spark, poison=None, n=6, h=2):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(n):
        o = datetime(2020, 1 + 2 * k, 1)
        for u in "abc":
            for t in range(h):
                e = rng.normal() + (1e6 if k == poison else 0)
                rows.append((o, u, datetime(2020, o.month + t, 1), float(e)))
    return spark.createDataFrame(rows, RESIDUALS)


def test_past_errors_come_from_finished_origins_only(spark):
    errors = past_frame(spark)
    origins = errors.select("origin").distinct()
    take = lambda e, w=None: {(r.origin.month, r.unique_id): r.v for r in backtest.past_error_variances(e, origins, 2, 3, w).collect()}
    got = take(errors)
    assert {o for o, _ in got} == {7, 9, 11}  # three finished ones at least
    assert take(past_frame(spark, poison=5)) == got and take(past_frame(spark, poison=3))[7, "a"] == got[7, "a"]  # the future changes nothing
    own = {}
    for r in errors.collect():
        own.setdefault(r.unique_id, []).append((r.origin.month, r.e))
    for (o, u), v in got.items():
        assert v == pytest.approx(np.var([e for m, e in own[u] if m + 2 <= o], ddof=1))
    last = take(errors, 1)
    assert last[11, "b"] == pytest.approx(np.var([e for m, e in own["b"] if m == 9], ddof=1))
    poisoned = take(past_frame(spark, poison=2), 1)
    assert poisoned[11, "c"] == pytest.approx(last[11, "c"], rel=1e-3) and poisoned[7, "c"] != last[7, "c"]
    full = backtest.past_errors(errors, origins, 2, 3, 1)
    assert {(r.origin.month, r.n) for r in full.groupBy("origin").agg(F.count("*").alias("n")).collect()} == {(7, 6), (9, 6), (11, 6)}


def test_bands_end_on_the_gain_and_identical_methods_are_skipped(spark):
    rows = [(datetime(2020, 1 + k, 1), 0, m, v) for k in range(4) for m, v in (("bu", 1.0 + k), ("a", 0.5 + k), ("same", 1.0 + k))]
    levels = spark.createDataFrame(rows, "origin timestamp, level int, method string, mase double")
    got = {r.k: r for r in resample.gain_bands(levels, "a", "bu", 50).collect()}
    assert (got[4].low, got[4].middle, got[4].high) == pytest.approx((0.2, 0.2, 0.2)) and got[1].low < got[1].high and got[4].apart
    ref = levels.filter("method = 'bu'").select("origin", F.col("mase").alias("ref"))
    diff = levels.filter("method <> 'bu'").join(ref, "origin").withColumn("d", F.col("mase") - F.col("ref"))
    (r,) = inference.against_reference(diff, ["method"]).collect()
    assert r.method == "a" and r.gain == pytest.approx(0.2) and r.better == 1 and r.p_wilcoxon is None


def poisson(mean, top=40):
    p = np.array([math.exp(-mean) * mean**k / math.factorial(k) for k in range(top + 1)])
    return (p / p.sum()).tolist()


@pytest.fixture(scope="module")
def pair(spark):
    pmfs = spark.createDataFrame([("a", poisson(0.4, 9)), ("b", poisson(0.8, 9))], "item string, pmf array<double>")
    edges = spark.createDataFrame([("T", "a"), ("T", "b")], "upper_id string, item string")
    upper = spark.createDataFrame([("T", 0.6)], "id string, mu double")
    residuals = spark.createDataFrame([("T", t, 0.5 if t % 2 else -0.5) for t in range(200)], "id string, t int, e double")
    return pmfs, edges, upper, residuals


def test_importance_sampling_against_enumeration(spark, pair):
    pmfs, edges, upper, residuals = pair
    got, ess = counts.mix_cond(pmfs, edges, upper, residuals, 20_000)
    a, b = np.array(poisson(0.4, 9)), np.array(poisson(0.8, 9))
    total = np.add.outer(np.arange(10), np.arange(10))
    joint = np.outer(a, b) * np.exp(-0.5 * (total - 0.6) ** 2 / 0.25)
    joint /= joint.sum()
    own = {r.id: np.array(r.pmf) for r in got.collect()}
    want = {"a": joint.sum(axis=1), "b": joint.sum(axis=0), "T": np.bincount(total.ravel(), weights=joint.ravel())}
    for u, p in want.items():
        assert np.abs(own[u] - p[: len(own[u])]).max() < 0.01
    assert 1 < ess.first().ess < 20_000


def test_splits_add_up_and_follow_the_conditional_law(spark, pair):
    pmfs = [np.array(poisson(0.4, 9)), np.array(poisson(0.8, 9))]
    out = counts.split_totals(pmfs, np.array([2] * 20_000 + [-1, 99]), np.random.default_rng(0))
    assert (out[:, :-2].sum(axis=0) == 2).all() and (out[:, -2:] == -1).all()
    want = np.array([pmfs[0][k] * pmfs[1][2 - k] for k in range(3)])
    assert np.abs(np.bincount(out[0, :-2], minlength=3) / 20_000 - want / want.sum()).max() < 0.01
    table, edges, upper, residuals = pair
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "item string, group string")
    got, lost = counts.td_cond(table, groups, upper, residuals, edges, 500)
    assert {r.id for r in got.collect()} == {"T", "a", "b"} and sum(r.lost for r in lost.collect()) < 250
    with pytest.raises(ValueError, match="lowest groups"):
        counts.td_cond(table, groups.union(groups.limit(1)), upper, residuals, edges, 10)


def test_gaussian_counts_equal_the_matrix_formula(spark):
    rng = np.random.default_rng(2)
    edges = [("T", i) for i in "abcd"] + [("G1", "a"), ("G1", "b"), ("G2", "c"), ("G2", "d")]
    items = [(i, float(m), float(v)) for i, m, v in zip("abcd", (0.3, 0.6, 1.5, 0.2), (0.5, 0.9, 2.0, 0.3))]
    upper = [("G1", 1.4), ("G2", 1.5), ("T", 2.4)]
    e = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3))
    residuals = spark.createDataFrame([(u, t, float(e[t, k])) for t in range(300) for k, (u, _) in enumerate(upper)], "id string, t int, e double")
    got = {r.id: r for r in counts.gaussian(spark.createDataFrame(upper, "id string, mu double"), residuals, spark.createDataFrame(items, "item string, mu double, var double"), spark.createDataFrame(edges, "upper_id string, item string")).collect()}
    lam = factors.shrinkage(residuals.select(F.lit(0).alias("origin"), F.col("id").alias("unique_id"), F.col("t").alias("ds"), "e")).first().intensity
    w1 = e.T @ e / 300
    sigma = (1 - lam) * w1 + lam * np.diag(np.diag(w1))
    a = np.array([[float((u, i) in edges) for i in "abcd"] for u, _ in upper])
    w = np.block([[sigma, np.zeros((3, 4))], [np.zeros((4, 3)), np.diag([v + 1e-9 for _, _, v in items])]])
    s = np.vstack((a, np.eye(4)))
    w1i = np.linalg.inv(w)
    p = s @ np.linalg.solve(s.T @ w1i @ s, s.T @ w1i)
    mu, var = p @ np.array([m for _, m in upper] + [m for _, m, _ in items]), np.diag(p @ w @ p.T)
    ids = [u for u, _ in upper] + list("abcd")
    np.testing.assert_allclose([got[i].mu for i in ids], mu, atol=1e-8)
    np.testing.assert_allclose([got[i].sd ** 2 for i in ids], var, atol=1e-7)


def test_negatives_and_normal_scores(spark):
    d = spark.createDataFrame([("m", i, k, mu, sd) for i, (k, mu, sd) in enumerate([("normal", -0.2, 1.0), ("normal", 0.5, 1.0), ("normal", 3.0, 1.0), ("pmf", 0.0, 0.0)])], "method string, id int, kind string, mu double, sd double")
    (r,) = counts.negatives(d).collect()
    assert (r.n, r.means, r.bounds) == (4, 1, 2) and r.below_zero > 0
    assert not counts.negative_gate(counts.negatives(d), 0.2).first().passed and counts.negative_gate(counts.negatives(d), 0.25).first().passed
    y = spark.createDataFrame([(i, 1.0) for i in range(3)], "id int, y double")
    got = {r.id: r for r in counts.normal_scores(d.filter("kind = 'normal'").select("id", "mu", "sd"), y, "id").collect()}
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))
    assert got[1].rps == pytest.approx(sum((phi(k + 0.5 - 0.5) - (1 <= k)) ** 2 for k in range(-9, 12)), abs=1e-5)
    assert got[0].mis == pytest.approx(2 * 1.6448536, abs=1e-5) and got[2].median_error == 2
    s = spark.createDataFrame([("base", 1, 0.0), ("x", 1, 0.0), ("base", 2, 1.0), ("x", 2, 3.0)], "method string, id int, s double")
    assert counts.skill_table(s, "base", ["id"], [], ["s"]).first().skill == pytest.approx(-50)
