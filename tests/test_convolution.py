"""Trees of convolutions and conditional draws against enumeration."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersum.operators import convolution, counts

PMFS = {"a": [0.5, 0.3, 0.2], "b": [0.1, 0.0, 0.9], "c": [0.7, 0.3], "d": [0.25, 0.25, 0.25, 0.25], "e": [1.0], "f": [0.2, 0.8]}
GROUPS = {"a": "g", "b": "g", "c": "g", "d": "h", "e": "h", "f": "h"}


def enumerated(items):
    """(values of the items, probability) of all outcomes."""
    for ks in itertools.product(*(range(len(PMFS[i])) for i in items)):
        yield ks, math.prod(PMFS[i][k] for i, k in zip(items, ks))


@pytest.fixture(params=[2, 256])
def fan(request, monkeypatch):
    monkeypatch.setattr(convolution, "FAN", request.param)
    return request.param


@pytest.fixture
def tables(spark):
    pmfs = spark.createDataFrame(list(PMFS.items()), "item string, pmf array<double>")
    return pmfs, spark.createDataFrame(list(GROUPS.items()), "item string, group string")


def test_exact_sums(spark, fan, tables):
    pmfs, groups = tables
    edges = groups.withColumnRenamed("group", "upper_id").unionByName(pmfs.select(F.lit("T").alias("upper_id"), "item"))
    got = {r.id: r.pmf for r in counts.exact_sums(pmfs, edges.select("upper_id", "item")).collect()}
    for group, items in (("g", "abc"), ("h", "def"), ("T", "abcdef")):
        want = np.zeros(20)
        for ks, p in enumerated(items):
            want[sum(ks)] += p
        np.testing.assert_allclose(got[group], np.trim_zeros(want, "b"), atol=1e-15)
    assert counts.exact_sums(pmfs.limit(0), edges.select("upper_id", "item").limit(0)).count() == 0


def test_splits_follow_the_conditional_law(spark, fan, tables):
    """20,000 draws given a total of 4, and totals out of reach."""
    pmfs, groups = tables
    totals = np.array([4] * 20_000 + [-1, 6, 0])
    rows = convolution.split_groups(pmfs, groups, {"g": totals, "h": np.zeros(len(totals), int)}, 3).toPandas()
    g = rows[rows["group"] == "g"].pivot(index="sample", columns="item", values="k").to_numpy()
    assert (g[:20_000].sum(axis=1) == 4).all() and (g[20_000:20_002] == -1).all() and (g[20_002] == 0).all()
    want = {ks: p for ks, p in enumerated("abc") if sum(ks) == 4}
    for ks, p in want.items():
        assert abs((g[:20_000] == ks).all(axis=1).mean() - p / sum(want.values())) < 0.015
    h = rows[rows["group"] == "h"].pivot(index="sample", columns="item", values="k").to_numpy()
    assert (h == [0, 0, -1]).all(axis=1).sum() == 0 and (h.sum(axis=1) == 0).all()


def test_long_arrays_are_folded_like_short_ones():
    rng = np.random.default_rng(1)
    a, b = rng.random(3_000), rng.random(2_500)
    np.testing.assert_allclose(convolution.fold(a / a.sum(), b / b.sum()), np.convolve(a / a.sum(), b / b.sum()), atol=1e-14)
    assert len(convolution.fold(np.ones(4) / 4, np.ones(4) / 4, 2)) == 3


def test_a_large_group_is_many_tasks(spark):
    pmfs = spark.range(5_000).select(F.format_string("i%05d", "id").alias("item"), F.expr("array(0.7, 0.2, 0.1)").alias("pmf"))
    groups = pmfs.select("item", F.lit("one").alias("group"))
    layers = convolution._tree(pmfs, groups, None)
    assert len(layers) == 3 and layers[0].select("parent").distinct().count() == 20
    pmf = np.array(layers[-1].first().pmf)
    assert np.arange(len(pmf)) @ pmf == pytest.approx(2_000) and pmf.sum() == pytest.approx(1)
    got = convolution.split_groups(pmfs, groups, {"one": np.array([1_900, 2_000, 2_050])})
    assert sorted(r.n for r in got.groupBy("sample").agg(F.sum("k").alias("n")).collect()) == [1_900, 2_000, 2_050]


def law(mean, cov):
    """Enumerated law of the items, and the moments of each aggregate."""
    q = np.linalg.inv(cov)
    out = {}
    for ks, p in enumerated("abcdef"):
        u = np.array([sum(ks[:3]), sum(ks[3:]), sum(ks)]) - mean
        out[ks] = p * math.exp(-0.5 * u @ q @ u)
    total = sum(out.values())
    return {ks: p / total for ks, p in out.items()}


def test_levels_follow_the_law_and_keep_their_weight(spark, tables):
    pmfs, groups = tables
    edges = groups.withColumnRenamed("group", "upper_id").unionByName(pmfs.select(F.lit("T").alias("upper_id"), "item")).select("upper_id", "item")
    rng = np.random.default_rng(5)
    e = rng.normal(size=(400, 3)) @ np.array([[0.8, 0.1, 0.3], [0, 0.6, 0.3], [0, 0, 0.7]])
    ids, mean = ["g", "h", "T"], [1.5, 2.5, 4.4]
    residuals = spark.createDataFrame([(u, t, float(e[t, k])) for t in range(400) for k, u in enumerate(ids)], "id string, t int, e double")
    upper = spark.createDataFrame(list(zip(ids, mean)), "id string, mu double")
    got, ess = counts.mix_cond_by_level(pmfs, groups, edges, upper, residuals, 20_000)
    order, w = counts.upper_covariance(residuals)
    at = [order.index(u) for u in ids]
    want = law(np.array(mean), w[np.ix_(at, at)])
    sums = {"g": lambda ks: sum(ks[:3]), "h": lambda ks: sum(ks[3:]), "T": sum} | {i: (lambda ks, k=k: ks[k]) for k, i in enumerate("abcdef")}
    own = {r.id: np.array(r.pmf) for r in got.collect()}
    for u, f in sums.items():
        exact = np.zeros(20)
        for ks, p in want.items():
            exact[f(ks)] += p
        assert np.abs(np.pad(own[u], (0, 20 - len(own[u]))) - exact).max() < 0.015, u
    rows = {r.id: r.ess for r in ess.collect()}
    assert set(rows) == set(ids) and min(rows.values()) > 10_000
    with pytest.raises(ValueError, match="lowest groups"):
        counts.mix_cond_by_level(pmfs, groups.union(groups.limit(1)), edges, upper, residuals, 10)


def test_sums_reach_as_far_as_their_items(spark):
    """The largest sum has a probability of 1e-1200, below any number; an item's own zeros at the end don't count."""
    pmfs = spark.range(400).select(F.format_string("i%03d", "id").alias("item"), F.expr("array(0.5, 0.499, 0.001, 0.0)").alias("pmf"))
    sums = counts.exact_sums(pmfs, pmfs.select(F.lit("T").alias("upper_id"), "item"))
    assert len(sums.first().pmf) == 2 * 400 + 1
    got = counts.moments(sums, "id").first()
    assert got.mean == pytest.approx(400 * 0.501, abs=1e-8) and got.var == pytest.approx(400 * (0.503 - 0.501**2), abs=1e-8)


def test_variance_of_large_counts(spark):
    far = spark.createDataFrame([("x", [0.0] * 300_000 + [0.25, 0.5, 0.25])], "id string, pmf array<double>")
    got = counts.moments(far, "id").first()
    assert got.mean == 300_001 and got.var == pytest.approx(0.5, abs=1e-9)


def test_trees_and_splits_of_small_files_are_many_tasks_work(spark):
    """Twenty groups of three items in one partition: their sums, and what is drawn given their totals, come from several tasks; histograms of arrays equal those of rows."""
    pmfs = spark.range(60).select(F.format_string("i%02d", "id").alias("item"), F.expr("array(0.6D, 0.3D, 0.1D)").alias("pmf")).coalesce(1)
    groups = pmfs.select("item", F.concat(F.lit("g"), (F.substring("item", 2, 9).cast("int") % 20).cast("string")).alias("group"))
    top = convolution._tree(pmfs, groups, None)[-1]
    assert top.count() == 20 and top.select(F.input_file_name()).distinct().count() > 1
    totals = {f"g{k}": np.array([0, 1, 2, 3, 4, 6, 3, 2]) for k in range(20)}
    lists = convolution.split_lists(pmfs, groups, totals, 5)
    assert lists.select(F.input_file_name()).distinct().count() > 1
    rows = convolution.split_groups(pmfs, groups, totals, 5)
    want = {r.id: r.pmf for r in counts.histogram(rows.select(F.col("item").alias("id"), "k")).collect()}
    assert len(want) == 60 and {r.id: r.pmf for r in counts.list_histograms(lists).collect()} == want
    edges = groups.withColumnRenamed("group", "upper_id").unionByName(pmfs.select(F.lit("T").alias("upper_id"), "item")).select("upper_id", "item")
    sums = {(r.id, r["sample"]): r.k for r in counts.sums_of_lists(lists, edges).collect()}
    assert sums == {(u, s): 20 * int(t) if u == "T" else int(t) for u in ("T", *totals) for s, t in enumerate(totals["g0"])}


def test_draws_out_of_reach_are_left_out_of_all_items(spark, tables):
    """A total close to its reach: some draws are lost, what remains adds up, and arrays lose the same places."""
    pmfs, groups = tables
    edges = groups.select(F.lit("T").alias("upper_id"), "item")
    one = groups.select("item", F.lit("g").alias("group"))
    upper = spark.createDataFrame([("T", 7.0)], "id string, mu double")
    residuals = spark.createDataFrame([("T", t, 2.0 if t % 2 else -2.0) for t in range(100)], "id string, t int, e double")
    got, lost = counts.td_cond(pmfs, one, upper, residuals, edges, 400)
    n = lost.first().lost
    assert 0 < n < 400
    mean = {r.id: float(np.arange(len(r.pmf)) @ np.array(r.pmf)) for r in got.collect()}
    assert mean["T"] == pytest.approx(sum(mean[i] for i in PMFS))
    for r in got.collect():  # shares of the draws that remain
        np.testing.assert_allclose(np.array(r.pmf) * (400 - n), np.rint(np.array(r.pmf) * (400 - n)), atol=1e-9)
    lists = spark.createDataFrame([("a", [5, -1, 7, 8], [1]), ("b", [5, 6], []), ("c", [-1], [0])], "item string, ks array<long>, gone array<int>")
    assert [list(r.ks) for r in lists.select(counts._without(F.col("ks"), F.col("gone")).alias("ks")).collect()] == [[5, 7, 8], [5, 6], []]
