"""Distributions on counts: probability arrays p[k] on k = 0, 1, 2, ... and their scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize
from tiersum.operators import convolution, reconcile
from tiersum.operators.convolution import local_table, split_totals, spread  # noqa: F401
from tiersum.operators.inference import hashed_uniform
from tiersum.operators.tails import normal_cdf


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in whose lambdas the value is looked up: an expression that stands in a lambda is computed anew for every element."""
    return F.transform(F.array(value), use)[0]


def pmf_of(p: Column) -> Column:
    """The array clipped at 0 and made to add up to 1; raises for values below -1e-12 or not finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (x < -1e-12) | (x == float("inf"))
    shares = lambda v: _once(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(v, lambda x: x / total))
    checked = lambda v: F.when(F.exists(v, bad), F.raise_error(F.lit("not a distribution"))).otherwise(_once(F.transform(v, lambda x: F.greatest(x, F.lit(0.0))), shares))
    return _once(p, checked)


def _dense(per: DataFrame, *keys: str) -> DataFrame:
    """per(*keys, k, c), a row for each k that occurs -> (*keys, pmf): shares of 0..max k. Each row brings the zeros before it, so that the array is only joined together."""
    before = F.lag("k").over(Window.partitionBy(*keys).orderBy("k"))
    gap = (F.col("k") - F.coalesce(before, F.lit(-1)) - 1).cast("int")
    piece = F.concat(F.array_repeat(F.lit(0.0), gap), F.array(F.col("c").cast("double")))
    pieces = F.array_sort(F.collect_list(F.struct("k", "piece")))
    return per.withColumn("piece", piece).groupBy(*keys).agg(pieces.alias("pieces")).select(*keys, pmf_of(F.flatten(F.col("pieces.piece"))).alias("pmf"))


def histogram_pmf(counts: DataFrame, *keys: str) -> DataFrame:
    """counts(*keys, k) -> (*keys, pmf): relative frequencies of 0..max k."""
    return _dense(counts.groupBy(*keys, "k").agg(F.count("*").alias("c")), *keys)


def daily_pmf(counts: DataFrame, days: DataFrame) -> DataFrame:
    """counts(item, grp, day, k), days without counts absent; days(first, last), one row -> (item, grp, pmf, y).

    pmf: relative frequencies of the counts of all days before the last, whose number less the days seen are the zeros; y: the
    last day's count.
    """
    n = F.date_diff("last", "first")
    marked = counts.join(F.broadcast(days))
    per = marked.groupBy("item", "grp").agg(F.collect_list(F.when(F.col("day") < F.col("last"), F.col("k"))).alias("seen"), F.coalesce(F.sum(F.when(F.col("day") == F.col("last"), F.col("k"))), F.lit(0)).alias("y"), F.max(n).alias("n"))
    top = F.coalesce(F.array_max("seen"), F.lit(0).cast("long"))
    values = F.transform(F.sequence(F.lit(0).cast("long"), top), lambda k: F.when(k == 0, F.col("n") - F.size("seen")).otherwise(F.size(F.filter("seen", lambda x: x == k))).cast("double"))
    return per.filter("n > 0").select("item", "grp", pmf_of(values).alias("pmf"), "y")


def exploded(dists: DataFrame, *keys: str) -> DataFrame:
    """(*keys, k, p, cdf)."""
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return dists.select(*keys, F.posexplode("pmf").alias("k", "p")).withColumn("cdf", F.sum("p").over(w))


def moments(dists: DataFrame, *keys: str) -> DataFrame:
    """(*keys, mean, var, dispersion). Counts are taken from the likeliest one, so that the variance isn't the difference of two large numbers."""
    likeliest = (F.array_position("pmf", F.array_max("pmf")) - 1).alias("c")
    k, p, c = F.col("k") - F.col("c"), F.col("p"), F.max("c")
    told = dists.select(*keys, likeliest, "pmf")  # before the explosion, else for every element
    got = told.select(*keys, "c", F.posexplode("pmf").alias("k", "p")).groupBy(*keys).agg((c * F.sum(p) + F.sum(k * p)).alias("mean"), F.sum(k * p).alias("m1"), F.sum(k * k * p).alias("m2"))
    return got.select(*keys, "mean", (F.col("m2") - F.col("m1") ** 2).alias("var")).withColumn("dispersion", F.col("var") / F.nullif("mean", F.lit(0.0)))


def quantile(dists: DataFrame, q: float, *keys: str) -> DataFrame:
    """(*keys, q): the first k with cdf >= q - 1e-12."""
    return exploded(dists, *keys).filter(F.col("cdf") >= q - 1e-12).groupBy(*keys).agg(F.min("k").alias("q"))


def interval_score(dists: DataFrame, actuals: DataFrame, *keys: str, alpha: float = 0.1) -> DataFrame:
    """(*keys, mis) for the central interval of mass 1 - alpha."""
    low = quantile(dists, alpha / 2, *keys).withColumnRenamed("q", "lo")
    high = quantile(dists, 1 - alpha / 2, *keys).withColumnRenamed("q", "hi")
    y = F.col("y")
    mis = F.col("hi") - F.col("lo") + 2 / alpha * F.greatest(F.col("lo") - y, F.lit(0)) + 2 / alpha * F.greatest(y - F.col("hi"), F.lit(0))
    return low.join(high, list(keys)).join(actuals, list(keys)).select(*keys, mis.cast("double").alias("mis"))


def ranked_probability_score(dists: DataFrame, actuals: DataFrame, *keys: str) -> DataFrame:
    """(*keys, rps): sum over k of (cdf(k) - [y <= k])^2, up to the larger of the last k and y."""
    joined = exploded(dists, *keys).join(actuals, list(keys))
    inside = F.sum((F.col("cdf") - (F.col("y") <= F.col("k")).cast("double")) ** 2)
    beyond = F.greatest(F.max("y") - F.max("k") - 1, F.lit(0))  # there the cdf is 1 and y isn't reached
    return joined.groupBy(*keys).agg((inside + beyond).alias("rps"))


def intermittency(dists: DataFrame, actuals: DataFrame, *keys: str) -> DataFrame:
    """(items, mean_p0, share_actual_zero)."""
    return dists.join(actuals, list(keys)).agg(F.count("*").alias("items"), F.avg(F.element_at("pmf", 1)).alias("mean_p0"), F.avg((F.col("y") == 0).cast("double")).alias("share_actual_zero"))


def skill_table(scores: DataFrame, base: str, keys: list[str], by: list[str], columns: list[str]) -> DataFrame:
    """scores(method, *keys, *by, *columns) -> (method, *by, score, skill): mean of 100 (base - s) / ((base + s) / 2), 0 where both are 0, for each of the columns."""
    long = scores.unpivot(["method", *keys, *by], columns, "score", "s")
    ref = long.filter(F.col("method") == base).select(*keys, "score", F.col("s").alias("b"))
    den = (F.col("b") + F.col("s")) / 2
    both = long.filter(F.col("method") != base).join(ref, [*keys, "score"])
    return both.groupBy("method", *by, "score").agg(F.avg(F.when(den == 0, 0.0).otherwise(100 * F.try_divide(F.col("b") - F.col("s"), den))).alias("skill"))


def item_scores(dists: DataFrame, actuals: DataFrame, *keys: str, alpha: float = 0.1) -> DataFrame:
    """(*keys, median_error, mis, rps): absolute error of the median, interval score and ranked probability score, from one pass over the running sums."""
    y, cdf = F.max("y"), F.col("cdf")
    at = lambda q: F.min(F.when(cdf >= q - 1e-12, F.col("k")))
    inside = F.sum((cdf - (F.col("y") <= F.col("k")).cast("double")) ** 2)
    rps = inside + F.greatest(y - F.max("k") - 1, F.lit(0))  # beyond the last k the cdf is 1 and y isn't reached
    got = exploded(dists, *keys).join(actuals, list(keys)).groupBy(*keys).agg(y.alias("y"), at(0.5).alias("q"), at(alpha / 2).alias("lo"), at(1 - alpha / 2).alias("hi"), rps.alias("rps"))
    mis = F.col("hi") - F.col("lo") + 2 / alpha * F.greatest(F.col("lo") - F.col("y"), F.lit(0)) + 2 / alpha * F.greatest(F.col("y") - F.col("hi"), F.lit(0))
    return got.filter("hi is not null").select(*keys, F.abs(F.col("q") - F.col("y")).cast("double").alias("median_error"), mis.cast("double").alias("mis"), "rps")


def normal_scores(dists: DataFrame, actuals: DataFrame, *keys: str, alpha: float = 0.1) -> DataFrame:
    """dists(*keys, mu, sd), normal -> (*keys, median_error, mis, rps), the cdf at integer k being taken at k + 0.5.

    rps runs over the integers within 8 sd of mu, -1 and y included; an sd of 0 is a step at mu.
    """
    z, y = NormalDist().inv_cdf(1 - alpha / 2), F.col("y")
    lo, hi = F.col("mu") - z * F.col("sd"), F.col("mu") + z * F.col("sd")
    mis = hi - lo + 2 / alpha * F.greatest(lo - y, F.lit(0.0)) + 2 / alpha * F.greatest(y - hi, F.lit(0.0))
    first = F.least(F.floor(F.col("mu") - 8 * F.col("sd")), F.lit(-1).cast("long"), y.cast("long") - 1)
    last = F.greatest(F.ceil(F.col("mu") + 8 * F.col("sd")), y.cast("long"))
    cdf = lambda k: F.coalesce(normal_cdf(F.try_divide(k + 0.5 - F.col("mu"), F.col("sd"))), (k + 0.5 >= F.col("mu")).cast("double"))
    rows = dists.join(actuals, list(keys)).select(*keys, F.abs(F.col("mu") - y).alias("median_error"), mis.alias("mis"), "mu", "sd", "y", F.explode_outer(F.sequence(first, last)).alias("k"))
    rps = F.sum((cdf(F.col("k")) - (y <= F.col("k")).cast("double")) ** 2)  # rows, not a lambda: they are compiled
    return rows.groupBy(*keys, "median_error", "mis").agg(rps.alias("rps"))


def day_scale(counts: DataFrame, days: DataFrame) -> DataFrame:
    """counts(id, day, k), days without counts absent; days(first, last), one row -> (id, q): mean absolute change from one day to the next, of the days before the last.

    Days that aren't there count 0: a day that is there adds its change from the day before, and itself again where the day after isn't.
    """
    w = Window.partitionBy("id").orderBy("day")
    own = counts.join(F.broadcast(days)).filter("day < last").withColumn("before", F.lag(F.struct("day", "k")).over(w)).withColumn("after", F.lead("day").over(w))
    follows = F.coalesce(F.date_diff("day", F.col("before.day")) == 1, F.lit(False))
    up = F.when(follows, F.abs(F.col("k") - F.col("before.k"))).when(F.col("day") > F.col("first"), F.col("k")).otherwise(0)
    down = F.when((F.col("day") < F.date_sub("last", 1)) & ~F.coalesce(F.date_diff("after", "day") == 1, F.lit(False)), F.col("k")).otherwise(0)
    return own.groupBy("id").agg(F.try_divide(F.sum(up + down).cast("double"), F.max(F.date_diff("last", "first")) - 1).alias("q"))


def distribution_scores(dists: DataFrame, actuals: DataFrame, methods: list[str], alpha: float = 0.1) -> DataFrame:
    """distributions (method, id, kind, mu, sd, pmf), actuals(id, y, q) -> (method, id, mase, mis, rps), mase being the median's error over q, null where q is 0."""
    y = actuals.select(F.explode(F.array(*map(F.lit, methods))).alias("method"), "id", "y")
    own = item_scores(dists.filter("kind = 'pmf'").select("method", "id", "pmf"), y, "method", "id", alpha=alpha)
    normal = normal_scores(dists.filter("kind = 'normal'").select("method", "id", "mu", "sd"), y, "method", "id", alpha=alpha)
    both = own.unionByName(normal).join(actuals.select("id", "q"), "id", "left")
    return both.select("method", "id", F.try_divide("median_error", "q").alias("mase"), "mis", "rps")


def level_scores(scores: DataFrame, uppers: DataFrame) -> DataFrame:
    """distribution_scores, uppers(id) -> (method, level, n, mase, mis, rps): means over aggregates and items; aggregates have no rps, as in the summary."""
    marked = scores.join(uppers.select("id", F.lit("upper").alias("level")), "id", "left").withColumn("level", F.coalesce("level", F.lit("item")))
    rps = F.when(F.first("level") == "item", F.avg("rps"))
    return marked.groupBy("method", "level").agg(F.count("*").alias("n"), F.avg("mase").alias("mase"), F.avg("mis").alias("mis"), rps.alias("rps"))


def method_summary(dists: DataFrame, scores: DataFrame, uppers: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, gap, negative_share, below_zero, and mase, mis, rps of items and mase, mis of aggregates), one row per method."""
    items = dists.join(uppers.select("id"), "id", "left_anti")
    low = negatives(items).select("method", F.col("mean_share").alias("negative_share"), "below_zero")
    levels = level_scores(scores, uppers)
    part = lambda level, names: levels.filter(F.col("level") == level).select("method", *(F.col(n).alias(f"{level}_{n}") for n in names))
    return mean_incoherence(dists, edges).join(low, "method").join(part("item", ("mase", "mis", "rps")), "method", "left").join(part("upper", ("mase", "mis")), "method", "left")


def normal_below_zero(mu: Column, sd: Column) -> Column:
    """Mass of a normal distribution on counts below zero."""
    return F.coalesce(normal_cdf(F.try_divide(-0.5 - mu, sd)), (mu < -0.5).cast("double"))


def as_table(pmfs: DataFrame, method: str, *keys: str) -> DataFrame:
    """pmfs(*keys, pmf) -> distributions (method, *keys, kind, mu, sd, pmf)."""
    return as_tables(pmfs.withColumn("method", F.lit(method)), *keys)


def as_tables(pmfs: DataFrame, *keys: str) -> DataFrame:
    """pmfs(method, *keys, pmf) -> distributions (method, *keys, kind, mu, sd, pmf)."""
    m = moments(pmfs, "method", *keys).select("method", *keys, F.col("mean").alias("mu"), F.sqrt(F.greatest("var", F.lit(0.0))).alias("sd"))
    return pmfs.join(m, ["method", *keys]).select("method", *keys, F.lit("pmf").alias("kind"), "mu", "sd", "pmf")


def negatives(dists: DataFrame, *by: str, alpha: float = 0.1) -> DataFrame:
    """distributions (method, ..., kind, mu, sd) -> (method, *by, n, means, mean_share, bounds, bound_share, below_zero): counts and shares of means and of lower bounds below 0, mean mass below 0.

    Distributions on counts have none of these.
    """
    z = NormalDist().inv_cdf(1 - alpha / 2)
    normal = F.col("kind") == "normal"
    low = F.when(normal, F.col("mu") - z * F.col("sd")).otherwise(0.0)
    mass = F.when(normal, normal_below_zero(F.col("mu"), F.col("sd"))).otherwise(0.0)
    got = dists.groupBy("method", *by).agg(F.count("*").alias("n"), F.count_if(F.col("mu") < 0).alias("means"), F.count_if(low < 0).alias("bounds"), F.avg(mass).alias("below_zero"))
    return got.select("method", *by, "n", "means", (F.col("means") / F.col("n")).alias("mean_share"), "bounds", (F.col("bounds") / F.col("n")).alias("bound_share"), "below_zero")


def negative_gate(report: DataFrame, limit: float) -> DataFrame:
    """negatives -> (method, share, passed): share of negative means against the limit."""
    return report.groupBy("method").agg(F.try_divide(F.sum("means"), F.sum("n")).alias("share")).withColumn("passed", F.coalesce(F.col("share") <= limit, F.lit(False)))


def mean_incoherence(dists: DataFrame, edges: DataFrame) -> DataFrame:
    """distributions (method, id, mu), edges(upper_id, item) -> (method, gap): largest difference of an aggregate's mean and the sum of its items'."""
    own = dists.select("method", "id", "mu")
    sums = own.withColumnRenamed("id", "item").join(edges, "item").groupBy("method", "upper_id").agg(F.sum("mu").alias("s"))
    return own.withColumnRenamed("id", "upper_id").join(sums, ["method", "upper_id"]).groupBy("method").agg(F.max(F.abs(F.col("mu") - F.col("s"))).alias("gap"))


#: Aggregates of a count hierarchy at most: their covariance is one matrix, on the driver.
MAX_AGGREGATES = 1000


def upper_covariance(residuals: DataFrame) -> tuple[list[str], np.ndarray]:
    """residuals(id, t, e) of the aggregates -> (ids, shrunk covariance). The aggregates are few (checked): items don't appear in it."""
    named = residuals.select(F.lit(0).alias("origin"), F.col("id").alias("unique_id"), F.col("t").alias("ds"), "e")
    if named.select("unique_id").distinct().count() > MAX_AGGREGATES:
        raise ValueError(f"more than {MAX_AGGREGATES} aggregates: reconcile with diagonal weights")
    got = reconcile.pair_moments(named)
    rows = reconcile.shrunk(got.select("origin", "i", "j", F.col("plan").alias("w")), reconcile.intensity_of(got)).collect()
    ids = sorted({r["i"] for r in rows})
    at = {u: k for k, u in enumerate(ids)}
    w = np.zeros((len(ids), len(ids)))
    for r in rows:
        w[at[r["i"]], at[r["j"]]] = w[at[r["j"]], at[r["i"]]] = r["w"]
    return ids, w


def gaussian(upper: DataFrame, residuals: DataFrame, items: DataFrame, edges: DataFrame, covariance: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """upper(id, mu), residuals(id, t, e), items(item, mu, var), edges(upper_id, item) -> distributions (method, id, kind, mu, sd) of aggregates and items.

    Weights are the shrunk covariance of the aggregates' residuals and the items' variances plus 1e-9. In constraint form: the matrix
    is as large as the aggregates are many; items are updated by joins with one number, and one for each two of their aggregates. covariance: `upper_covariance`'s, where it is known.
    """
    ids, w = covariance or upper_covariance(residuals)
    at = {u: k for k, u in enumerate(ids)}
    v = items.select("item", (F.col("var") + 1e-9).alias("v"), "mu")
    links = edges.join(v, "item")
    both = links.select("item", F.col("upper_id").alias("a"), "v").join(edges.withColumnRenamed("upper_id", "b"), "item")
    inner, gap = w.copy(), np.zeros(len(ids))
    for r in both.groupBy("a", "b").agg(F.sum("v").alias("v")).collect():  # a row for each two aggregates with common items
        inner[at[r["a"]], at[r["b"]]] += r["v"]
    for r in upper.select("id", "mu").collect():
        gap[at[r["id"]]] += r["mu"]
    for r in links.groupBy("upper_id").agg(F.sum("mu").alias("s")).collect():
        gap[at[r["upper_id"]]] -= r["s"]
    inverse = np.linalg.pinv(inner, hermitian=True)
    move, spark = inverse @ gap, upper.sparkSession
    push = local_table(spark, [(u, float(x)) for u, x in zip(ids, move)], "upper_id string, z double")
    pair = local_table(spark, [(a, b, float(inverse[i, j])) for i, a in enumerate(ids) for j, b in enumerate(ids)], "a string, b string, s double")
    shift = links.join(F.broadcast(push), "upper_id").groupBy("item").agg(F.sum("z").alias("z"))
    cut = both.join(F.broadcast(pair), ["a", "b"]).groupBy("item").agg(F.sum("s").alias("s"))
    new = v.join(shift, "item").join(cut, "item").select(F.col("item").alias("id"), (F.col("mu") + F.col("v") * F.col("z")).alias("mu"), F.sqrt(F.greatest(F.lit(0.0), F.col("v") - F.col("v") ** 2 * F.col("s"))).alias("sd"))
    own = {r["id"]: r["mu"] for r in upper.select("id", "mu").collect()}
    after, spread = -(w @ move), np.sqrt(np.maximum(0, np.diag(w - w @ inverse @ w)))
    top = local_table(spark, [(u, float(own[u] + after[k]), float(spread[k])) for u, k in at.items()], "id string, mu double, sd double")
    return top.unionByName(new).select(F.lit("gaussian").alias("method"), "id", F.lit("normal").alias("kind"), "mu", "sd")


def item_draws(pmfs: DataFrame, samples: int, seed: int = 0, *keep: str) -> DataFrame:
    """pmfs(item, pmf, *keep) -> (item, sample, k, *keep): the value at which the item's cdf reaches a hashed uniform number, the same in any engine and partitioning.

    The cdf is put together once an item; of a draw only the steps below its number are counted.
    """
    steps = exploded(spread(pmfs, "item"), "item", *keep).groupBy("item", *keep).agg(F.array_sort(F.collect_list(F.struct("k", F.round("cdf", 12).alias("cdf")))).alias("steps"))
    each = steps.select("item", *keep, F.col("steps.cdf").alias("cdf"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    told = each.select("*", F.explode(F.array(hashed_uniform(F.lit(seed), F.col("item"), F.col("sample")))).alias("u"))  # a column of its own, else it would be computed in the filter, for every step
    return told.select("item", "sample", F.least(F.size(F.filter("cdf", lambda x: x <= F.col("u"))), F.size("cdf") - 1).alias("k"), *keep)


def histogram(draws: DataFrame, weight: Column | None = None) -> DataFrame:
    """draws(id, k[, weight]) -> (id, pmf)."""
    return _dense(draws.groupBy("id", "k").agg(F.sum(F.lit(1.0) if weight is None else weight).alias("c")), "id")


def sums_of_draws(draws: DataFrame, edges: DataFrame) -> DataFrame:
    """draws(item, sample, k) -> (upper_id, sample, k): combined by task before the shuffle."""
    return draws.join(edges, "item").groupBy("upper_id", "sample").agg(F.sum("k").cast("int").alias("k"))


def sums_of_lists(lists: DataFrame, edges: DataFrame) -> DataFrame:
    """lists(item, ks), an array of draws an item, edges(upper_id, item) -> (id, sample, k): aggregates' sums. Arrays are joined, and exploded only where they are added up by task."""
    each = lists.select("item", "ks").join(edges, "item").select(F.col("upper_id").alias("id"), F.posexplode("ks").alias("sample", "k"))
    return each.groupBy("id", "sample").agg(F.sum("k").cast("int").alias("k"))


def list_histograms(lists: DataFrame) -> DataFrame:
    """lists(item, ks) -> (id, pmf): the histogram of each item's own array, for which no draw is a row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part = part[part["ks"].map(len) > 0]
            yield pd.DataFrame({"id": part["item"], "pmf": [np.bincount(ks) / len(ks) for ks in part["ks"]]})

    return lists.select("item", "ks").mapInPandas(count, "id string, pmf array<double>")


def bottom_up(pmfs: DataFrame, edges: DataFrame, samples: int = 200, seed: int = 0) -> DataFrame:
    """pmfs(item, pmf) -> (id, pmf) of the aggregates: histograms of sums of independent draws of their items. Items meet their aggregates before they are drawn, so that no draw is shuffled."""
    owners = edges.groupBy("item").agg(F.collect_list("upper_id").alias("uppers"))
    draws = item_draws(spread(pmfs, "item").join(owners, "item"), samples, seed, "uppers")  # dealt before the join, else its exchange would be the one that is put together again
    return histogram(draws.select(F.explode("uppers").alias("id"), "sample", "k").groupBy("id", "sample").agg(F.sum("k").cast("int").alias("k")))


def _lowest_groups(pmfs: DataFrame, groups: DataFrame, edges: DataFrame, ids: list[str]) -> tuple[list[str], np.ndarray]:
    """(names, inside): the lowest groups and which aggregates contain them; raises unless each item is in exactly one."""
    bad = pmfs.select("item").join(groups, "item", "left").groupBy("item").agg(F.count("group").alias("n")).filter("n <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"item {bad[0]['item']} is in {bad[0]['n']} lowest groups")
    names = sorted(r["group"] for r in groups.select("group").distinct().limit(MAX_AGGREGATES + 1).collect())
    if len(names) > MAX_AGGREGATES:
        raise ValueError(f"more than {MAX_AGGREGATES} lowest groups")
    pairs = {(r["upper_id"], r["group"]) for r in edges.join(groups, "item").select("upper_id", "group").distinct().collect()}
    return names, np.array([[float((u, g) in pairs) for g in names] for u in ids])


def _without(ks: Column, gone: Column) -> Column:
    """The array without its elements at these places, counted from 0."""
    return F.when(F.size(gone) == 0, ks).otherwise(F.filter(ks, lambda _, at: ~F.array_contains(gone, at)))


def mix_cond_by_level(pmfs: DataFrame, groups: DataFrame, edges: DataFrame, upper: DataFrame, residuals: DataFrame, samples: int = 1000, seed: int = 0, covariance: tuple[list[str], np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """`mix_cond` for groups(item, group) that each item is in exactly one of -> ((id, pmf) of aggregates and items, (id, samples, ess) by aggregate).

    The exact distributions of the groups' sums come from a tree of convolutions; the groups' totals are drawn one after another with the density of every aggregate
    as soon as it is complete, resampled each time; then they are split to the items down the tree. The law is that of `mix_cond`, the weights don't collapse with many aggregates.
    """
    spark = pmfs.sparkSession
    ids, w = covariance or upper_covariance(residuals)
    names, inside = _lowest_groups(pmfs, groups, edges, ids)
    center = {r["id"]: r["mu"] for r in upper.select("id", "mu").collect()}
    mean = np.array([center[u] for u in ids])
    layers = convolution._tree(pmfs, groups, None)
    own = moments(layers[-1].select("group", "pmf"), "group").select("group", "mean", F.sqrt(F.greatest("var", F.lit(0.0))).alias("sd"))
    size = layers[-1].select("group", F.size("pmf").alias("size")).join(own, "group").collect()
    stretch = {}
    for r in size:
        alone = [k for k in range(len(ids)) if inside[k].sum() == 1 and inside[k, names.index(r["group"])]]
        near, far = (mean[alone[0]], math.sqrt(w[alone[0], alone[0]])) if alone else (r["mean"], max(r["mean"], float(r["size"])))
        stretch[r["group"]] = convolution.window(near, far, r["mean"], r["sd"], r["size"])
    cuts = local_table(spark, [(g, a, b) for g, (a, b) in stretch.items()], "group string, a int, b int")
    got = {r["group"]: np.array(r["pmf"]) for r in layers[-1].join(F.broadcast(cuts), "group").select("group", F.slice("pmf", F.col("a") + 1, F.col("b") - F.col("a")).alias("pmf")).collect()}
    draws, ess = convolution.draw_group_totals([stretch[g][0] for g in names], [got[g] for g in names], inside, mean, w, samples, np.random.default_rng(seed))
    items = convolution.split_lists(pmfs, groups, {g: draws[:, k] for k, g in enumerate(names)}, seed, layers)
    told = local_table(spark, [(u, samples, float(e)) for u, e in zip(ids, ess)], "id string, samples int, ess double")
    return histogram(sums_of_lists(items, edges)).unionByName(list_histograms(items)), told


def exact_sums(pmfs: DataFrame, edges: DataFrame) -> DataFrame:
    """pmfs(item, pmf), edges(upper_id, item) -> (id, pmf): the exact distribution of each aggregate's sum of independent items."""
    return convolution.sum_pmfs(pmfs, edges.select("item", F.col("upper_id").alias("group"))).withColumnRenamed("group", "id")


def mix_cond(pmfs: DataFrame, edges: DataFrame, upper: DataFrame, residuals: DataFrame, samples: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Importance sampling -> ((id, pmf) of aggregates and items, (samples, ess)).

    A draw of all items has as weight the normal density of its aggregates' sums at upper(id, mu) with the shrunk covariance of
    residuals(id, t, e). Draws are resampled systematically, so that items and aggregates of a draw stay together and add up. `samples`
    is the caller's number: its weights are one window.
    """
    ids, w = upper_covariance(residuals)
    center = {r["id"]: r["mu"] for r in upper.select("id", "mu").collect()}
    mean, inverse = np.array([center[u] for u in ids]), np.linalg.pinv(w, hermitian=True)

    def density(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            d = np.stack(part["sums"].to_numpy()) - mean
            yield pd.DataFrame({"sample": part["sample"], "log": -0.5 * np.einsum("ij,jk,ik->i", d, inverse, d)})

    draws = item_draws(pmfs, samples, seed)
    sums = sums_of_draws(draws, edges)
    vectors = sums.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("upper_id", "k"))), lambda s: s["k"].cast("double")).alias("sums"))
    logs = vectors.mapInPandas(density, "sample int, log double")
    everything, upto = Window.partitionBy(), Window.partitionBy().orderBy("sample").rowsBetween(Window.unboundedPreceding, 0)
    rated = logs.withColumn("w", F.exp(F.col("log") - F.max("log").over(everything))).withColumn("w", F.col("w") / F.sum("w").over(everything))
    reach = F.floor(F.sum("w").over(upto) * samples + 0.5)
    taken = rated.withColumn("reach", reach).withColumn("times", F.col("reach") - F.coalesce(F.lag("reach").over(Window.partitionBy().orderBy("sample")), F.lit(0)))
    copies = F.broadcast(taken.filter("times > 0").select("sample", F.col("times").cast("double").alias("times")))
    every = sums.withColumnRenamed("upper_id", "id").unionByName(draws.select(F.col("item").alias("id"), "sample", "k")).join(copies, "sample")
    ess = rated.agg(F.count("*").alias("samples"), (1 / F.sum(F.col("w") ** 2)).alias("ess"))
    return histogram(every, F.col("times")), ess


def td_cond(pmfs: DataFrame, groups: DataFrame, upper: DataFrame, residuals: DataFrame, edges: DataFrame, samples: int = 1000, seed: int = 0, covariance: tuple[list[str], np.ndarray] | None = None) -> tuple[DataFrame, DataFrame]:
    """Top-down conditioning -> ((id, pmf) of aggregates and items, (group, lost): draws outside a group's reach).

    groups(item, group), each item in exactly one lowest group (refused otherwise); edges(upper_id, item) as ever. The aggregates are
    reconciled first and drawn from their normal law; each group's total, rounded, is split to its items given that they add up to it.
    Totals go down a tree of convolutions, so that a large group is many tasks' work; arrays are as long as the group's largest total.
    """
    ids, w = covariance or upper_covariance(residuals)
    names, a = _lowest_groups(pmfs, groups, edges, ids)
    center = {r["id"]: r["mu"] for r in upper.select("id", "mu").collect()}
    weight = np.linalg.pinv(w, hermitian=True)
    spread = np.linalg.pinv(a.T @ weight @ a, hermitian=True)
    mean = spread @ a.T @ weight @ np.array([center[u] for u in ids])
    drawn = np.rint(np.random.default_rng(seed).multivariate_normal(mean, spread, size=samples, method="eigh")).astype(int)
    lists = convolution.split_lists(pmfs, groups, {g: drawn[:, k] for k, g in enumerate(names)}, seed)
    out = lists.filter(F.array_min("ks") < 0).select("group", F.posexplode("ks").alias("sample", "k")).filter("k < 0").select("group", "sample").distinct()
    gone = F.broadcast(out.agg(F.collect_set("sample").alias("gone")))  # one row, of samples at most
    whole = lists.join(gone).select("item", _without(F.col("ks"), F.col("gone")).alias("ks"))
    whole = materialize(whole, "whole")
    return histogram(sums_of_lists(whole, edges)).unionByName(list_histograms(whole)), out.groupBy("group").agg(F.count("*").alias("lost"))


def compare_items(scores: DataFrame, a: str, b: str, keys: list[str], value: str = "rps") -> DataFrame:
    """scores(method, *keys, value) -> (better, worse, median_difference, n) of method a against b, item by item."""
    left, right = (scores.filter(F.col("method") == m).select(*keys, F.col(value).alias(n)) for m, n in ((a, "a"), (b, "b")))
    d = left.join(right, keys).select((F.col("a") - F.col("b")).alias("d"))
    return d.agg(F.avg((F.col("d") < -1e-12).cast("double")).alias("better"), F.avg((F.col("d") > 1e-12).cast("double")).alias("worse"), F.median("d").alias("median_difference"), F.count("*").alias("n"))
