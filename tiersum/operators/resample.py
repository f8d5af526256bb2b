"""Resampling with draws that any engine repeats, since they come from an md5 of seed, replicate and slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersum.operators.inference import hashed_uniform
from tiersum.operators.reconcile import pair_moments, tree_least_squares


def draws(replicates: int, slots: Column, seed: int, sizes: DataFrame) -> DataFrame:
    """sizes(*, n) -> sizes with (rep, slot, pick): `slots` picks from 0..n-1 with replacement in each replicate."""
    reps = sizes.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("slot", F.explode(F.sequence(F.lit(1), slots)))
    return reps.withColumn("pick", F.floor(hashed_uniform(F.lit(seed), F.col("rep"), F.col("slot")) * F.col("n")).cast("long"))


def rank_probabilities(levels: DataFrame, replicates: int = 200, seed: int = 0) -> DataFrame:
    """levels(origin, level, method, mase) -> (level, method, p_best, mean_rank, rank_05, rank_95) over resampled origins.

    Ties take the smallest rank. Means are rounded to nine places before ranking.
    """
    origins = levels.select("origin").distinct().withColumn("pick", F.row_number().over(Window.orderBy("origin")).cast("long") - 1)  # a study's origins: hundreds at most
    sizes = origins.agg(F.count("*").alias("n"))
    drawn = draws(replicates, F.col("n").cast("int"), seed, sizes).join(origins, "pick").select("rep", "origin")
    means = drawn.join(levels, "origin").groupBy("rep", "level", "method").agg(F.round(F.avg("mase"), 9).alias("mase"))
    ranked = means.withColumn("rank", F.rank().over(Window.partitionBy("rep", "level").orderBy("mase")).cast("double"))
    return ranked.groupBy("level", "method").agg(F.avg((F.col("rank") == 1).cast("double")).alias("p_best"), F.avg("rank").alias("mean_rank"), F.percentile("rank", F.lit(0.05)).alias("rank_05"), F.percentile("rank", F.lit(0.95)).alias("rank_95"))


def gain_bands(levels: DataFrame, method: str, reference: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """(level, k, low, middle, high, apart): 5, 50 and 95 % of the gain over the first k origins in random orders, and whether the band excludes 0."""
    ref = levels.filter(F.col("method") == reference).select("origin", "level", F.col("mase").alias("ref"))
    both = levels.filter(F.col("method") == method).join(ref, ["origin", "level"])
    each = both.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    each = each.withColumn("u", hashed_uniform(F.lit(seed), F.col("rep"), F.date_format("origin", "yyyy-MM-dd HH:mm")))
    w = Window.partitionBy("level", "rep").orderBy("u", "origin").rowsBetween(Window.unboundedPreceding, 0)
    run = each.select("level", F.count("*").over(w).alias("k"), (1 - F.try_divide(F.sum("mase").over(w), F.sum("ref").over(w))).alias("gain"))
    got = run.groupBy("level", "k").agg(*(F.percentile("gain", F.lit(q)).alias(n) for n, q in (("low", 0.05), ("middle", 0.5), ("high", 0.95))))
    return got.withColumn("apart", (F.col("low") > 0) | (F.col("high") < 0))


def correlation_interval(errors: DataFrame, replicates: int = 200, seed: int = 0) -> DataFrame:
    """errors(origin, unique_id, ds, e), complete -> (mean, low, high): mean correlation of all pairs of series, and 5 and 95 % of it over resampled whole origins.

    Each origin's sums of products are made once; a replicate adds up those of its origins.
    """
    pairs = pair_moments(errors).filter("i < j").select("origin", "i", "j", (F.col("plan") * F.col("t")).alias("sxy"))
    e = F.col("e")
    own = errors.groupBy("origin", "unique_id").agg(F.count("e").alias("n"), F.sum("e").alias("s"), F.sum(e * e).alias("q"))
    rows = pairs.join(own.toDF("origin", "i", "n", "sx", "qx"), ["origin", "i"]).join(own.drop("n").toDF("origin", "j", "sy", "qy"), ["origin", "j"])
    origins = errors.select("origin").distinct().withColumn("pick", F.row_number().over(Window.orderBy("origin")).cast("long") - 1)  # a study's origins
    sizes = origins.agg(F.count("*").alias("n"))
    drawn = draws(replicates, F.col("n").cast("int"), seed, sizes).join(origins, "pick").groupBy("rep", "origin").agg(F.count("*").alias("times"))
    drawn = drawn.unionByName(origins.select(F.lit(0).alias("rep"), "origin", F.lit(1).cast("long").alias("times")))  # replicate 0: each origin once
    names = ("n", "sxy", "sx", "sy", "qx", "qy")
    sums = rows.join(drawn, "origin").groupBy("rep", "i", "j").agg(*(F.sum(F.col("times") * F.col(c)).alias(c) for c in names))
    n, sxy, sx, sy, qx, qy = map(F.col, names)
    r = sums.select("rep", F.try_divide(sxy - sx * sy / n, F.sqrt(F.greatest(F.lit(0.0), qx - sx * sx / n) * F.greatest(F.lit(0.0), qy - sy * sy / n))).alias("r"))
    means = r.groupBy("rep").agg(F.avg("r").alias("m"))
    again = F.when(F.col("rep") > 0, F.col("m"))
    return means.agg(F.max(F.when(F.col("rep") == 0, F.col("m"))).alias("mean"), F.percentile(again, F.lit(0.05)).alias("low"), F.percentile(again, F.lit(0.95)).alias("high"))


def pick_counts(residuals: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(origin, past, times): how often each origin's replicates, one pick each, take each past instant."""
    w = Window.partitionBy("origin").orderBy("ds")
    instants = residuals.select("origin", "ds").distinct().withColumn("pick", (F.row_number().over(w) - 1).cast("long"))
    sizes = instants.groupBy("origin").agg(F.count("*").alias("n"))
    picks = draws(replicates, F.lit(1), seed, sizes).groupBy("origin", "pick").agg(F.count("*").alias("times"))
    return picks.join(instants, ["origin", "pick"]).select("origin", F.col("ds").alias("past"), "times")


def joint_bootstrap_quantiles(forecasts: DataFrame, residuals: DataFrame, edges: DataFrame, q: float, replicates: int = 101, seed: int = 0, independent: bool = False) -> DataFrame:
    """(origin, unique_id, ds, q_hat): quantile of bottom-up samples, each made of base forecasts and the residuals of one past instant.

    All series of a draw take their residuals from the same instant, which keeps their correlation: a node's sum at an instant is made once, how often the instant
    is drawn is its frequency in the quantile, and the quantile moves with the forecast, so that nothing grows with the replicates. independent: each series
    takes an instant of its own, the contrast that loses the correlation; there a row for each draw and leaf is added up.
    """
    below = edges.select("unique_id", "leaf_id")
    leaf = below.select("leaf_id").distinct()
    own = residuals.select("origin", F.col("ds").alias("past"), F.col("unique_id").alias("leaf_id"), "e").join(leaf, "leaf_id", "left_semi")
    if independent:
        w = Window.partitionBy("origin").orderBy("ds")
        instants = residuals.select("origin", "ds").distinct().withColumn("pick", (F.row_number().over(w) - 1).cast("long"))
        sizes = instants.groupBy("origin").agg(F.count("*").alias("n"))
        each = draws(replicates, F.lit(1), seed, sizes).select("origin", "rep", "n").join(own.select("origin", "leaf_id").distinct(), "origin")
        each = each.withColumn("pick", F.floor(hashed_uniform(F.lit(seed), F.col("rep"), F.col("leaf_id")) * F.col("n")).cast("long"))
        shocks = each.join(instants.withColumnRenamed("ds", "past"), ["origin", "pick"]).join(own, ["origin", "past", "leaf_id"]).select("origin", "rep", "leaf_id", "e")
        sums = shocks.join(below, "leaf_id").groupBy("origin", "rep", "unique_id").agg(F.sum("e").alias("e"), F.lit(1).cast("long").alias("times"))
    else:
        sums = own.join(below, "leaf_id").groupBy("origin", "past", "unique_id").agg(F.sum("e").alias("e")).join(pick_counts(residuals, replicates, seed), ["origin", "past"])
    base = forecasts.select("origin", "ds", F.col("unique_id").alias("leaf_id"), "y_hat").join(below, "leaf_id").groupBy("origin", "unique_id", "ds").agg(F.sum("y_hat").alias("y_hat"))
    return _moved(base, sums, q)


def _moved(base: DataFrame, shocks: DataFrame, q: float) -> DataFrame:
    """base(origin, unique_id, ds, y_hat), shocks(origin, unique_id, e, times) -> (origin, unique_id, ds, q_hat): the shocks' quantile by frequency, added to each forecast."""
    spread = shocks.groupBy("origin", "unique_id").agg(F.percentile("e", F.lit(q), F.col("times")).alias("q"))
    return base.join(spread, ["origin", "unique_id"]).select("origin", "unique_id", "ds", (F.col("y_hat") + F.col("q")).alias("q_hat"))


def projected_bootstrap_quantiles(forecasts: DataFrame, residuals: DataFrame, nodes: DataFrame, variance: DataFrame | None, depth: int, q: float, replicates: int = 101, seed: int = 0) -> DataFrame:
    """joint_bootstrap_quantiles by a full projection: each sample of all nodes is reconciled with diagonal weights.

    The projection is linear: forecasts and the residuals of each past instant are reconciled once, whatever the number of replicates.
    """
    base = tree_least_squares(forecasts.select("origin", "ds", "unique_id", "y_hat"), nodes, variance, depth, ("origin", "ds"))
    past = residuals.select("origin", F.col("ds").alias("past"), "unique_id", F.col("e").alias("y_hat"))
    moved = tree_least_squares(past, nodes, variance, depth, ("origin", "past")).withColumnRenamed("y_hat", "e")
    return _moved(base, moved.join(pick_counts(residuals, replicates, seed), ["origin", "past"]), q)


def coverage(quantiles: DataFrame, series: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, coverage, n): share of actual values at or below their quantile."""
    joined = quantiles.join(series.select("unique_id", "ds", "y"), ["unique_id", "ds"]).join(nodes.select("unique_id", "level"), "unique_id")
    return joined.groupBy("level").agg(F.avg((F.col("y") <= F.col("q_hat")).cast("double")).alias("coverage"), F.count("*").alias("n"))


def quantile_of_sum(residuals: DataFrame, edges: DataFrame, q: float) -> DataFrame:
    """(origin, unique_id, sum_of_quantiles, quantile_of_sum): the leaves' residual quantiles added up, and the quantile of the leaves' sum."""
    below = edges.select("unique_id", "leaf_id")
    own = residuals.select("origin", "ds", F.col("unique_id").alias("leaf_id"), "e").join(below, "leaf_id")
    leaf = own.groupBy("origin", "unique_id", "leaf_id").agg(F.percentile("e", F.lit(q)).alias("q")).groupBy("origin", "unique_id").agg(F.sum("q").alias("sum_of_quantiles"))
    whole = own.groupBy("origin", "unique_id", "ds").agg(F.sum("e").alias("e")).groupBy("origin", "unique_id").agg(F.percentile("e", F.lit(q)).alias("quantile_of_sum"))
    return leaf.join(whole, ["origin", "unique_id"])
