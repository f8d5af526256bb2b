"""Accuracy metrics and comparisons of methods. forecasts: (origin, unique_id, ds, horizon, method, y_hat, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersum.operators.backtest import running_before

#: A method is better than another only by more than rounding errors.
TIE = 1e-9


def ratio(a, b):
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def mase_scale(series: DataFrame, origins: DataFrame, season: int) -> DataFrame:
    """(origin, unique_id, scale): mean absolute seasonal difference before each origin, from running sums of each series."""
    w = Window.partitionBy("unique_id").orderBy("ds")
    diffs = series.select("unique_id", "ds", F.abs(F.col("y") - F.lag("y", season).over(w)).alias("d")).filter("d is not null")
    sums = running_before(diffs, origins, {"s": F.col("d"), "n": F.lit(1)})
    return sums.select("origin", "unique_id", (F.col("s") / F.col("n")).alias("scale"))


def mase(forecasts: DataFrame, scales: DataFrame, nodes: DataFrame) -> DataFrame:
    """(origin, level, unique_id, method, mase). mase is null where the scale is 0 or missing: `missing_scales` lists these series."""
    err = forecasts.groupBy("origin", "unique_id", "method").agg(F.avg(F.abs(F.col("y") - F.col("y_hat"))).alias("mae"))
    joined = err.join(scales, ["origin", "unique_id"], "left").join(nodes.select("unique_id", "level"), "unique_id")
    return joined.select("origin", "level", "unique_id", "method", ratio(F.col("mae"), F.col("scale")).alias("mase"))


def missing_scales(forecasts: DataFrame, scales: DataFrame) -> DataFrame:
    """(origin, unique_id) of forecasts without a positive scale."""
    return forecasts.select("origin", "unique_id").distinct().join(scales.filter("scale > 0"), ["origin", "unique_id"], "left_anti")


def refuse_missing_scales(forecasts: DataFrame, scales: DataFrame) -> DataFrame:
    """forecasts itself; raises, naming one, if a series has no positive scale."""
    bad = missing_scales(forecasts, scales).orderBy("origin", "unique_id").limit(1).collect()
    if bad:
        raise ValueError(f"no scale for {bad[0]['unique_id']} at {bad[0]['origin']}")
    return forecasts


def by_level(mase_rows: DataFrame) -> DataFrame:
    """(origin, level, method, mase): mean over the series of a level."""
    return mase_rows.filter("mase is not null").groupBy("origin", "level", "method").agg(F.avg("mase").alias("mase"))


def summary(levels: DataFrame) -> DataFrame:
    """(level, method, mean, sd, n) over origins."""
    return levels.groupBy("level", "method").agg(F.avg("mase").alias("mean"), F.stddev_samp("mase").alias("sd"), F.count("*").alias("n"))


def _against(levels: DataFrame, reference: str, *keys: str) -> DataFrame:
    ref = levels.filter(F.col("method") == reference).select(*keys, F.col("mase").alias("ref"))
    return levels.join(ref, list(keys))


def relative_change(levels: DataFrame, reference: str) -> DataFrame:
    """(level, method, mean, sd, low, high, n, wins) of mase / reference - 1 per origin."""
    change = _against(levels, reference, "origin", "level").withColumn("c", ratio(F.col("mase"), F.col("ref")) - 1)
    return change.groupBy("level", "method").agg(F.avg("c").alias("mean"), F.stddev_samp("c").alias("sd"), F.min("c").alias("low"), F.max("c").alias("high"), F.count("c").alias("n"), F.count_if(F.col("c") < -TIE).alias("wins"))


def aggregate_gain(levels: DataFrame, reference: str, *more: str) -> DataFrame:
    """(*more, level, method, gain, win_share, n): 1 - mean / mean of the reference, on the origins that both have."""
    both = _against(levels, reference, *more, "origin", "level")
    return both.groupBy(*more, "level", "method").agg((1 - ratio(F.avg("mase"), F.avg("ref"))).alias("gain"), F.avg((F.col("mase") < F.col("ref") - TIE).cast("double")).alias("win_share"), F.count_distinct("origin").alias("n"))


def gain_table(levels: DataFrame, references: list[str]) -> DataFrame:
    """(level, method, reference, gain) for several references."""
    out = None
    for r in references:
        part = aggregate_gain(levels, r).select("level", "method", F.lit(r).alias("reference"), "gain")
        out = part if out is None else out.union(part)
    return out


def mase_by_horizon(forecasts: DataFrame, scales: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, method, horizon, mase): mean over series within an origin, then over origins."""
    joined = forecasts.join(scales, ["origin", "unique_id"]).join(nodes.select("unique_id", "level"), "unique_id")
    first = joined.groupBy("origin", "level", "method", "horizon").agg(F.avg(ratio(F.abs(F.col("y") - F.col("y_hat")), F.col("scale"))).alias("m"))
    return first.groupBy("level", "method", "horizon").agg(F.avg("m").alias("mase"))


def gain_by_horizon(table: DataFrame, reference: str) -> DataFrame:
    """mase_by_horizon rows -> (level, method, horizon, gain): 1 - mase / that of the reference at the same horizon."""
    ref = table.filter(F.col("method") == reference).select("level", "horizon", F.col("mase").alias("ref"))
    return table.join(ref, ["level", "horizon"]).select("level", "method", "horizon", (1 - ratio(F.col("mase"), F.col("ref"))).alias("gain"))


def gain_by_band(table: DataFrame, reference: str, first: int) -> DataFrame:
    """mase_by_horizon rows -> (level, method, band, mase, gain): means over the horizons up to `first` and over those beyond."""
    band = F.when(F.col("horizon") <= first, F.lit(f"1-{first}")).otherwise(F.lit(f"{first + 1}-"))
    means = table.groupBy("level", "method", band.alias("band")).agg(F.avg("mase").alias("mase"))
    ref = means.filter(F.col("method") == reference).select("level", "band", F.col("mase").alias("ref"))
    return means.join(ref, ["level", "band"]).select("level", "method", "band", "mase", (1 - ratio(F.col("mase"), F.col("ref"))).alias("gain"))


def monthly_gain(levels: DataFrame, reference: str) -> DataFrame:
    """(month, level, method, gain, won): by month of the origin, won if better than the reference by more than rounding."""
    months = monthly(levels)
    ref = months.filter(F.col("method") == reference).select("month", "level", F.col("mase").alias("ref"))
    return months.join(ref, ["month", "level"]).select("month", "level", "method", (1 - ratio(F.col("mase"), F.col("ref"))).alias("gain"), (F.col("mase") < F.col("ref") - TIE).alias("won"))


def months_won(levels: DataFrame, reference: str) -> DataFrame:
    """(level, method, months, won)."""
    return monthly_gain(levels, reference).groupBy("level", "method").agg(F.count("*").alias("months"), F.count_if("won").alias("won"))


def first_apart(bands: DataFrame) -> DataFrame:
    """resample.gain_bands rows -> (level, k): the first number of origins at which the band excludes 0, null where none does."""
    return bands.groupBy("level").agg(F.min(F.when(F.col("apart"), F.col("k"))).alias("k"))


def by_origin(levels: DataFrame, methods: list[str]) -> DataFrame:
    """(level, origin, one column of MASE per method)."""
    return levels.groupBy("level", "origin").pivot("method", methods).agg(F.first("mase"))


def monthly(levels: DataFrame) -> DataFrame:
    """(month, level, method, mase, n) by month of the origin."""
    return levels.groupBy(F.date_trunc("month", "origin").alias("month"), "level", "method").agg(F.avg("mase").alias("mase"), F.count("*").alias("n"))


def error_metrics(forecasts: DataFrame, scales: DataFrame, nodes: DataFrame) -> DataFrame:
    """(origin, level, method, metric, value): MAE, RMSE, MAPE in percent and MASE per series, then the level's mean.

    Actual values of 0, which have no percentage error, are left out of MAPE; their share is the metric `zero_share`. Series
    without a scale are left out of MASE.
    """
    e, y = F.col("y") - F.col("y_hat"), F.col("y")
    per = forecasts.groupBy("origin", "unique_id", "method").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(ratio(F.abs(e), y))).alias("mape"), F.avg((y == 0).cast("double")).alias("zero_share"))
    joined = per.join(scales, ["origin", "unique_id"], "left").withColumn("mase", ratio(F.col("mae"), F.col("scale"))).join(nodes.select("unique_id", "level"), "unique_id")
    long = joined.unpivot(["origin", "level", "method"], ["mae", "rmse", "mape", "zero_share", "mase"], "metric", "value")
    return long.groupBy("origin", "level", "method", "metric").agg(F.avg("value").alias("value"))


def running_gain(levels: DataFrame, method: str, reference: str) -> DataFrame:
    """(level, origin, k, gain) as origins accumulate in time."""
    w = Window.partitionBy("level").orderBy("origin").rowsBetween(Window.unboundedPreceding, 0)
    both = _against(levels, reference, "origin", "level").filter(F.col("method") == method)
    return both.select("level", "origin", F.count("*").over(w).alias("k"), (1 - ratio(F.sum("mase").over(w), F.sum("ref").over(w))).alias("gain"))


def mean_adjustment(forecasts: DataFrame, base: str = "base") -> DataFrame:
    """(unique_id, method, adjustment): mean of reconciled less base forecast."""
    keys = ["origin", "unique_id", "ds"]
    own = forecasts.filter(F.col("method") == base).select(*keys, F.col("y_hat").alias("b"))
    return forecasts.filter(F.col("method") != base).join(own, keys).groupBy("unique_id", "method").agg(F.avg(F.col("y_hat") - F.col("b")).alias("adjustment"))


def incoherence(forecasts: DataFrame, edges: DataFrame, value: str = "y_hat") -> DataFrame:
    """(origin, method, gap): the largest absolute difference of a node and the sum of its leaves."""
    keys = ["origin", "method", "ds"]
    sums = forecasts.select(*keys, F.col("unique_id").alias("leaf_id"), F.col(value).alias("v")).join(edges.select("unique_id", "leaf_id"), "leaf_id").groupBy(*keys, "unique_id").agg(F.sum("v").alias("s"))
    return forecasts.join(sums, [*keys, "unique_id"]).groupBy("origin", "method").agg(F.max(F.abs(F.col(value) - F.col("s"))).alias("gap"))


def incoherence_by(forecasts: DataFrame, edges: DataFrame, by: list[str], keys: list[str], value: str = "y_hat") -> DataFrame:
    """forecasts(*keys, unique_id, *value) -> (*by, n, gap, lowest, highest): nodes compared with the sum of their leaves, the largest absolute difference and the extreme signed ones.

    keys name one set of nodes, e.g. origin, method, ds, horizon; by are any of the keys, unique_id or level, or none for one row over all. Actual values are
    compared by the key ds. Leaves, which are their own sums, don't count.
    """
    below = edges.filter("unique_id <> leaf_id").select("unique_id", "leaf_id")
    sums = forecasts.select(*keys, F.col("unique_id").alias("leaf_id"), F.col(value).alias("v")).join(below, "leaf_id").groupBy(*keys, "unique_id").agg(F.sum("v").alias("s"))
    d = F.col(value) - F.col("s")
    gaps = forecasts.select(*{*keys, "unique_id", value, *by}).join(sums, [*keys, "unique_id"]).withColumn("d", d)
    return gaps.groupBy(*by).agg(F.count("d").alias("n"), F.max(F.abs("d")).alias("gap"), F.min("d").alias("lowest"), F.max("d").alias("highest"))


def coherence_violations(forecasts: DataFrame, edges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(origin, method, gap, bad, missing): where a gap is above the tolerance, values aren't finite, or nodes have no row."""
    nodes = edges.agg(F.count_distinct("unique_id").alias("m"))
    bad = F.count_if(F.col("y_hat").isNull() | F.isnan("y_hat") | (F.abs("y_hat") == float("inf")))
    instants = forecasts.groupBy("origin", "method", "ds").agg(F.count_distinct("unique_id").alias("own"), bad.alias("bad"))
    per = instants.join(F.broadcast(nodes)).groupBy("origin", "method").agg(F.sum(F.col("m") - F.col("own")).alias("missing"), F.sum("bad").alias("bad"))
    got = per.join(incoherence(forecasts, edges), ["origin", "method"], "left")
    return got.filter((F.col("missing") > 0) | (F.col("bad") > 0) | ~F.coalesce(F.col("gap") <= tolerance, F.lit(False))).select("origin", "method", "gap", "bad", "missing")


def assert_coherent(forecasts: DataFrame, edges: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """forecasts itself; raises, naming the first, if a method at an origin is incoherent, incomplete or not finite."""
    bad = coherence_violations(forecasts, edges, tolerance).orderBy("origin", "method").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['method']} at {bad[0]['origin']}: gap {bad[0]['gap']}, {bad[0]['bad']} values not finite, {bad[0]['missing']} missing")
    return forecasts


def gate(forecasts: DataFrame, edges: DataFrame, levels: DataFrame, baseline: str, abs_tol: float = 1e-6, rel_tol: float = 1e-9, negative_share: float = 0.0, worse_by: float = 0.02, weights: dict[int, float] | None = None) -> DataFrame:
    """(method, check, value, passed, blocking): five rules and, if weights of levels are given, the weighted change, which doesn't block.

    complete: every node has a row at each of the method's instants. coherence: the largest gap of a node and the sum of its leaves is
    within the absolute or the relative tolerance. finite; negative: share of negative values. accuracy: no level's MASE is above the
    baseline's by more than worse_by. A value that can't be computed fails: every method has all rows, whatever is missing.
    """
    nodes = edges.agg(F.count_distinct("unique_id").alias("m"), F.count_distinct("level").alias("levels"))
    bad = F.col("y_hat").isNull() | F.isnan("y_hat") | (F.abs("y_hat") == float("inf"))
    plain = forecasts.groupBy("method").agg(F.max(F.when(~bad, F.abs("y_hat"))).alias("top"), F.count_if(bad).cast("double").alias("bad"), F.avg((F.col("y_hat") < 0).cast("double")).alias("neg"))
    instants = forecasts.groupBy("method", "origin", "ds").agg(F.count_distinct("unique_id").alias("own")).join(F.broadcast(nodes))
    missing = instants.groupBy("method").agg(F.sum(F.col("m") - F.col("own")).cast("double").alias("missing"), F.max("levels").alias("levels"))
    gaps = incoherence(forecasts, edges).groupBy("method").agg(F.max("gap").alias("gap"))
    means = levels.groupBy("level", "method").agg(F.avg("mase").alias("mase"))
    base = means.filter(F.col("method") == baseline).select("level", F.col("mase").alias("b"))
    change, weight = ratio(F.col("mase"), F.col("b")) - 1, F.lit(None).cast("double")
    if weights:
        weight = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))[F.col("level")]
    worst = means.join(base, "level", "left").groupBy("method").agg(
        F.max(change).alias("worst"), F.count_if(F.col("mase") <= F.col("b") * (1 + worse_by)).alias("sound"),
        F.when(F.count(change * weight) == len(weights or ()), ratio(F.sum(change * weight), F.sum(F.when(change.isNotNull(), weight)))).alias("weighted"),
    )
    one = plain.join(missing, "method").join(gaps, "method", "left").join(worst, "method", "left")
    number = F.when(~F.isnan("gap"), F.col("gap"))
    rules = {
        "complete": (F.col("missing"), F.col("missing") == 0),
        "coherence": (number, (number <= abs_tol) | (number / F.greatest(F.col("top"), F.lit(1e-12)) <= rel_tol)),
        "finite": (F.col("bad"), F.col("bad") == 0),
        "negative": (F.col("neg"), F.col("neg") <= negative_share),
        "accuracy": (F.when(~F.isnan("worst"), F.col("worst")), F.col("sound") == F.col("levels")),
    }
    rows = [F.struct(F.lit(k).alias("check"), v.alias("value"), F.coalesce(ok, F.lit(False)).alias("passed"), F.lit(True).alias("blocking")) for k, (v, ok) in rules.items()]
    if weights:
        rows.append(F.struct(F.lit("weighted_change").alias("check"), F.when(~F.isnan("weighted"), F.col("weighted")).alias("value"), F.lit(True).alias("passed"), F.lit(False).alias("blocking")))
    return one.select("method", F.explode(F.array(*rows)).alias("c")).select("method", "c.*")


def verdict(checks: DataFrame, methods: DataFrame) -> DataFrame:
    """methods(method) -> (method, passed): whether all blocking checks passed; a method without checks hasn't."""
    per = checks.filter("blocking").groupBy("method").agg(F.bool_and("passed").alias("passed"))
    return methods.select("method").distinct().join(per, "method", "left").select("method", F.coalesce("passed", F.lit(False)).alias("passed"))


def gain_by_metric(long: DataFrame, reference: str) -> DataFrame:
    """error_metrics rows -> (level, metric, method, gain, n) on the origins that the reference has."""
    keys = ["origin", "level", "metric"]
    ref = long.filter(F.col("method") == reference).select(*keys, F.col("value").alias("ref"))
    return long.join(ref, keys).groupBy("level", "metric", "method").agg((1 - ratio(F.avg("value"), F.avg("ref"))).alias("gain"), F.count_distinct("origin").alias("n"))


def change_by_series(mase_rows: DataFrame, reference: str, methods: list[str]) -> DataFrame:
    """(unique_id, method, mean, win_share, n) of mase / reference - 1 over the n origins at which the reference isn't perfect."""
    keys = ["origin", "unique_id"]
    ref = mase_rows.filter(F.col("method") == reference).select(*keys, F.col("mase").alias("ref"))
    change = mase_rows.filter(F.col("method").isin(methods)).join(ref, keys).withColumn("c", ratio(F.col("mase"), F.col("ref")) - 1)
    return change.groupBy("unique_id", "method").agg(F.avg("c").alias("mean"), F.avg((F.col("c") < -TIE).cast("double")).alias("win_share"), F.count("c").alias("n"))
