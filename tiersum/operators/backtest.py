"""Origins, splits, guards against leakage and base forecasts, for all origins in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_dates_split(series: DataFrame, h: int) -> DataFrame:
    """series with `part`: 'test' for the last h distinct dates of the table, else 'train'."""
    dates = series.select("ds").distinct().orderBy(F.desc("ds")).limit(h).agg(F.min("ds").alias("cutoff"))
    return series.join(F.broadcast(dates)).withColumn("part", F.when(F.col("ds") >= F.col("cutoff"), "test").otherwise("train")).drop("cutoff")


def origins_between(series: DataFrame, first_back: int, every: int, count: int, unit: str = "month") -> DataFrame:
    """(origin): `count` origins, `every` units apart, the first `first_back` units before the last date."""
    last = series.agg(F.max("ds").alias("last"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")
    return last.select("last", steps).select(F.expr(f"timestampadd({unit}, k * {every} - {first_back}, last)").alias("origin"))


def study_origins(series: DataFrame, studies: dict[str, dict], name: str, unit: str = "month") -> DataFrame:
    """(study, origin) of a named study; an unknown name is refused.

    A study is {"origins": [...]}, an explicit list, or {"every": k, "history": a, "ahead": b}: every k units from a units after the
    table's first date to b units before its last, so that origins grow with the table.
    """
    if name not in studies:
        raise ValueError(f"unknown study {name!r}; known are {', '.join(sorted(studies))}")
    study = studies[name]
    if "origins" in study:
        own = series.sparkSession.createDataFrame([(o,) for o in study["origins"]], "origin string").select(F.col("origin").cast("timestamp").alias("origin"))
    else:
        span = series.agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
        first, last = F.expr(f"timestampadd({unit}, {study['history']}, a)"), F.expr(f"timestampadd({unit}, -{study['ahead']}, b)")
        own = span.select(first.alias("a"), last.alias("b")).filter("a <= b").select(F.explode(F.sequence("a", "b", F.expr(f"interval {study['every']} {unit}"))).alias("origin"))
    return own.select(F.lit(name).alias("study"), "origin")


def with_baselines(forecasts: DataFrame, baselines: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Adds baselines(origin, unique_id, ds, method, y_hat) of all series and external(origin, unique_id, ds, method, y_hat), of the total only,
    to forecasts(origin, unique_id, ds, horizon, method, y_hat); targets that forecasts doesn't have are left out."""
    targets = forecasts.select("origin", "unique_id", "ds", "horizon").distinct()
    more = baselines if external is None else baselines.unionByName(external)
    own = targets.join(more, ["origin", "unique_id", "ds"]).select("origin", "unique_id", "ds", "horizon", "method", "y_hat")
    return forecasts.select(*own.columns).union(own)


def wide(rows: DataFrame, keys: list[str], ids: list[str], value: str = "y") -> DataFrame:
    """(*keys, one column per id, in the order of ids): for reports; all computing stays long."""
    return rows.groupBy(*keys).pivot("unique_id", ids).agg(F.first(value))


def horizon(unit: str, hours: int = 1) -> str:
    return f"timestampdiff({unit}, origin, ds) + 1" if unit != "hour" else f"cast((unix_timestamp(ds) - unix_timestamp(origin)) / {3600 * hours} as int) + 1"


def within(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """rows(ds, ...), windows(origin, lo, hi) -> rows with each origin that has lo <= ds < hi.

    An equal join on stretches of time, each as long as a window on average, so that a row meets a few windows beside its own and not all of them.
    """
    seconds = windows.agg(F.avg(F.unix_timestamp("hi") - F.unix_timestamp("lo"))).first()[0]
    width = max(1, int(seconds or 1))
    at = lambda c: F.floor(F.unix_timestamp(c) / width)
    spread = windows.filter("lo < hi").select("origin", "lo", "hi", F.explode(F.sequence(at("lo"), at("hi"))).alias("stretch"))
    return rows.withColumn("stretch", at("ds")).join(spread, "stretch").filter("ds >= lo and ds < hi").drop("stretch", "lo", "hi")


def histories(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, lo, hi) of everything before each origin, for `within`."""
    first = rows.agg(F.min("ds")).first()[0]
    return origins.select("origin", F.lit(first).cast("timestamp").alias("lo"), F.col("origin").alias("hi"))


def running_before(rows: DataFrame, origins: DataFrame, sums: dict[str, Column], last: str | None = None) -> DataFrame:
    """rows(unique_id, ds, ...) -> (origin, unique_id, *sums[, last]): sums over each series' rows before each origin, and the value of `last` in the latest of them.

    Rows are added up between one origin and the next; running sums over these, at most one row for each origin and series, give all origins. No row is copied by
    origin. Series without a row before an origin don't have it.
    """
    numbered = origins.select("origin").distinct().withColumn("k", F.row_number().over(Window.orderBy("origin")))  # a study's origins only
    before = F.lag("origin").over(Window.orderBy("origin"))
    first = rows.agg(F.min("ds")).first()[0]
    spans = numbered.select("origin", F.coalesce(before, F.lit(first).cast("timestamp")).alias("lo"), F.col("origin").alias("hi"))
    aggregates = [F.sum(c).alias(n) for n, c in sums.items()]
    if last:
        aggregates.append(F.max_by(F.struct(F.col(last).alias("value")), "ds").alias("latest"))
    parts = within(rows, spans).groupBy("unique_id", "origin").agg(*aggregates).join(numbered, "origin")
    series = Window.partitionBy("unique_id").orderBy("k")
    upto = series.rowsBetween(Window.unboundedPreceding, 0)
    run = parts.select("unique_id", "k", F.lead("k").over(series).alias("until"), *(F.sum(n).over(upto).alias(n) for n in sums), *([F.last("latest", True).over(upto)["value"].alias(last)] if last else []))
    count = F.lit(numbered.count())
    every = run.withColumn("k", F.explode(F.sequence(F.col("k").cast("long"), F.coalesce(F.col("until") - 1, count).cast("long"))))
    return every.join(numbered, "k").select("origin", "unique_id", *sums, *([last] if last else []))


def rolling_split(series: DataFrame, origins: DataFrame, train: int | None, h: int, unit: str = "month") -> DataFrame:
    """(origin, part, unique_id, ds, y) for all origins: train [origin - train, origin) (all before if None), test [origin, origin + h)."""
    ahead = F.expr(f"timestampadd({unit}, {h}, origin)").alias("hi")
    if train is None:
        windows = histories(series, origins).select("origin", "lo", ahead)
    else:
        windows = origins.select("origin", F.expr(f"timestampadd({unit}, -{train}, origin)").alias("lo"), ahead)
    return within(series, windows).withColumn("part", F.when(F.col("ds") < F.col("origin"), "train").otherwise("test"))


def split_violations(split: DataFrame, n_series: int, h: int) -> DataFrame:
    """Origins whose test part doesn't have exactly n_series * h rows, none null."""
    seen = split.filter("part = 'test'").groupBy("origin").agg(F.count("*").alias("rows"), F.count("y").alias("known"))
    return seen.filter((F.col("rows") != n_series * h) | (F.col("known") != F.col("rows")))


def leakage(rows: DataFrame) -> DataFrame:
    """rows(origin, ds) that an origin was fitted on -> the origins that saw their own time or later."""
    return rows.groupBy("origin").agg(F.max("ds").alias("last_seen")).filter("last_seen >= origin")


def same_season(series: DataFrame, origins: DataFrame, h: int, season: int, seasons: int, unit: str = "month") -> DataFrame:
    """(origin, unique_id, ds, horizon, back, y): for each target, its values one to `seasons` full seasons before, all before the origin."""
    targets = origins.select("origin", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("horizon")).withColumn("ds", F.expr(f"timestampadd({unit}, horizon - 1, origin)"))
    first = F.ceil(F.col("horizon") / season)
    back = targets.withColumn("back", F.explode(F.sequence(first, first + seasons - 1))).withColumn("past", F.expr(f"timestampadd({unit}, -cast(back as int) * {season}, ds)"))
    past = series.select("unique_id", F.col("ds").alias("past"), "y")
    return past.join(back, "past").select("origin", "unique_id", "ds", "horizon", "back", "y")


def seasonal_forecasts(series: DataFrame, origins: DataFrame, h: int, season: int, unit: str = "month") -> DataFrame:
    """(origin, unique_id, ds, horizon, method, y_hat): `naive`, the last full season's value, and `base`, the median of the last three.

    The median isn't linear, so that base forecasts of a total and its parts disagree.
    """
    past = same_season(series, origins, h, season, 3, unit)
    keys = ["origin", "unique_id", "ds", "horizon"]
    both = past.groupBy(*keys).agg(F.median("y").alias("base"), F.min_by("y", "back").alias("naive"))
    return both.unpivot(keys, ["base", "naive"], "method", "y_hat")


def mean_of_seasons(series: DataFrame, origins: DataFrame, h: int, season: int, seasons: int, unit: str = "month") -> DataFrame:
    """Mean of the same season in the last `seasons` ones; a target with fewer is left out."""
    past = same_season(series, origins, h, season, seasons, unit)
    got = past.groupBy("origin", "unique_id", "ds", "horizon").agg(F.avg("y").alias("y_hat"), F.count("y").alias("n"))
    return got.filter(F.col("n") == seasons).drop("n")


def last_value(series: DataFrame, origins: DataFrame) -> DataFrame:
    """(origin, unique_id, y_hat): each series' last value before the origin."""
    return running_before(series.select("unique_id", "ds", "y"), origins, {}, "y").withColumnRenamed("y", "y_hat")


def with_actuals(forecasts: DataFrame, series: DataFrame) -> DataFrame:
    return forecasts.join(series.select("unique_id", "ds", "y"), ["unique_id", "ds"])


def fitted_residuals(series: DataFrame, origins: DataFrame, season: int) -> DataFrame:
    """(origin, unique_id, ds, e): y less the median of the series' last three values of the same season, before each origin.

    Only instants at which every series has a residual are kept.
    """
    w = Window.partitionBy("unique_id").orderBy("ds")
    lags = [F.lag("y", k * season).over(w) for k in (1, 2, 3)]
    middle = sum(lags[1:], lags[0]) - F.greatest(*lags) - F.least(*lags)
    e = series.select("unique_id", "ds", (F.col("y") - middle).alias("e"), *(x.alias(f"l{k}") for k, x in enumerate(lags))).filter("l2 is not null").select("unique_id", "ds", "e")
    every = series.select("unique_id").distinct().agg(F.count("*").alias("m"))
    whole = e.groupBy("ds").agg(F.count("e").alias("n")).join(F.broadcast(every)).filter("n = m").select("ds")
    kept = e.join(whole, "ds", "left_semi")
    return within(kept, histories(series, origins)).select("origin", "unique_id", "ds", "e")


def trailing_window(residuals: DataFrame, n: int) -> DataFrame:
    """The last n distinct dates of each origin."""
    dates = residuals.select("origin", "ds").distinct()
    kept = dates.withColumn("k", F.row_number().over(Window.partitionBy("origin").orderBy(F.desc("ds")))).filter(F.col("k") <= n).select("origin", "ds")
    return residuals.join(kept, ["origin", "ds"], "left_semi")


def debiased(forecasts: DataFrame, residuals: DataFrame) -> DataFrame:
    """Forecasts plus the mean past residual of their series, before any reconciliation."""
    bias = residuals.groupBy("origin", "unique_id").agg(F.avg("e").alias("bias"))
    return forecasts.join(bias, ["origin", "unique_id"]).withColumn("y_hat", F.col("y_hat") + F.col("bias")).drop("bias")


def finished(origins: DataFrame, h: int, min_past: int, window: int | None = None, unit: str = "month") -> DataFrame:
    """(origin, past): the origins finished by then, h units after themselves; origins with fewer than min_past are left out, before only the last `window` count.

    Pairs of a study's origins, which are hundreds at most.
    """
    done = F.expr(f"timestampadd({unit}, {h}, past)") <= F.col("origin")
    pairs = origins.select("origin").join(F.broadcast(origins.select(F.col("origin").alias("past"))), done)
    own = Window.partitionBy("origin")
    kept = pairs.withColumn("n", F.count("*").over(own)).withColumn("k", F.row_number().over(own.orderBy(F.desc("past")))).filter(F.col("n") >= min_past)
    return (kept if window is None else kept.filter(F.col("k") <= window)).select("origin", "past")


def past_errors(errors: DataFrame, origins: DataFrame, h: int, min_past: int, window: int | None = None, unit: str = "month") -> DataFrame:
    """errors(origin, unique_id, ds, e) -> residuals(origin, unique_id, ds, e) of the finished origins, ds being a number for past origin and target.

    For full covariances, which need the errors themselves; for variances `past_error_variances` needs sums only.
    """
    kept = finished(origins, h, min_past, window, unit)
    own = errors.select(F.col("origin").alias("past"), "unique_id", F.xxhash64("origin", "ds").alias("ds"), "e")
    return own.join(kept, "past").select("origin", "unique_id", "ds", "e")


def past_error_variances(errors: DataFrame, origins: DataFrame, h: int, min_past: int, window: int | None = None, unit: str = "month") -> DataFrame:
    """errors(origin, unique_id, ds, e) -> (origin, unique_id, v): sample variance of the errors of the finished origins.

    Errors are summed once per origin and series; only these sums meet the pairs of origins.
    """
    per = errors.groupBy("unique_id", F.col("origin").alias("past")).agg(F.count("e").alias("n"), F.avg("e").alias("m"), F.coalesce(F.var_pop("e"), F.lit(0.0)).alias("v"))
    both = per.join(finished(origins, h, min_past, window, unit), "past")
    n, m = F.col("n"), F.col("m")
    sums = both.groupBy("origin", "unique_id").agg(F.sum(n).alias("n"), F.sum(n * m).alias("s"), F.sum(n * (F.col("v") + m * m)).alias("q"))
    return sums.select("origin", "unique_id", F.try_divide(F.col("q") - F.try_divide(F.col("s") * F.col("s"), n), n - 1).alias("v"))


def external_forecast(official: DataFrame, origins: DataFrame, h: int, debias_hours: int) -> DataFrame:
    """official(ds, y, ext), hourly -> (origin, ds, raw, debiased): the external forecast for [origin, origin + h), and the same less
    its mean error over the debias_hours strictly before the origin. Targets without a forecast are null in both."""
    seconds = F.unix_timestamp("ds") - F.unix_timestamp("origin")
    near = official.join(F.broadcast(origins), (seconds >= -3600 * debias_hours) & (seconds < 3600 * h))
    bias = near.filter(F.col("ds") < F.col("origin")).groupBy("origin").agg(F.avg(F.col("ext") - F.col("y")).alias("bias"))
    ahead = near.filter(F.col("ds") >= F.col("origin")).join(bias, "origin", "left")
    return ahead.select("origin", "ds", F.col("ext").alias("raw"), (F.col("ext") - F.col("bias")).alias("debiased"))
