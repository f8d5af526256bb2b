"""Statistical tests, one per series, level or method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize
from tiersum.operators.tails import chi_square_tail, normal_tail, student_tail, student_width, wilcoxon_tail


def bias_table(errors: DataFrame, *keys: str) -> DataFrame:
    """errors(*keys, e) -> (*keys, n, mean, sd, t, biased). t and biased are null for a series without variance."""
    got = errors.groupBy(*keys).agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd"))
    return got.withColumn("t", F.try_divide("mean", F.col("sd") / F.sqrt("n"))).withColumn("biased", F.abs("t") > 2)


def refuse_non_finite(errors: DataFrame) -> DataFrame:
    """errors itself; a value that is null or not finite ends the job."""
    e = F.col("e")
    bad = e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return errors.withColumn("e", F.when(bad, F.raise_error(F.lit("an error is null or not finite"))).otherwise(e))


def autocovariances(errors: DataFrame, keys: list[str], lags: int | Column) -> DataFrame:
    """errors(*keys, ds, e) -> (*keys, lag, n, g): g = sum of products of deviations `lag` apart, over n, lags 0..lags, a number or an expression of n."""
    w = Window.partitionBy(*keys)
    x = errors.select(*keys, (F.col("e") - F.avg("e").over(w)).alias("d"), F.row_number().over(w.orderBy("ds")).alias("t"), F.count("*").over(w).alias("n"))
    last = lags.cast("int") if isinstance(lags, Column) else F.lit(lags)
    ahead = x.select(*keys, F.col("d").alias("d2"), F.explode(F.sequence(F.lit(0), last)).alias("lag"), "t").withColumn("t", F.col("t") - F.col("lag"))
    return x.join(ahead, [*keys, "t"]).groupBy(*keys, "lag").agg((F.sum(F.col("d") * F.col("d2")) / F.max("n")).alias("g"), F.max("n").alias("n"))


def acf(errors: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """(*keys, lag, rho)."""
    g = autocovariances(errors, keys, lags)
    zero = g.filter("lag = 0").select(*keys, F.col("g").alias("g0"))
    return g.join(zero, keys).filter("g0 > 0").select(*keys, "lag", (F.col("g") / F.col("g0")).alias("rho"), "n")


def ljung_box(errors: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """(*keys, lags, q): the statistic over lags 1..k for each k of lags, from one pass over the largest."""
    r = acf(errors, keys, max(lags)).filter("lag > 0").withColumn("lags", F.explode(F.array(*map(F.lit, lags)))).filter("lag <= lags")
    return r.groupBy(*keys, "lags").agg((F.max(F.col("n") * (F.col("n") + 2)) * F.sum(F.col("rho") ** 2 / (F.col("n") - F.col("lag")))).alias("q"))


def ljung_box_test(errors: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """ljung_box with p by the chi-square law."""
    return ljung_box(errors, keys, lags).withColumn("p", chi_square_tail("q", "lags"))


def hac_mean(errors: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, n, mean, lags, se, naive_se, t, p): mean test with Bartlett weights over ceil(1.3 sqrt(n)) lags, p by the normal law.

    Null and non-finite errors are refused. t and p are null for a series without variance.
    """
    errors = refuse_non_finite(errors)
    lags = F.ceil(1.3 * F.sqrt("n"))
    basic = errors.groupBy(*keys).agg(F.count("e").alias("n"), F.avg("e").alias("mean"), F.stddev_samp("e").alias("sd")).withColumn("lags", lags)
    g = autocovariances(errors, keys, lags).drop("n").join(basic, keys).filter(F.col("lag") <= F.col("lags"))
    weight = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.col("lags") + 1)))
    got = g.groupBy(*keys, "n", "mean", "sd", "lags").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(weight * F.col("g"))) / F.col("n")).alias("se"))
    t = F.try_divide("mean", "se")
    return got.select(*keys, "n", "mean", "lags", "se", (F.col("sd") / F.sqrt("n")).alias("naive_se"), t.alias("t"), normal_tail(t).alias("p"))


def _joined(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined to one row of more for each key, nulls being a key like others."""
    named = more.select(*(F.col(k).alias(f"{k}_of") for k in keys), *(c for c in more.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in keys]
    return rows.join(named, same).drop(*(f"{k}_of" for k in keys))


#: p values that are put in order by one task.
RANGE_ROWS = 200_000


def holm(pvalues: DataFrame, family: list[str], order: list[str], alpha: float = 0.05) -> DataFrame:
    """pvalues(*family, *order, p) -> with adjusted p and rejection, step-down within each family.

    A family may be of any size: rows are dealt by ranges of (family, p), ranked within their range, and moved up by the rows of the ranges before;
    the running maximum starts from that of the ranges before. Only a row for each range and family is put in order by itself.
    """
    ranges = -(-pvalues.count() // RANGE_ROWS)
    ordered = [*family, "p", *order]
    if ranges > 1:
        dealt = materialize(pvalues.repartitionByRange(ranges, *ordered).withColumn("range", F.spark_partition_id()), "ranges")
    else:
        dealt = pvalues.withColumn("range", F.lit(0))
    own = Window.partitionBy("range", *family).orderBy("p", *order)
    before = Window.partitionBy(*family).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*family, "range").agg(F.count("*").alias("rows"))
    sizes = sizes.select(*family, "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("ahead"), F.sum("rows").over(Window.partitionBy(*family)).alias("m"))
    keys = [*family, "range"]
    raw = (F.col("m") - F.col("ahead") - F.row_number().over(own) + 1) * F.col("p")
    stepped = _joined(dealt, sizes, keys).withColumn("raw", raw).drop("ahead", "m")
    if ranges > 1:
        stepped = materialize(stepped, "ranges")
    tops = stepped.groupBy(*keys).agg(F.max("raw").alias("top")).select(*keys, F.max("top").over(before).alias("top"))
    highest = F.greatest("top", F.max("raw").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = _joined(stepped, tops, keys).withColumn("adjusted", F.least(F.lit(1.0), highest)).drop("raw", "top", "range")
    return out.withColumn("reject", F.col("adjusted") <= alpha).select(*pvalues.columns, "adjusted", "reject")


def paired(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows(*keys, d), d = a - b -> (*keys, n, mean, t, better, nonzero, rank_sum, ties): t statistic, share of d < 0 and Wilcoxon's sum of positive ranks.

    Differences of 0 take no rank; ties: sum of t^3 - t over groups of equal sizes. t is null without variance, rank_sum if all are 0.
    """
    t = F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d")))
    basic = rows.groupBy(*keys).agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd"), t.alias("t"), F.avg((F.col("d") < 0).cast("double")).alias("better"))
    size = Window.partitionBy(*keys).orderBy(F.abs("d"))
    same = F.count("*").over(Window.partitionBy(*keys, F.abs("d")))
    ranks = rows.filter("d <> 0").withColumn("same", same).withColumn("r", F.rank().over(size) + (F.col("same") - 1) / 2)
    sums = ranks.groupBy(*keys).agg(F.count("*").alias("nonzero"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("rank_sum"), F.sum(F.col("same") * F.col("same") - 1).cast("double").alias("ties"))
    return basic.join(sums, keys, "left").withColumn("nonzero", F.coalesce("nonzero", F.lit(0)))


def paired_test(rows: DataFrame, keys: list[str], least: int = 6) -> DataFrame:
    """paired with the mean's 95 % interval and p by Student's law, and Wilcoxon's p from `least` differences on."""
    got = paired(rows, keys)
    df, se = F.col("n").cast("double") - 1, F.col("sd") / F.sqrt("n")
    half = student_width(df) * se
    ranked = F.when((F.col("n") >= least) & (F.col("nonzero") > 0), wilcoxon_tail("rank_sum", "nonzero", "ties"))
    return got.select("*", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"), student_tail("t", df).alias("p_t"), ranked.alias("p_wilcoxon")).drop("sd")


def against_reference(differences: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """differences(*keys, origin, d, mase, ref) -> (*keys, n, gain, better, p_wilcoxon, p_hac, and both adjusted by Holm over all rows).

    Methods that are identical to the reference are left out.
    """
    told = differences.groupBy(*keys).agg((1 - F.try_divide(F.avg("mase"), F.avg("ref"))).alias("gain"), F.max(F.abs("d")).alias("most")).filter("most > 0").drop("most")
    ranks = paired_test(differences.select(*keys, "d"), keys).select(*keys, "n", "better", "p_wilcoxon")
    hac = hac_mean(differences.select(*keys, F.col("origin").alias("ds"), F.col("d").alias("e")), keys).select(*keys, F.col("p").alias("p_hac"))
    out = told.join(ranks, keys).join(hac, keys).withColumn("family", F.lit("all"))
    for name in ("wilcoxon", "hac"):
        own = holm(out.select("family", *keys, F.col(f"p_{name}").alias("p")).filter("p is not null"), ["family"], keys, alpha)
        out = out.join(own.select(*keys, F.col("adjusted").alias(f"holm_{name}"), F.col("reject").alias(f"reject_{name}")), keys, "left")
    return out.drop("family")


def diebold_mariano(losses: DataFrame, keys: list[str], h: int) -> DataFrame:
    """losses(*keys, ds, e), e the loss difference -> (*keys, n, dm) with the small-sample correction; null if the variance isn't positive.

    p by Student's law with n - 1 degrees of freedom is student_tail(dm, n - 1).
    """
    basic = losses.groupBy(*keys).agg(F.avg("e").alias("mean"))
    g = autocovariances(losses, keys, h - 1)
    lrv = g.groupBy(*keys).agg(F.sum(F.when(F.col("lag") == 0, F.col("g")).otherwise(2 * F.col("g"))).alias("v"), F.max("n").alias("n"))
    n = F.col("n")
    factor = F.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)
    return lrv.join(basic, keys).select(*keys, "n", F.when(F.col("v") > 0, F.col("mean") / F.sqrt(F.col("v") / n) * factor).alias("dm"))


def correlations(errors: DataFrame) -> DataFrame:
    """errors(unique_id, ds, e), complete -> (i, j, r) for i < j; r is null for a series without variance."""
    from tiersum.operators.reconcile import pair_moments

    got = pair_moments(errors.withColumn("origin", F.lit(0)))
    var = got.filter("i = j").select(F.col("i").alias("u"), F.col("sample").alias("var"))
    both = got.filter("i < j").join(var.toDF("i", "vi"), "i").join(var.toDF("j", "vj"), "j")
    return both.select("i", "j", F.try_divide("sample", F.sqrt(F.col("vi") * F.col("vj"))).alias("r"))


def seasonal_differences(series: DataFrame, season: int) -> DataFrame:
    """(unique_id, ds, e): y less y a season before."""
    w = Window.partitionBy("unique_id").orderBy("ds")
    return series.select("unique_id", "ds", (F.col("y") - F.lag("y", season).over(w)).alias("e")).filter("e is not null")


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an md5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(p.cast("string") for p in parts))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
