"""Registered queries: count hierarchies of users' daily events. Items are users, aggregates their groups and the total."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize, scratch_dir
from tiersum.jobs.queries import COUNTS, _items, query, sql_erfc, uniform
from tiersum.operators import counts, inference
from tiersum.sources import raw, views

#: The aggregates' forecasts are means of so many last days.
RECENT = 7
SAMPLES = 100
Z = 1.6448536269514722  # fixed value: the normal law's 95 % point

GAUSS = f"""{COUNTS}, im AS (SELECT CAST(item AS VARCHAR) AS item, sum(k * p) AS mu, sum(k * k * p) - sum(k * p) * sum(k * p) AS var FROM pk GROUP BY 1),
iv AS (SELECT item, mu, var + 1e-9 AS v FROM im), dayk AS (SELECT day, sum(k) AS k FROM g WHERE day < (SELECT max(day) FROM days) GROUP BY 1),
up AS (SELECT (SELECT avg(k) FROM dayk WHERE day >= (SELECT max(day) FROM days) - {RECENT}) AS mu, (SELECT avg(pow(k - m, 2)) FROM dayk, (SELECT avg(k) AS m FROM dayk)) AS w),
st AS (SELECT up.mu, w, w + sv AS s, (up.mu - sm) / (w + sv) AS z, sm FROM up, (SELECT sum(v) AS sv, sum(mu) AS sm FROM iv)),
gd AS (SELECT item AS id, 'item' AS level, iv.mu + v * z AS mu, sqrt(greatest(0, v - v * v / s)) AS sd FROM iv, st UNION ALL SELECT 'T', 'upper', mu - w * z, sqrt(greatest(0, w - w * w / s)) FROM st),
bd AS (SELECT item AS id, 'item' AS level, mu, sqrt(greatest(0, var)) AS sd FROM im)"""


def _items_and_edges(spark, d, groups: bool) -> tuple[DataFrame, DataFrame]:
    """(items(item, grp, pmf, y), edges(upper_id, item)), the aggregates being the total and, if asked for, the groups."""
    items = materialize(_items(spark, d).withColumn("item", F.col("item").cast("string")).withColumn("grp", F.concat(F.lit("G"), F.col("grp").cast("string"))), "items")
    own = [F.lit("T"), F.col("grp")] if groups else [F.lit("T")]
    return items, materialize(items.select(F.explode(F.array(*own)).alias("upper_id"), "item"), "edges")


def _hierarchy(spark, d, groups: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """_items_and_edges, and what is told of the aggregates: (items, upper(id, mu), residuals(id, t, e), edges)."""
    items, edges = _items_and_edges(spark, d, groups)
    events = views.table(spark, d, "events")
    last = events.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    names = [F.lit("T"), F.concat(F.lit("G"), (F.col("item") % 10).cast("string"))] if groups else [F.lit("T")]
    sums = views.user_day_counts(spark, d).select(F.explode(F.array(*names)).alias("id"), "day", "k").groupBy("id", "day").agg(F.sum("k").alias("k"))
    days = last.select(F.explode(F.expr("sequence(a, date_sub(b, 1))")).alias("day"), F.col("b").alias("end"))
    grid = sums.select("id").distinct().join(F.broadcast(days))  # aggregates and days, not items
    known = grid.join(sums, ["id", "day"], "left").select("id", "day", "end", F.coalesce("k", F.lit(0)).alias("k"))
    known = materialize(known, "aggregates")
    upper = known.filter(F.col("day") >= F.date_sub("end", RECENT)).groupBy("id").agg(F.avg("k").alias("mu"))
    means = known.groupBy("id").agg(F.avg("k").alias("m"))
    residuals = known.join(means, "id").select("id", F.date_diff("day", F.lit("2000-01-01").cast("date")).alias("t"), (F.col("k") - F.col("m")).alias("e"))
    return items, materialize(upper, "upper"), materialize(residuals, "residuals"), edges


def _item_moments(items: DataFrame) -> DataFrame:
    return counts.moments(items.select("item", "pmf"), "item").select("item", F.col("mean").alias("mu"), "var")


def _gaussian(spark, d, groups=False):
    items, upper, residuals, edges = _hierarchy(spark, d, groups)
    return items, upper, edges, materialize(counts.gaussian(upper, residuals, _item_moments(items), edges), "gaussian")


@query(f"{GAUSS} SELECT 'gaussian' AS method, id, 'normal' AS kind, round(mu, 6) AS mu, round(sd, 6) AS sd FROM gd")
def c4_gaussian_total(spark, d):
    """The total is the only aggregate."""
    return _gaussian(spark, d)[3]


@query()
def c4_gaussian(spark, d):
    """The total and ten groups."""
    return _gaussian(spark, d, groups=True)[3]


@query(
    f"""{COUNTS}, cr AS (SELECT CAST(item AS VARCHAR) AS item, k, round(cdf, 12) AS cdf, max(k) OVER (PARTITION BY item) AS top FROM cdf), dr AS (SELECT i.item, sample, {uniform("0", "i.item", "sample")} AS u FROM (SELECT DISTINCT item FROM cr) i, range(1, {SAMPLES + 1}) s(sample)),
kk AS (SELECT dr.item, sample, least(count(*) FILTER (cr.cdf <= u), any_value(top)) AS k FROM dr JOIN cr ON cr.item = dr.item GROUP BY 1, 2),
sm AS (SELECT 'T' AS id, sample, sum(k) AS k FROM kk GROUP BY 2 UNION ALL SELECT 'G' || CAST(CAST(item AS BIGINT) % 10 AS VARCHAR), sample, sum(k) FROM kk GROUP BY 1, 2)
SELECT id, CAST(k AS BIGINT) AS k, round(count(*) / {SAMPLES}.0, 6) AS p FROM sm GROUP BY 1, 2"""
)
def c5_bottom_up(spark, d):
    items, edges = _items_and_edges(spark, d, True)
    return counts.exploded(counts.bottom_up(items.select("item", "pmf"), edges, SAMPLES), "id").filter("p > 0").drop("cdf")


def _means(pmfs: DataFrame) -> DataFrame:
    return counts.moments(pmfs, "id").select("id", "mean", "var")


@query()
def c6_mix_cond(spark, d):
    """Moments of the reconciled distributions, and for each aggregate the effective number of the draws that it weighs."""
    items, upper, residuals, edges = _hierarchy(spark, d, True)
    pmfs, ess = counts.mix_cond_by_level(items.select("item", "pmf"), items.select("item", F.col("grp").alias("group")), edges, upper, residuals, 1000)
    return _means(pmfs).join(ess, "id", "left")


_SUMS = "sm AS (SELECT item, sum(k * p) AS mu, sum(k * k * p) - sum(k * p) * sum(k * p) AS var FROM pk GROUP BY 1)"


@query(
    f"""{COUNTS}, {_SUMS}, tops AS (SELECT item, max(k) AS top FROM pk WHERE p > 0 GROUP BY 1), own AS (SELECT 'T' AS id, item FROM sm UNION ALL SELECT 'G' || CAST(item % 10 AS VARCHAR), item FROM sm)
SELECT id, CAST(sum(top) + 1 AS BIGINT) AS size, round(sum(mu), 4) AS mean, round(sum(var), 3) AS var, 1.0 AS mass FROM own JOIN sm USING (item) JOIN tops USING (item) GROUP BY 1""",
    digits=4,
)
def c5_exact_sums(spark, d):
    """The exact distributions of the aggregates: reach, mean, variance and mass."""
    items, edges = _items_and_edges(spark, d, True)
    exact = materialize(counts.exact_sums(items.select("item", "pmf"), edges), "exact")
    mass = exact.select("id", F.size("pmf").alias("size"), F.round(F.aggregate("pmf", F.lit(0.0), lambda a, x: a + x), 4).alias("mass"))
    return mass.join(_means(exact), "id").select("id", "size", "mean", F.round("var", 3).alias("var"), "mass")


@query()
def c7_top_down_cond(spark, d):
    items, upper, residuals, edges = _hierarchy(spark, d, True)
    pmfs, _ = counts.td_cond(items.select("item", "pmf"), items.select("item", F.col("grp").alias("group")), upper, residuals, edges, 200)
    return _means(pmfs)


@query()
def c8_all_methods(spark, d):
    """All distributions in one table: what isn't reconciled, and by four methods."""
    items, upper, residuals, edges = _hierarchy(spark, d, True)
    own = items.select(F.col("item").alias("id"), "pmf")
    pmfs = {"base": own, "bottom_up": own.unionByName(counts.bottom_up(items.select("item", "pmf"), edges, SAMPLES))}
    pmfs["mix_cond"] = counts.mix_cond_by_level(items.select("item", "pmf"), items.select("item", F.col("grp").alias("group")), edges, upper, residuals, 200)[0]
    pmfs["td_cond"] = counts.td_cond(items.select("item", "pmf"), items.select("item", F.col("grp").alias("group")), upper, residuals, edges, 200)[0]
    out = counts.gaussian(upper, residuals, _item_moments(items), edges).withColumn("size", F.lit(None).cast("int"))
    for method, table in pmfs.items():
        out = out.unionByName(counts.as_table(materialize(table, method), method, "id").withColumn("size", F.size("pmf")).drop("pmf"))
    return out


def _both(spark, d):
    """Items before and after Gaussian reconciliation with the total, and their actual values."""
    items, upper, edges, after = _gaussian(spark, d)
    before = counts.as_table(items.select(F.col("item").alias("id"), "pmf"), "base", "id")
    return items, upper, edges, before, after


_MASS = f"CASE WHEN sd = 0 THEN CAST(mu < -0.5 AS INT) WHEN mu >= -0.5 THEN {sql_erfc('(0.5 + mu) / sd / sqrt(2.0)')} / 2 ELSE (2 - {sql_erfc('-(0.5 + mu) / sd / sqrt(2.0)')}) / 2 END"


@query(
    f"""{GAUSS}, r AS (SELECT 'gaussian' AS method, level, mu, mu - {Z} * sd AS lo, {_MASS} AS mass FROM gd UNION ALL SELECT 'base', level, mu, 0, 0 FROM bd)
SELECT method, level, count(*) AS n, count(*) FILTER (mu < 0) AS means, round(count(*) FILTER (mu < 0) / count(*), 6) AS mean_share, count(*) FILTER (lo < 0) AS bounds, round(count(*) FILTER (lo < 0) / count(*), 6) AS bound_share, round(avg(mass), 6) AS below_zero FROM r GROUP BY 1, 2"""
)
def c9_negatives(spark, d):
    _, _, _, before, after = _both(spark, d)
    dists = before.drop("pmf").unionByName(after).withColumn("level", F.when(F.col("id") == "T", "upper").otherwise("item"))
    return counts.negatives(dists, "level")


@query(f"{GAUSS} SELECT 'gaussian' AS method, round(abs((SELECT mu FROM gd WHERE level = 'upper') - (SELECT sum(mu) FROM gd WHERE level = 'item')), 6) AS gap UNION ALL SELECT 'base', round(abs(mu - sm), 6) FROM st")
def c13_mean_incoherence(spark, d):
    _, upper, edges, before, after = _both(spark, d)
    top = upper.select(F.lit("base").alias("method"), "id", "mu")
    return counts.mean_incoherence(before.select("method", "id", "mu").unionByName(top).unionByName(after.select("method", "id", "mu")), edges)


_SCORES = f"""{GAUSS}, ac AS (SELECT CAST(item AS VARCHAR) AS id, item % 10 AS grp, y FROM act), md AS (SELECT CAST(item AS VARCHAR) AS id, min(k) FILTER (cdf >= 0.5 - 1e-12) AS q, min(k) FILTER (cdf >= 0.05 - 1e-12) AS lo, min(k) FILTER (cdf >= 0.95 - 1e-12) AS hi FROM cdf GROUP BY 1),
sb AS (SELECT id, grp, CAST(abs(q - y) AS DOUBLE) AS median_error, hi - lo + 20.0 * greatest(lo - y, 0) + 20.0 * greatest(y - hi, 0) AS mis FROM md JOIN ac USING (id)),
sg AS (SELECT id, grp, abs(mu - y) AS median_error, 2 * {Z} * sd + 20 * greatest(mu - {Z} * sd - y, 0) + 20 * greatest(y - mu - {Z} * sd, 0) AS mis FROM gd JOIN ac USING (id))"""


def _scores(spark, d) -> DataFrame:
    items, _, _, _, after = _both(spark, d)
    y = items.select(F.col("item").alias("id"), F.col("y").cast("double").alias("y"))
    own = counts.item_scores(items.select(F.col("item").alias("id"), "pmf"), y, "id").withColumn("method", F.lit("base"))
    new = counts.normal_scores(after.filter("id <> 'T'").select("id", "mu", "sd"), y, "id").withColumn("method", F.lit("gaussian"))
    both = own.unionByName(new).join(items.select(F.col("item").alias("id"), F.substring("grp", 2, 9).cast("long").alias("grp")), "id")
    return materialize(both, "scores")


@query(
    f"""{_SCORES}, b AS (UNPIVOT sb ON median_error, mis INTO NAME score VALUE s), g2 AS (UNPIVOT sg ON median_error, mis INTO NAME score VALUE s)
SELECT 'gaussian' AS method, b.grp, score, round(avg(CASE WHEN b.s + g2.s = 0 THEN 0 ELSE 200 * (b.s - g2.s) / (b.s + g2.s) END), 4) AS skill FROM b JOIN g2 USING (id, score) GROUP BY 2, 3""",
    digits=4,
)
def c14_skill(spark, d):
    return counts.skill_table(_scores(spark, d), "base", ["id"], ["grp"], ["median_error", "mis"])


@query()
def c14_skill_of_rps(spark, d):
    return counts.skill_table(_scores(spark, d), "base", ["id"], ["grp"], ["rps"])


@query(f"{_SCORES} SELECT round(avg(CASE WHEN sg.mis - sb.mis < -1e-12 THEN 1.0 ELSE 0 END), 6) AS better, round(avg(CASE WHEN sg.mis - sb.mis > 1e-12 THEN 1.0 ELSE 0 END), 6) AS worse, round(median(sg.mis - sb.mis), 6) AS median_difference, count(*) AS n FROM sg JOIN sb USING (id)")
def c15_items_compared(spark, d):
    return counts.compare_items(_scores(spark, d), "gaussian", "base", ["id"], "mis")


@query(f"{GAUSS}, a AS (SELECT id, gd.mu - im.mu AS moved, im.var, gd.mu AS mu, im.mu AS own FROM gd JOIN im ON im.item = gd.id) SELECT round(corr(moved, var), 6) AS moved_with_variance, round(median(CASE WHEN mu < 0 THEN var / nullif(own, 0) END), 6) AS dispersion_of_negative FROM a")
def c15_adjustments(spark, d):
    items, _, _, before, after = _both(spark, d)
    own = before.select("id", F.col("mu").alias("own"), (F.col("sd") * F.col("sd")).alias("var"))
    both = after.join(own, "id")
    return both.agg(F.corr(F.col("mu") - F.col("own"), "var").alias("moved_with_variance"), F.median(F.when(F.col("mu") < 0, F.try_divide("var", "own"))).alias("dispersion_of_negative"))


@query(f"{GAUSS} SELECT 'base' AS method, 0.0 AS share, true AS passed UNION ALL SELECT 'gaussian', round(avg(CASE WHEN mu < 0 THEN 1.0 ELSE 0 END), 6), avg(CASE WHEN mu < 0 THEN 1.0 ELSE 0 END) <= 0 FROM gd WHERE level = 'item'")
def c16_negative_gate(spark, d):
    _, _, _, before, after = _both(spark, d)
    return counts.negative_gate(counts.negatives(before.drop("pmf").unionByName(after.filter("id <> 'T'"))), 0.0)


@query(f"{COUNTS} SELECT CAST(item AS VARCHAR) AS item, 'G' || CAST(item % 10 AS VARCHAR) AS grp, max(k) + 1 AS size, CAST(any_value(y) AS DOUBLE) AS actual FROM pk JOIN act USING (item) GROUP BY item")
def io6_count_tables(spark, d):
    """The count hierarchy written as typed tables and read back."""
    items, upper, residuals, edges = _hierarchy(spark, d, True)
    path = f"{scratch_dir(spark)}/counts"
    actual = items.join(edges, "item").groupBy(F.col("upper_id").alias("id")).agg(F.sum("y").cast("double").alias("actual"))
    tables = {"upper": upper.join(actual, "id").select("id", "mu", "actual"), "upper_resid": residuals.select("id", F.col("t").cast("int").alias("t"), "e"), "bottom": items.select("item", "grp", "pmf", F.col("y").cast("double").alias("actual")), "edges": edges}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return raw.read_counts(spark, path)["bottom"].select("item", "grp", F.size("pmf").alias("size"), "actual")


# scores of all methods, for items and aggregates

METHODS = ["base", "bottom_up", "gaussian", "mix_cond", "td_cond"]


def _actuals(spark, d, items: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, y, q): the last day's counts of items and aggregates and their mean absolute change from day to day before."""
    counted = views.user_day_counts(spark, d).select(F.col("item").cast("string").alias("item"), "day", "k")
    sums = counted.join(edges, "item").groupBy(F.col("upper_id").alias("id"), "day").agg(F.sum("k").alias("k"))
    days = views.table(spark, d, "events").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    q = counts.day_scale(counted.withColumnRenamed("item", "id").unionByName(sums), days)
    own = items.select(F.col("item").alias("id"), F.col("y").cast("double").alias("y"))
    tops = items.join(edges, "item").groupBy(F.col("upper_id").alias("id")).agg(F.sum("y").cast("double").alias("y"))
    return own.unionByName(tops).join(q, "id", "left")


def _normal_uppers(upper: DataFrame, residuals: DataFrame) -> DataFrame:
    """The aggregates' own forecasts with the root mean square of their residuals."""
    sd = residuals.groupBy("id").agg(F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("sd"))
    return upper.join(sd, "id").select(F.lit("base").alias("method"), "id", F.lit("normal").alias("kind"), "mu", "sd", F.lit(None).cast("array<double>").alias("pmf"))


def _two_methods(spark, d):
    items, upper, residuals, edges = _hierarchy(spark, d, False)
    after = counts.gaussian(upper, residuals, _item_moments(items), edges).withColumn("pmf", F.lit(None).cast("array<double>"))
    before = counts.as_table(items.select(F.col("item").alias("id"), "pmf"), "base", "id")
    dists = before.unionByName(_normal_uppers(upper, residuals)).unionByName(after)
    return counts.distribution_scores(materialize(dists, "distributions"), materialize(_actuals(spark, d, items, edges), "actuals"), ["base", "gaussian"]), upper


@query(
    f"""{_SCORES}, lagged AS (SELECT CAST(item AS VARCHAR) AS id, day, k, lag(k) OVER (PARTITION BY item ORDER BY day) AS b FROM g WHERE day < (SELECT max(day) FROM days)), tl AS (SELECT day, k, lag(k) OVER (ORDER BY day) AS b FROM dayk),
q AS (SELECT id, avg(abs(k - b)) AS q FROM lagged WHERE b IS NOT NULL GROUP BY 1 UNION ALL SELECT 'T', avg(abs(k - b)) FROM tl WHERE b IS NOT NULL),
ub AS (SELECT 'base' AS method, up.mu, sqrt(w) AS sd FROM up UNION ALL SELECT 'gaussian', mu, sd FROM gd WHERE id = 'T'), yt AS (SELECT sum(y) AS y FROM act),
su AS (SELECT method, 'T' AS id, abs(mu - y) AS median_error, 2 * {Z} * sd + 20 * greatest(mu - {Z} * sd - y, 0) + 20 * greatest(y - mu - {Z} * sd, 0) AS mis FROM ub, yt),
s AS (SELECT 'base' AS method, 'item' AS level, id, median_error, mis FROM sb UNION ALL SELECT 'gaussian', 'item', id, median_error, mis FROM sg UNION ALL SELECT method, 'upper', id, median_error, mis FROM su)
SELECT method, level, count(*) AS n, round(avg(median_error / nullif(q, 0)), 4) AS mase, round(avg(mis), 4) AS mis FROM s LEFT JOIN q USING (id) GROUP BY 1, 2""",
    digits=4,
)
def c12_level_scores(spark, d):
    scores, upper = _two_methods(spark, d)
    return counts.level_scores(scores, upper).drop("rps")


def _all_methods(spark, d):
    """(distributions by five methods, actual values, aggregates, edges), the aggregates being the total and ten groups."""
    items, upper, residuals, edges = _hierarchy(spark, d, True)
    groups = items.select("item", F.col("grp").alias("group"))
    own, cov = items.select(F.col("item").alias("id"), "pmf"), counts.upper_covariance(residuals)
    mix, _ = counts.mix_cond_by_level(items.select("item", "pmf"), groups, edges, upper, residuals, 1000, covariance=cov)
    td, _ = counts.td_cond(items.select("item", "pmf"), groups, upper, residuals, edges, 1000, covariance=cov)
    made = {"base": own, "bottom_up": own.unionByName(counts.exact_sums(items.select("item", "pmf"), edges)), "mix_cond": mix, "td_cond": td}
    pmfs = materialize(reduce(DataFrame.unionByName, (table.withColumn("method", F.lit(method)) for method, table in made.items())), "pmfs")
    normal = counts.gaussian(upper, residuals, _item_moments(items), edges, cov).withColumn("pmf", F.lit(None).cast("array<double>")).unionByName(_normal_uppers(upper, residuals))
    dists = normal.unionByName(counts.as_tables(pmfs, "id"))
    return materialize(dists, "distributions"), materialize(_actuals(spark, d, items, edges), "actuals"), upper, edges


@query()
def c13_summary(spark, d):
    """Five methods: incoherence of means, negatives, scores of items and aggregates."""
    dists, actuals, upper, edges = _all_methods(spark, d)
    return counts.method_summary(dists, materialize(counts.distribution_scores(dists, actuals, METHODS), "scores"), upper, edges)


@query()
def c14_skill_of_all_methods(spark, d):
    dists, actuals, upper, _ = _all_methods(spark, d)
    scores = counts.distribution_scores(dists, actuals, METHODS).join(upper.select("id", F.lit("upper").alias("level")), "id", "left").withColumn("level", F.coalesce("level", F.lit("item")))
    return counts.skill_table(materialize(scores, "scores"), "base", ["id"], ["level"], ["mase", "mis", "rps"])


@query()
def c15_wilcoxon(spark, d):
    """Ranked probability scores of four methods against the base forecasts, item by item."""
    dists, actuals, upper, _ = _all_methods(spark, d)
    scores = materialize(counts.distribution_scores(dists.join(upper.select("id"), "id", "left_anti"), actuals, METHODS), "scores")
    base = scores.filter("method = 'base'").select("id", F.col("rps").alias("b"))
    pairs = scores.filter("method <> 'base'").join(base, "id").select("method", (F.col("rps") - F.col("b")).alias("d"))
    return inference.paired_test(pairs, ["method"]).select("method", "n", "nonzero", "better", "rank_sum", "p_wilcoxon")


@query(f"{GAUSS} SELECT round(up.mu, 6) AS total, round(st.sm, 6) AS sum_of_means, round(up.mu - st.sm, 6) AS difference, round(up.mu / nullif(st.sm, 0), 6) AS ratio FROM up, st")
def c17_totals(spark, d):
    """The total's own forecast against the sum of the items' means."""
    items, upper, _, _ = _hierarchy(spark, d, False)
    means = _item_moments(items).agg(F.sum("mu").alias("sum_of_means"))
    both = upper.select(F.col("mu").alias("total")).join(F.broadcast(means))
    return both.select("total", "sum_of_means", (F.col("total") - F.col("sum_of_means")).alias("difference"), F.try_divide("total", "sum_of_means").alias("ratio"))
