"""Registered queries: studies, covariance diagnostics, past errors, biases and variances, doctored forecasts, tests with p values, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize
from tiersum.jobs.queries import _BOOT, _LAST, _PAIRS, FORECASTS, LEAVES, LEVEL_WEIGHTS, RESIDUALS, _L, _last_errors, gate_sql, query, sql_erfc, stamp, two_pass, uniform
from tiersum.jobs.study import HORIZON, KEYS, SEASON, STUDIES, Study
from tiersum.operators import backtest, factors, inference, metrics, reconcile, resample
from tiersum.operators.tails import student_tail

# studies

#: LEAVES with the origins of the study "robustness": every month with 36 months before it and six from it on.
MONTHLY = LEAVES.replace(
    "SELECT (SELECT max(ds) FROM leaves) - to_months(CAST(29 - 6 * k AS INTEGER)) AS origin FROM range(5) t(k)",
    "SELECT unnest(generate_series((SELECT min(ds) FROM leaves) + INTERVAL 36 MONTH, (SELECT max(ds) FROM leaves) - INTERVAL 5 MONTH, INTERVAL 1 MONTH)) AS origin",
)
MIN_PAST, WINDOW = 20, 24


@query(f"{MONTHLY} SELECT 'robustness' AS study, {stamp('origin')} AS origin FROM origins UNION ALL SELECT 'start', * FROM (VALUES ('1999-01-01 00:00'), ('2000-01-01 00:00'))")
def b2_named_studies(spark, d):
    series = Study.of(spark, d).series
    return backtest.study_origins(series, STUDIES, "robustness").union(backtest.study_origins(series, STUDIES, "start"))


@query(
    f"""{LEAVES}, f AS (SELECT origin, unique_id, ds, horizon, 'base' AS method, base AS y_hat FROM fc0),
m AS (SELECT origin, unique_id, ds, horizon, 'mean3' AS method, avg(y) AS y_hat FROM past GROUP BY 1, 2, 3, 4 HAVING count(y) = 3),
x AS (SELECT origin, unique_id, ds, horizon, 'external' AS method, 0.97 * naive AS y_hat FROM fc0 WHERE unique_id = 'Total')
SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, horizon, method, round(y_hat, 6) AS y_hat FROM (SELECT * FROM f UNION ALL SELECT * FROM m UNION ALL SELECT * FROM x)"""
)
def b9_with_baselines(spark, d):
    s = Study.of(spark, d)
    mean = backtest.mean_of_seasons(s.series, s.origins, HORIZON, SEASON, 3).select("origin", "unique_id", "ds", F.lit("mean3").alias("method"), "y_hat")
    external = s.base.filter("method = 'naive' and unique_id = 'Total'").select("origin", "unique_id", "ds", F.lit("external").alias("method"), (0.97 * F.col("y_hat")).alias("y_hat"))
    return backtest.with_baselines(s.own().withColumn("method", F.lit("base")).select("origin", "unique_id", "ds", "horizon", "method", "y_hat"), mean, external)


@query(f"{LEAVES} SELECT {stamp('ds')} AS ds, round(max(y) FILTER (unique_id = 'Total'), 6) AS \"Total\", round(max(y) FILTER (unique_id = 'Total/ASIA'), 6) AS \"Total/ASIA\", round(max(y) FILTER (unique_id = 'Total/EUROPE'), 6) AS \"Total/EUROPE\" FROM hier GROUP BY ds")
def b14_wide(spark, d):
    return backtest.wide(Study.of(spark, d).series, ["ds"], ["Total", "Total/ASIA", "Total/EUROPE"])


# covariances


@query()
def r4_weight_diagnostics(spark, d):
    return factors.weight_diagnostics(Study.of(spark, d).residuals())


@query()
def r4_study_medians(spark, d):
    """Median intensity and condition over the origins of two studies."""
    out = None
    for name in ("robustness", "seasonal"):
        own = factors.weight_diagnostics(Study.of(spark, d, name).residuals())
        part = own.agg(F.lit(name).alias("study"), F.count("*").alias("origins"), F.median("intensity").alias("intensity"), F.median("cond_w").alias("cond_w"), F.median("rank_w1").alias("rank_w1"))
        out = part if out is None else out.union(part)
    return out


@query(
    f"""{RESIDUALS}, per AS (SELECT origin, unique_id, count(e) AS t, stddev_pop(e) AS sd FROM resid GROUP BY 1, 2), g AS (SELECT origin, min(t) AS t, min(sd) AS sd, count(*) AS m FROM per GROUP BY 1),
r AS (SELECT origin, CASE WHEN t < 20 THEN 'few residuals' WHEN m > t THEN 'more series than residuals' WHEN sd <= 0 THEN 'a series without variance' ELSE 'ok' END AS reason FROM g)
SELECT {stamp('origin')} AS origin, CASE WHEN reason = 'ok' THEN 'mint_shrink' ELSE 'wls_struct' END AS method, reason FROM r"""
)
def r5_choose_by_size(spark, d):
    return reconcile.choose_method(Study.of(spark, d).residuals(), 20, more_series=True)


@query()
def r5_choose_by_condition(spark, d):
    s = Study.of(spark, d)
    residuals = s.residuals()
    condition = factors.weight_diagnostics(residuals)
    return reconcile.choose_method(residuals, 20, condition=condition)


@query(
    f"""{RESIDUALS}, var AS (SELECT origin, unique_id, var_samp(e) AS v FROM resid GROUP BY 1, 2), src AS (SELECT fc0.*, var.v FROM fc0 JOIN var ON var.origin = fc0.origin AND var.unique_id = fc0.unique_id WHERE v > 0),{two_pass("pe", "f.v", "src")}
SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, horizon, round(mu, 5) AS y_hat FROM pe""",
    digits=5,
)
def r7_wls_var(spark, d):
    """Weights: variances of the fitted residuals; origins of which a series has none are left out by the tree's joins."""
    s = Study.of(spark, d)
    variances = s.residuals().groupBy("origin", "unique_id").agg(F.var_samp("e").alias("v")).filter("v > 0")
    return reconcile.tree_least_squares(s.own(), s.nodes, variances, len(KEYS)).select("origin", "unique_id", "ds", "horizon", "y_hat")


def _past_sql(window: int | None) -> str:
    within = f" WHERE k <= {window}" if window else ""
    return f"""{MONTHLY}, err AS (SELECT fc0.origin, fc0.unique_id, fc0.ds, y - base AS e FROM fc0 JOIN hier ON hier.unique_id = fc0.unique_id AND hier.ds = fc0.ds),
fin AS (SELECT a.origin, b.origin AS past, count(*) OVER (PARTITION BY a.origin) AS n, row_number() OVER (PARTITION BY a.origin ORDER BY b.origin DESC) AS k FROM origins a JOIN origins b ON b.origin + INTERVAL 6 MONTH <= a.origin),
kept AS (SELECT origin, past FROM (SELECT * FROM fin WHERE n >= {MIN_PAST}){within}),
pv AS (SELECT kept.origin, unique_id, var_samp(e) AS v FROM kept JOIN err ON err.origin = kept.past GROUP BY 1, 2),
src AS (SELECT fc0.*, pv.v FROM fc0 JOIN pv ON pv.origin = fc0.origin AND pv.unique_id = fc0.unique_id WHERE v > 0),{two_pass("pe", "f.v", "src")}
SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, horizon, round(mu, 5) AS y_hat FROM pe"""


def _past_variances(spark, d, window):
    s = Study.of(spark, d, "robustness")
    variances = backtest.past_error_variances(s.own_errors(), s.origins, HORIZON, MIN_PAST, window).filter("v > 0")
    return reconcile.tree_least_squares(s.own(), s.nodes, variances, len(KEYS)).select("origin", "unique_id", "ds", "horizon", "y_hat")


@query(_past_sql(None), digits=5)
def r9_past_errors_diagonal(spark, d):
    """All finished origins of monthly ones, 20 at least."""
    return _past_variances(spark, d, None)


@query(_past_sql(WINDOW), digits=5)
def r9_past_errors_window(spark, d):
    return _past_variances(spark, d, WINDOW)


@query()
def r9_past_errors_full(spark, d):
    s = Study.of(spark, d, "robustness")
    return s.past_error_trace(MIN_PAST)


@query()
def r10_all_methods(spark, d):
    s = Study.of(spark, d)
    return metrics.by_level(metrics.mase(s.all_methods(2), s.scales(), s.nodes))


@query(
    f"""{LEAVES}, cases AS (SELECT c.unique_id AS kase, n.unique_id, CASE WHEN c.unique_id = n.unique_id THEN 15.0 ELSE 0 END AS base FROM nodes n CROSS JOIN (SELECT unique_id FROM nodes WHERE level < 2) c),
src AS (SELECT kase AS origin, 0 AS ds, 0 AS horizon, unique_id, base FROM cases),{two_pass("pe", "1.0 + 8 * (n.level > 0)::INT", "src")}
SELECT origin AS "case", unique_id, round(mu, 6) AS bias FROM pe"""
)
def r11_bias_allocation(spark, d):
    """Where a bias of 15 of each aggregate goes, the total's variance being 1 and all others' 9."""
    s = Study.of(spark, d)
    tops = s.nodes.filter("level < 2").select(F.col("unique_id").alias("case"))
    bias = s.nodes.select("unique_id").join(F.broadcast(tops), how="cross").select("case", "unique_id", F.when(F.col("case") == F.col("unique_id"), 15.0).otherwise(0.0).alias("bias"))
    return reconcile.allocate_bias(bias, s.nodes, s.nodes.select("unique_id", F.when(F.col("level") == 0, 1.0).otherwise(9.0).alias("v")), len(KEYS))


GRID = (0.25, 1.0, 9.0, 81.0)


@query(
    f"""{LEAVES}, src AS (SELECT 'Total' AS origin, w AS ds, 0 AS horizon, unique_id, CASE WHEN level = 0 THEN 1.0 ELSE 0 END AS base FROM nodes, (VALUES {", ".join(f"({w})" for w in GRID)}) g(w)),{two_pass("pe", "CASE WHEN n.level = 0 THEN CAST(f.ds AS DOUBLE) ELSE 9.0 END", "src")}
SELECT CAST(ds AS DOUBLE) AS w_total, unique_id, round(mu, 6) AS bias FROM pe"""
)
def r11_bias_over_total_weights(spark, d):
    """Where a bias of 1 of the total goes, for a grid of its own variance, all others' being 9."""
    s = Study.of(spark, d)
    bias = s.nodes.select(F.lit("Total").alias("case"), "unique_id", (F.col("level") == 0).cast("double").alias("bias"))
    out = None
    for w in GRID:
        part = reconcile.allocate_bias(bias, s.nodes, s.nodes.select("unique_id", F.when(F.col("level") == 0, w).otherwise(9.0).alias("v")), len(KEYS))
        part = part.select(F.lit(w).alias("w_total"), "unique_id", "bias")
        out = part if out is None else out.union(part)
    return out


@query(
    f"""{LEAVES}, c2 AS (SELECT unique_id, parent, 1.0 AS var FROM nodes WHERE level = 2), s1 AS (SELECT parent AS unique_id, sum(var) AS cvar FROM c2 GROUP BY 1),
c1 AS (SELECT n.unique_id, n.parent, 1.0 * n_leaves * cvar / (n_leaves + cvar) AS var FROM nodes n JOIN s1 USING (unique_id) WHERE level = 1), s0 AS (SELECT parent AS unique_id, sum(var) AS cvar FROM c1 GROUP BY 1),
c0 AS (SELECT n.unique_id, 1.0 * n_leaves * cvar / (n_leaves + cvar) AS v FROM nodes n JOIN s0 USING (unique_id) WHERE level = 0),
d1 AS (SELECT c1.unique_id, var - var * var / cvar + pow(var / cvar, 2) * v AS v FROM c1 JOIN s0 ON s0.unique_id = c1.parent JOIN c0 ON c0.unique_id = c1.parent),
d2 AS (SELECT c2.unique_id, var - var * var / cvar + pow(var / cvar, 2) * v AS v FROM c2 JOIN s1 ON s1.unique_id = c2.parent JOIN d1 ON d1.unique_id = c2.parent)
SELECT unique_id, CAST(n_leaves AS DOUBLE) AS v_base, round(v, 6) AS v FROM (SELECT * FROM c0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2) JOIN nodes USING (unique_id)"""
)
def r15_reconciled_variance(spark, d):
    s = Study.of(spark, d)
    return reconcile.reconciled_variance(s.nodes, s.nodes.select("unique_id", F.col("n_leaves").cast("double").alias("v")), len(KEYS))


@query(
    f"""{RESIDUALS}, mine AS (SELECT * FROM resid WHERE origin = (SELECT max(origin) FROM origins)),
k AS (SELECT ds, row_number() OVER (ORDER BY ds) AS t FROM (SELECT DISTINCT ds FROM mine)), p AS (SELECT a.unique_id AS i, b.unique_id AS j, t, a.e * b.e AS x, a.e * a.e AS xi, b.e * b.e AS xj FROM mine a JOIN mine b ON b.ds = a.ds AND a.unique_id < b.unique_id JOIN k ON k.ds = a.ds),
c AS (SELECT t, sum(x) OVER w / t AS sx, sum(x * x) OVER w / t AS sxx, sum(xi) OVER w / t AS si, sum(xj) OVER w / t AS sj FROM p WINDOW w AS (PARTITION BY i, j ORDER BY t)),
v AS (SELECT t, sum(t * (sxx - sx * sx) / (si * sj)) AS over, sum(sx * sx / (si * sj)) AS under FROM c WHERE si * sj > 0 GROUP BY 1)
SELECT CAST(t AS BIGINT) AS t, round(greatest(0, least(1, t * over / (pow(t - 1, 3) * under))), 6) AS intensity FROM v WHERE t >= 2"""
)
def r16_expanding_shrinkage(spark, d):
    errors = _last_errors(spark, d).withColumn("origin", F.lit(0))
    return factors.expanding_shrinkage(errors).select("t", "intensity")


@query()
def r16_expanding_conditions(spark, d):
    """Condition and rank from the first t residuals of the last origin, for every t."""
    return factors.weight_diagnostics(_last_errors(spark, d).withColumn("origin", F.lit(0)), least=2).drop("origin")


@query()
def r8_factor_form(spark, d):
    """r8_minimum_trace without a matrix of series."""
    s = Study.of(spark, d)
    residuals = materialize(s.residuals(), "residuals")
    own = s.own().join(residuals.select("origin").distinct(), "origin", "left_semi")
    return factors.minimum_trace(own, s.nodes, residuals, factors.shrinkage(residuals), len(KEYS))


@query(
    f"""{FORECASTS}, s AS (SELECT f.origin, f.method, f.ds, e.unique_id, sum(y_hat) AS s FROM fc f JOIN edges e ON e.leaf_id = f.unique_id GROUP BY 1, 2, 3, 4),
g AS (SELECT f.origin, f.method, max(abs(y_hat - s)) AS gap FROM fc f JOIN s ON s.origin = f.origin AND s.method = f.method AND s.ds = f.ds AND s.unique_id = f.unique_id GROUP BY 1, 2)
SELECT {stamp('origin')} AS origin, method, round(gap, 6) AS gap, 0 AS bad, 0 AS missing FROM g WHERE gap > 1e-6"""
)
def g2_coherence_violations(spark, d):
    s = Study.of(spark, d)
    return metrics.coherence_violations(s.reconciled(), s.edges)


@query("SELECT \"check\", 0.0 AS error FROM (VALUES ('unbiased'), ('idempotent'), ('left_inverse')) v(\"check\")", digits=9)
def g3_projection_errors(spark, d):
    s = Study.of(spark, d)
    variance = s.nodes.select("unique_id", F.col("n_leaves").cast("double").alias("v"))
    return reconcile.projection_errors(reconcile.projection(s.nodes, variance, len(KEYS)), s.edges)


@query(
    f"""{LEAVES}, src AS (SELECT c.unique_id AS origin, 0 AS ds, 0 AS horizon, n.unique_id, CASE WHEN c.unique_id = n.unique_id THEN 1.0 ELSE 0 END AS base FROM nodes n CROSS JOIN nodes c),{two_pass("pe", "CAST(n.n_leaves AS DOUBLE)", "src")},
p AS (SELECT origin AS i, unique_id AS o, mu + CASE WHEN unique_id = 'Total' AND origin = (SELECT min(unique_id) FROM nodes WHERE level = 2) THEN 0.5 ELSE 0 END AS p FROM pe),
ps AS (SELECT o, leaf_id, sum(p) AS v FROM p JOIN edges e ON e.unique_id = i GROUP BY 1, 2), l AS (SELECT ps.o, ps.leaf_id, abs(v - CASE WHEN e.leaf_id IS NULL THEN 0 ELSE 1 END) AS gap FROM ps LEFT JOIN edges e ON e.unique_id = ps.o AND e.leaf_id = ps.leaf_id),
pp AS (SELECT a.i, b.o, sum(a.p * b.p) AS v FROM p a JOIN p b ON b.i = a.o GROUP BY 1, 2)
SELECT 'unbiased' AS "check", round(max(gap), 6) AS error FROM l UNION ALL SELECT 'idempotent', round(max(abs(v - p.p)), 6) FROM pp JOIN p USING (i, o) UNION ALL SELECT 'left_inverse', round(max(gap), 6) + 0.0 FROM l WHERE o IN (SELECT unique_id FROM nodes WHERE level = 2)"""
)
def g3_errors_of_a_wrong_projection(spark, d):
    """A projection in which half of one leaf's forecast is added to the total."""
    s = Study.of(spark, d)
    p = materialize(reconcile.projection(s.nodes, s.nodes.select("unique_id", F.col("n_leaves").cast("double").alias("v")), len(KEYS)), "projection")
    leaf = s.nodes.filter("level = 2").agg(F.min("unique_id").alias("leaf"))
    wrong = p.join(F.broadcast(leaf)).select("in_id", "out_id", (F.col("p") + F.when((F.col("out_id") == "Total") & (F.col("in_id") == F.col("leaf")), 0.5).otherwise(0.0)).alias("p"))
    return reconcile.projection_errors(wrong, s.edges)


# the gate on forecasts with faults

_LEAF = "(SELECT min(unique_id) FROM nodes WHERE level = 2)"
_DOCTORED = f"""{FORECASTS}, own AS (SELECT * FROM fc WHERE method = 'wls_struct'),
doc AS (SELECT origin, unique_id, ds, 'bu' AS method, y_hat, y, level FROM fc WHERE method = 'bu' UNION ALL SELECT origin, unique_id, ds, 'sound', y_hat, y, level FROM own
  UNION ALL SELECT origin, unique_id, ds, 'nan', CASE WHEN level = 0 THEN 'nan'::DOUBLE ELSE y_hat END, y, level FROM own UNION ALL SELECT origin, unique_id, ds, 'no_leaf', y_hat, y, level FROM own WHERE unique_id <> {_LEAF}
  UNION ALL SELECT origin, unique_id, ds, 'gap', CASE WHEN level = 0 THEN y_hat + 1 ELSE y_hat END, y, level FROM own UNION ALL SELECT origin, unique_id, ds, 'negative', -y_hat, y, level FROM own UNION ALL SELECT origin, unique_id, ds, 'worse', 3 * y_hat, y, level FROM own),
dm AS (SELECT f.origin, f.level, f.unique_id, f.method, avg(abs(f.y - f.y_hat)) / nullif(any_value(s.scale), 0) AS mase FROM doc f LEFT JOIN scales s ON s.origin = f.origin AND s.unique_id = f.unique_id GROUP BY 1, 2, 3, 4),
dl AS (SELECT origin, level, method, avg(mase) AS mase FROM dm WHERE mase IS NOT NULL GROUP BY 1, 2, 3){gate_sql("doc", "dl")}"""


def doctored(forecasts: DataFrame, nodes: DataFrame) -> DataFrame:
    """forecasts of 'bu' and 'wls_struct' -> the former, the latter as 'sound', and five copies of it with a fault each."""
    own = forecasts.filter("method = 'wls_struct'").join(nodes.select("unique_id", "level"), "unique_id")
    leaf = nodes.filter("level = 2").agg(F.min("unique_id").alias("leaf"))
    total, y = F.col("level") == 0, F.col("y_hat")
    faults = {"sound": y, "nan": F.when(total, float("nan")).otherwise(y), "no_leaf": y, "gap": F.when(total, y + 1).otherwise(y), "negative": -y, "worse": 3 * y}
    rows = own.withColumn("f", F.explode(F.array(*(F.struct(F.lit(k).alias("method"), v.alias("y_hat")) for k, v in faults.items()))))
    rows = rows.join(F.broadcast(leaf)).filter("not (f.method = 'no_leaf' and unique_id = leaf)")
    return forecasts.filter("method = 'bu'").unionByName(rows.select("origin", "unique_id", "ds", "horizon", "f.method", "f.y_hat", "y"))


def _doctored_gate(spark, d):
    s = Study.of(spark, d)
    forecasts = materialize(doctored(s.reconciled(), s.nodes), "doctored")
    return metrics.gate(forecasts, s.edges, metrics.by_level(metrics.mase(forecasts, s.scales(), s.nodes)), "bu", weights=LEVEL_WEIGHTS)


@query(f'{_DOCTORED} SELECT method, "check", value, passed, blocking FROM gate')
def g5_gate_on_faults(spark, d):
    return _doctored_gate(spark, d)


@query(f"{_DOCTORED} SELECT method, bool_and(passed) AS passed FROM gate WHERE blocking GROUP BY 1 UNION ALL SELECT 'absent', false")
def g7_verdict(spark, d):
    checks = _doctored_gate(spark, d)
    return metrics.verdict(checks, checks.select("method").union(spark.sql("select 'absent' as method")))


# tests


def _level_differences(spark, d, name=None):
    levels = Study.of(spark, d, name).levels()
    both = metrics._against(levels, "bu", "origin", "level").filter(F.col("method").isin("ols", "wls_struct"))
    return both.withColumn("d", F.col("mase") - F.col("ref"))


@query()
def t6_paired_p(spark, d):
    return inference.paired_test(_level_differences(spark, d, "robustness").select("level", "method", "d"), ["level", "method"])


@query()
def t7_diebold_mariano_p(spark, d):
    from tiersum.jobs import queries

    dm = queries.t7_diebold_mariano(spark, d)
    return dm.withColumn("p", student_tail("dm", (F.col("n") - 1).cast("double")))


@query()
def t8_against_reference(spark, d):
    """39 monthly origins, all levels and methods in one family."""
    return inference.against_reference(_level_differences(spark, d, "robustness"), ["level", "method"])


@query()
def t9_series_p(spark, d):
    s = Study.of(spark, d, "robustness")
    rows = metrics.mase(s.reconciled(), s.scales(), s.nodes)
    ref = rows.filter("method = 'base'").select("origin", "unique_id", F.col("mase").alias("ref"))
    d = rows.filter("method = 'wls_struct'").join(ref, ["origin", "unique_id"]).select("unique_id", (F.col("mase") - F.col("ref")).alias("d"))
    got = inference.paired_test(d, ["unique_id"]).select(F.lit("all").alias("family"), "unique_id", "n", "mean", "better", "p_wilcoxon", F.col("p_wilcoxon").alias("p"))
    return inference.holm(got.filter("p is not null"), ["family"], ["unique_id"]).drop("p")


@query(
    f"""{LEAVES}, err AS (SELECT fc0.origin, fc0.unique_id, fc0.ds, y - base AS e FROM fc0 JOIN hier ON hier.unique_id = fc0.unique_id AND hier.ds = fc0.ds AND level = 2),
s AS (SELECT a.origin, a.unique_id AS i, b.unique_id AS j, count(*) AS n, sum(a.e) AS sx, sum(b.e) AS sy, sum(a.e * b.e) AS sxy, sum(a.e * a.e) AS qx, sum(b.e * b.e) AS qy FROM err a JOIN err b ON b.origin = a.origin AND b.ds = a.ds AND a.unique_id < b.unique_id GROUP BY 1, 2, 3),
o AS (SELECT origin, row_number() OVER (ORDER BY origin) - 1 AS pick, count(*) OVER () AS n FROM (SELECT DISTINCT origin FROM err)),
dr AS (SELECT rep, CAST(floor({uniform("0", "rep", "slot")} * 5) AS BIGINT) AS pick FROM range(1, 201) a(rep), range(1, 6) b(slot) UNION ALL SELECT 0, * FROM range(5)),
t AS (SELECT rep, i, j, sum(s.n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxy) AS sxy, sum(qx) AS qx, sum(qy) AS qy FROM dr JOIN o USING (pick) JOIN s ON s.origin = o.origin GROUP BY 1, 2, 3),
m AS (SELECT rep, avg((sxy - sx * sy / n) / nullif(sqrt(greatest(0, qx - sx * sx / n) * greatest(0, qy - sy * sy / n)), 0)) AS m FROM t GROUP BY 1)
SELECT round(max(m) FILTER (rep = 0), 6) AS mean, round(quantile_cont(CASE WHEN rep > 0 THEN m END, 0.05), 6) AS low, round(quantile_cont(CASE WHEN rep > 0 THEN m END, 0.95), 6) AS high FROM m"""
)
def t11_correlation_interval(spark, d):
    s = Study.of(spark, d)
    leaf = s.nodes.filter(F.col("level") == len(KEYS)).select("unique_id")
    return resample.correlation_interval(s.own_errors().join(leaf, "unique_id", "left_semi"))


@query(
    f"""{LEAVES}, dif AS (SELECT unique_id, ds, y - lag(y, 12) OVER (PARTITION BY unique_id ORDER BY ds) AS e FROM hier WHERE level = 1)
SELECT a.unique_id AS i, b.unique_id AS j, round(corr(a.e, b.e), 6) AS r FROM dif a JOIN dif b ON b.ds = a.ds AND a.unique_id < b.unique_id WHERE a.e IS NOT NULL AND b.e IS NOT NULL GROUP BY 1, 2"""
)
def t10_seasonal_correlations(spark, d):
    return inference.correlations(inference.seasonal_differences(Study.of(spark, d).series.filter("level = 1"), SEASON))


# resampling


@query(
    f"""{FORECASTS}, pr AS (SELECT level, origin, mase, ref, rep, {uniform("0", "rep", "strftime(origin, '%Y-%m-%d %H:%M')")} AS u FROM paired, range(1, 201) a(rep) WHERE method = 'wls_struct'),
run AS (SELECT level, count(*) OVER w AS k, 1 - sum(mase) OVER w / nullif(sum(ref) OVER w, 0) AS gain FROM pr WINDOW w AS (PARTITION BY level, rep ORDER BY u, origin)),
b AS (SELECT level, k, quantile_cont(gain, 0.05) AS low, quantile_cont(gain, 0.5) AS middle, quantile_cont(gain, 0.95) AS high FROM run GROUP BY 1, 2)
SELECT {_L}, k, round(low, 6) + 0.0 AS low, round(middle, 6) + 0.0 AS middle, round(high, 6) + 0.0 AS high, low > 0 OR high < 0 AS apart FROM b"""
)
def m12_gain_bands(spark, d):
    return resample.gain_bands(Study.of(spark, d).levels(), "wls_struct", "bu")


@query(
    f"""{FORECASTS}, pr AS (SELECT level, origin, mase, ref, rep, {uniform("0", "rep", "strftime(origin, '%Y-%m-%d %H:%M')")} AS u FROM paired, range(1, 201) a(rep) WHERE method = 'wls_struct'),
run AS (SELECT level, count(*) OVER w AS k, 1 - sum(mase) OVER w / nullif(sum(ref) OVER w, 0) AS gain FROM pr WINDOW w AS (PARTITION BY level, rep ORDER BY u, origin)),
b AS (SELECT level, k, quantile_cont(gain, 0.05) AS low, quantile_cont(gain, 0.95) AS high FROM run GROUP BY 1, 2)
SELECT {_L}, min(k) FILTER (low > 0 OR high < 0) AS k FROM b GROUP BY level"""
)
def m12_first_apart(spark, d):
    return metrics.first_apart(resample.gain_bands(Study.of(spark, d).levels(), "wls_struct", "bu"))


@query(
    f"""{RESIDUALS}, inst AS (SELECT origin, ds, row_number() OVER (PARTITION BY origin ORDER BY ds) - 1 AS pick, count(*) OVER (PARTITION BY origin) AS n FROM (SELECT DISTINCT origin, ds FROM resid)),
dr AS (SELECT i.origin, rep, l.leaf_id, CAST(floor({uniform("0", "rep", "l.leaf_id")} * n) AS BIGINT) AS pick FROM (SELECT DISTINCT origin, n FROM inst) i, range(1, 102) a(rep), (SELECT DISTINCT leaf_id FROM edges) l),
sh AS (SELECT d.origin, d.rep, r.unique_id, r.e FROM dr d JOIN inst i ON i.origin = d.origin AND i.pick = d.pick JOIN resid r ON r.origin = d.origin AND r.ds = i.ds AND r.unique_id = d.leaf_id),
sm AS (SELECT f.origin, f.ds, s.rep, e.unique_id, sum(f.base + s.e) AS v FROM fc0 f JOIN sh s ON s.origin = f.origin AND s.unique_id = f.unique_id JOIN edges e ON e.leaf_id = f.unique_id GROUP BY 1, 2, 3, 4)
SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, round(quantile_cont(v, 0.9), 5) AS q_hat FROM sm GROUP BY origin, unique_id, ds""",
    digits=5,
)
def r12_independent_bootstrap(spark, d):
    s = Study.of(spark, d)
    return resample.joint_bootstrap_quantiles(s.own(), s.residuals(), s.edges, 0.9, independent=True)


@query(
    f"""{_BOOT.split("sm AS")[0].rstrip().rstrip(",")}, src AS (SELECT f.origin, f.ds, s.rep AS horizon, f.unique_id, f.base + s.e AS base FROM fc0 f JOIN sh s ON s.origin = f.origin AND s.unique_id = f.unique_id),
{two_pass("pj", "CAST(n.n_leaves AS DOUBLE)", "src").lstrip()}
SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, round(quantile_cont(mu, 0.9), 3) AS q_hat FROM pj GROUP BY origin, unique_id, ds""",
    digits=3,
)
def r12_projected_bootstrap(spark, d):
    s = Study.of(spark, d)
    weights = s.nodes.select("unique_id", F.col("n_leaves").cast("double").alias("v"))
    return resample.projected_bootstrap_quantiles(s.own(), s.residuals(), s.nodes, weights, len(KEYS), 0.9)
