"""Registered queries of the reconciliation operators, over whole tables, each with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize
from tiersum.jobs.study import HORIZON, KEYS, SEASON, Study
from tiersum.operators import backtest, clean, counts, factors, hierarchy, inference, metrics, reconcile, resample
from tiersum.operators.tails import ERFC
from tiersum.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def settled(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers as long, times as text: values that any engine gives alike."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint", "bigint"):
            c = c.cast("long")
        elif kind.startswith("timestamp") or kind == "date":
            c = F.date_format(c, "yyyy-MM-dd HH:mm")
        out.append(c.alias(name))
    return df.select(*out)


def query(sql: str | None = None, name: str | None = None, digits: int = 6):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: settled(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return register


def stamp(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M')"


LEAVES = """WITH raw AS (SELECT r_name AS region, n_name AS nation, date_trunc('month', o_orderdate) AS ds, round(sum(o_totalprice) / 1000, 5) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
months AS (SELECT unnest(generate_series((SELECT min(ds) FROM raw), (SELECT max(ds) FROM raw), INTERVAL 1 MONTH)) AS ds),
leaves AS (SELECT k.region, k.nation, m.ds, coalesce(raw.y, 0) AS y FROM (SELECT DISTINCT region, nation FROM raw) k CROSS JOIN months m LEFT JOIN raw ON raw.region = k.region AND raw.nation = k.nation AND raw.ds = m.ds),
hier AS (SELECT 0 AS level, 'Total' AS unique_id, ds, sum(y) AS y FROM leaves GROUP BY ds
  UNION ALL SELECT 1, 'Total/' || region, ds, sum(y) FROM leaves GROUP BY region, ds
  UNION ALL SELECT 2, 'Total/' || region || '/' || nation, ds, y FROM leaves),
nodes AS (SELECT 0 AS level, 'Total' AS unique_id, NULL AS parent, count(*) AS n_leaves FROM (SELECT DISTINCT region, nation FROM leaves)
  UNION ALL SELECT 1, 'Total/' || region, 'Total', count(*) FROM (SELECT DISTINCT region, nation FROM leaves) GROUP BY region
  UNION ALL SELECT DISTINCT 2, 'Total/' || region || '/' || nation, 'Total/' || region, 1 FROM leaves),
edges AS (SELECT leaf.unique_id AS leaf_id, up.unique_id, up.level FROM nodes leaf JOIN nodes up ON leaf.level = 2 AND (up.unique_id = leaf.unique_id OR up.unique_id = leaf.parent OR up.level = 0)),
origins AS (SELECT (SELECT max(ds) FROM leaves) - to_months(CAST(29 - 6 * k AS INTEGER)) AS origin FROM range(5) t(k)),
past AS (SELECT origin, unique_id, origin + to_months(CAST(h - 1 AS INTEGER)) AS ds, h AS horizon, b AS back, y FROM origins, range(1, 7) t(h), range(1, 4) r(b), hier WHERE hier.ds = origin + to_months(CAST(h - 1 - 12 * b AS INTEGER))),
fc0 AS (SELECT origin, unique_id, ds, horizon, median(y) AS base, arg_min(y, back) AS naive FROM past GROUP BY 1, 2, 3, 4)"""


def two_pass(tag: str, v: str, source: str = "fc0") -> str:
    """The tree's least squares for three levels; v: a node's variance."""
    at = "f.origin, f.ds, f.horizon, f.unique_id, n.parent"
    same = "s.origin = f.origin AND s.ds = f.ds AND s.horizon = f.horizon AND s.unique_id = f.unique_id"
    combine = f"1 / (1 / ({v}) + 1 / s.cvar) AS var, (f.base / ({v}) + s.cmu / s.cvar) / (1 / ({v}) + 1 / s.cvar) AS mu"
    return f"""
{tag}2 AS (SELECT {at}, f.base AS mu, ({v}) AS var FROM {source} f JOIN nodes n ON n.unique_id = f.unique_id AND n.level = 2),
{tag}s1 AS (SELECT origin, ds, horizon, parent AS unique_id, sum(mu) AS cmu, sum(var) AS cvar FROM {tag}2 GROUP BY 1, 2, 3, 4),
{tag}1 AS (SELECT {at}, {combine} FROM {source} f JOIN nodes n ON n.unique_id = f.unique_id AND n.level = 1 JOIN {tag}s1 s ON {same}),
{tag}s0 AS (SELECT origin, ds, horizon, parent AS unique_id, sum(mu) AS cmu, sum(var) AS cvar FROM {tag}1 GROUP BY 1, 2, 3, 4),
{tag}d0 AS (SELECT {at}, {combine} FROM {source} f JOIN nodes n ON n.unique_id = f.unique_id AND n.level = 0 JOIN {tag}s0 s ON {same}),
{tag}d1 AS (SELECT c.origin, c.ds, c.horizon, c.unique_id, c.mu + c.var / s.cvar * (p.mu - s.cmu) AS mu FROM {tag}1 c JOIN {tag}d0 p ON p.origin = c.origin AND p.ds = c.ds AND p.horizon = c.horizon AND p.unique_id = c.parent JOIN {tag}s0 s ON s.origin = c.origin AND s.ds = c.ds AND s.horizon = c.horizon AND s.unique_id = c.parent),
{tag}d2 AS (SELECT c.origin, c.ds, c.horizon, c.unique_id, c.mu + c.var / s.cvar * (p.mu - s.cmu) AS mu FROM {tag}2 c JOIN {tag}d1 p ON p.origin = c.origin AND p.ds = c.ds AND p.horizon = c.horizon AND p.unique_id = c.parent JOIN {tag}s1 s ON s.origin = c.origin AND s.ds = c.ds AND s.horizon = c.horizon AND s.unique_id = c.parent),
{tag} AS (SELECT origin, ds, horizon, unique_id, mu FROM {tag}d0 UNION ALL SELECT * FROM {tag}d1 UNION ALL SELECT * FROM {tag}d2)"""


FORECASTS = f"""{LEAVES},{two_pass("ols", "1.0")},{two_pass("wls", "CAST(n.n_leaves AS DOUBLE)")},
fc1 AS (SELECT origin, unique_id, ds, horizon, 'base' AS method, base AS y_hat FROM fc0 UNION ALL SELECT origin, unique_id, ds, horizon, 'naive', naive FROM fc0
  UNION ALL SELECT f.origin, e.unique_id, f.ds, f.horizon, 'bu', sum(f.base) FROM fc0 f JOIN edges e ON e.leaf_id = f.unique_id GROUP BY 1, 2, 3, 4
  UNION ALL SELECT origin, unique_id, ds, horizon, 'ols', mu FROM ols UNION ALL SELECT origin, unique_id, ds, horizon, 'wls_struct', mu FROM wls),
fc AS (SELECT fc1.*, hier.y, hier.level FROM fc1 JOIN hier ON hier.unique_id = fc1.unique_id AND hier.ds = fc1.ds),
diffs AS (SELECT unique_id, ds, abs(y - lag(y, 12) OVER (PARTITION BY unique_id ORDER BY ds)) AS d FROM hier),
scales AS (SELECT origin, unique_id, avg(d) AS scale FROM diffs JOIN origins ON ds < origin WHERE d IS NOT NULL GROUP BY 1, 2),
mase AS (SELECT f.origin, f.level, f.unique_id, f.method, avg(abs(f.y - f.y_hat)) / nullif(any_value(s.scale), 0) AS mase FROM fc f LEFT JOIN scales s ON s.origin = f.origin AND s.unique_id = f.unique_id GROUP BY 1, 2, 3, 4),
levels AS (SELECT origin, level, method, avg(mase) AS mase FROM mase WHERE mase IS NOT NULL GROUP BY 1, 2, 3),
paired AS (SELECT l.*, r.mase AS ref FROM levels l JOIN levels r ON r.origin = l.origin AND r.level = l.level AND r.method = 'bu')"""

RESIDUALS = f"""{LEAVES},
lags AS (SELECT unique_id, ds, y, lag(y, 12) OVER w AS a, lag(y, 24) OVER w AS b, lag(y, 36) OVER w AS c FROM hier WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
resid AS (SELECT origin, unique_id, ds, y - (a + b + c - greatest(a, b, c) - least(a, b, c)) AS e FROM lags JOIN origins ON ds < origin WHERE c IS NOT NULL)"""

_L = "CAST(level AS BIGINT) AS level"


# hierarchy


@query(f"{LEAVES} SELECT {_L}, unique_id, {stamp('ds')} AS ds, round(y, 6) AS y FROM hier")
def h1_hierarchy(spark, d):
    return Study.of(spark, d).series


@query(f"{LEAVES} SELECT {_L}, unique_id, parent, CAST(n_leaves AS BIGINT) AS n_leaves FROM nodes")
def h2_nodes(spark, d):
    return Study.of(spark, d).nodes


@query(f"{LEAVES} SELECT unique_id, leaf_id, {_L} FROM edges")
def h2_edges(spark, d):
    return Study.of(spark, d).edges


_DIGESTS = ", digests AS (SELECT sha256(unique_id || '|' || leaf_id || '|' || CAST(level AS VARCHAR)) AS d FROM edges)"


@query(f"{LEAVES}{_DIGESTS} SELECT sha256(string_agg('0:' || d2, '')) AS s_hash FROM (SELECT sha256(string_agg(d, '' ORDER BY d)) AS d2 FROM digests)")
def h3_fingerprint(spark, d):
    return hierarchy.fingerprint(Study.of(spark, d).edges, buckets=1)


EVENTS = """WITH ev AS (SELECT event_type AS region, to_timestamp(floor(epoch(ts) / 1800) * 1800)::TIMESTAMP AS ds, round(value, 4) AS y FROM events),
inst AS (SELECT region, ds, avg(y) AS y, count(*) AS n, max(y) - min(y) AS spread FROM ev GROUP BY 1, 2),
span AS (SELECT region, min(ds) AS a, max(ds) AS b FROM inst GROUP BY 1),
grid AS (SELECT region, unnest(generate_series(a, b, INTERVAL 30 MINUTE)) AS ds FROM span),
slots AS (SELECT g.region, g.ds, i.y, i.region IS NOT NULL AS present FROM grid g LEFT JOIN inst i ON i.region = g.region AND i.ds = g.ds),
hours AS (SELECT region, date_trunc('hour', ds) AS ds, avg(y) AS y FROM slots GROUP BY 1, 2),
marked AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ds) - sum(CASE WHEN y IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY region ORDER BY ds) AS island FROM hours),
gaps AS (SELECT region, min(ds) AS start, count(*) AS hours FROM marked WHERE y IS NULL GROUP BY region, island),
ends AS (SELECT region, ds, y, epoch(ds) AS t, last_value(y IGNORE NULLS) OVER b AS y0, last_value(CASE WHEN y IS NOT NULL THEN epoch(ds) END IGNORE NULLS) OVER b AS t0,
  first_value(y IGNORE NULLS) OVER a AS y1, first_value(CASE WHEN y IS NOT NULL THEN epoch(ds) END IGNORE NULLS) OVER a AS t1 FROM hours
  WINDOW b AS (PARTITION BY region ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY region ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT region, ds, CASE WHEN y IS NOT NULL THEN y ELSE y0 + (y1 - y0) * (t - t0) / (t1 - t0) END AS y, y IS NULL AND y0 IS NOT NULL AND y1 IS NOT NULL AS imputed, y IS NULL AS missing FROM ends),
daily AS (SELECT ds, sum(y) * (1 + 0.001 * (day(ds) % 3)) AS y FROM filled GROUP BY ds)"""


# cleaning


@query(f"{EVENTS} SELECT region, {stamp('ds')} AS ds, round(y, 6) AS y, n, round(spread, 6) AS spread FROM inst")
def cl1_distinct_instants(spark, d):
    return clean.distinct_instants(views.half_hourly_events(spark, d))


@query(f"{EVENTS} SELECT region, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1 AND spread = 0) AS duplicates_identical, count(*) FILTER (n > 1 AND spread > 0) AS duplicates_conflicting, count(*) FILTER (y IS NULL) AS missing_values FROM inst GROUP BY 1")
def cl1_duplicates(spark, d):
    return clean.duplicate_counts(clean.distinct_instants(views.half_hourly_events(spark, d)))


def _slots(spark, d):
    return clean.complete_slots(clean.distinct_instants(views.half_hourly_events(spark, d)))


@query(f"{EVENTS} SELECT region, {stamp('ds')} AS ds, round(y, 6) AS y, present FROM slots")
def cl2_complete_slots(spark, d):
    return _slots(spark, d)


@query(f"{EVENTS} SELECT region, {stamp('ds')} AS ds, round(y, 6) AS y FROM hours")
def cl3_hourly_mean(spark, d):
    return clean.hourly_mean(_slots(spark, d))


@query(f"{EVENTS} SELECT region, {stamp('start')} AS start, hours FROM gaps")
def cl4_gaps(spark, d):
    return clean.gaps(clean.hourly_mean(_slots(spark, d)))


@query(f"{EVENTS} SELECT region, {stamp('start')} AS start, hours FROM gaps WHERE hours > 1")
def cl5_long_gaps(spark, d):
    return clean.long_gaps(clean.hourly_mean(_slots(spark, d)))


@query(f"{EVENTS} SELECT region, {stamp('ds')} AS ds, round(y, 6) AS y, imputed FROM filled")
def cl6_interpolated(spark, d):
    return clean.interpolated(clean.hourly_mean(_slots(spark, d)))


@query(
    f"""{EVENTS} SELECT i.region, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1 AND spread = 0) AS duplicates_identical, count(*) FILTER (n > 1 AND spread > 0) AS duplicates_conflicting, count(*) FILTER (y IS NULL) AS missing_values,
  (SELECT count(*) FROM slots s WHERE s.region = i.region AND NOT present) AS missing_halfhours, (SELECT count(*) FROM filled f WHERE f.region = i.region AND f.missing) AS imputed_hours,
  coalesce((SELECT max(hours) FROM gaps g WHERE g.region = i.region), 0) AS longest_gap_hours FROM inst i GROUP BY i.region"""
)
def cl7_quality_table(spark, d):
    return clean.quality_table(views.half_hourly_events(spark, d))


#: A range inside the events' month, with a gap across its first hour where the data have one there.
FROM, TO = "2024-01-05 00:30", "2024-01-20 12:00"
_RANGE = EVENTS.replace("FROM slots GROUP BY 1, 2),", f"FROM slots WHERE ds >= TIMESTAMP '{FROM}' AND ds < TIMESTAMP '{TO}' GROUP BY 1, 2),", 1)


@query(f"{_RANGE} SELECT region, {stamp('ds')} AS ds, round(y, 6) AS y, missing AS imputed FROM filled")
def cl7_prepared_range(spark, d):
    return clean.prepare_all(views.half_hourly_events(spark, d), FROM, TO, 10_000).hourly


@query(
    f"""{_RANGE} SELECT i.region, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1 AND spread = 0) AS duplicates_identical, count(*) FILTER (n > 1 AND spread > 0) AS duplicates_conflicting, count(*) FILTER (y IS NULL) AS missing_values,
  (SELECT count(*) FROM slots s WHERE s.region = i.region AND NOT present) AS missing_halfhours, (SELECT count(*) FROM hours h WHERE h.region = i.region AND h.y IS NULL) AS imputed_hours,
  coalesce((SELECT max(hours) FROM gaps g WHERE g.region = i.region), 0) AS longest_gap_hours FROM inst i GROUP BY i.region"""
)
def cl7_quality_of_range(spark, d):
    return clean.prepare_all(views.half_hourly_events(spark, d), FROM, TO, 10_000).quality


@query(f"{EVENTS}, tot AS (SELECT date_trunc('hour', ds) AS ds, avg(y) AS y FROM (SELECT ds, avg(y) AS y FROM ev GROUP BY 1) GROUP BY 1) SELECT {stamp('ds')} AS ds, round(y, 6) AS y FROM tot")
def cl8_hourly_total(spark, d):
    one = views.half_hourly_events(spark, d).groupBy("ds").agg(F.avg("y").alias("y"))
    return one.groupBy(F.date_trunc("hour", "ds").alias("ds")).agg(F.avg("y").alias("y"))


@query(
    f"""{LEAVES}, per AS (SELECT unique_id, min(ds) AS a, max(ds) AS b, count(*) AS n, count(*) FILTER (y IS NULL) AS bad FROM hier GROUP BY 1)
SELECT 'values' AS "check", CAST(sum(bad) AS BIGINT) AS violations FROM per UNION ALL SELECT 'first_dates', count(DISTINCT a) - 1 FROM per UNION ALL SELECT 'last_dates', count(DISTINCT b) - 1 FROM per UNION ALL SELECT 'lengths', count(DISTINCT n) - 1 FROM per"""
)
def cl9_completeness(spark, d):
    return clean.completeness(Study.of(spark, d).series)


@query(f"{LEAVES} SELECT unique_id, CASE WHEN level = 0 THEN 'All' ELSE split_part(unique_id, '/', -1) END AS name FROM nodes")
def cl10_short_names(spark, d):
    return Study.of(spark, d).nodes.select("unique_id", clean.short_name(F.col("unique_id"), {"Total": "All"}).alias("name"))


def _filled(spark, d):
    return clean.interpolated(clean.hourly_mean(_slots(spark, d)))


def _official(filled):
    """A total with a small known error on two days of three."""
    return filled.groupBy("ds").agg(F.sum("y").alias("y")).select("ds", (F.col("y") * (1 + 0.001 * (F.dayofmonth("ds") % 3))).alias("y"))


_GAP = f"""{EVENTS}, sums AS (SELECT ds, sum(y) AS s, count(y) AS n FROM filled GROUP BY 1),
gap AS (SELECT d.ds, CASE WHEN n = (SELECT count(DISTINCT region) FROM filled) THEN d.y - s END AS gap FROM daily d LEFT JOIN sums ON sums.ds = d.ds)"""


@query(f"{_GAP} SELECT {stamp('ds')} AS ds, round(gap, 6) AS gap FROM gap")
def h5_additivity(spark, d):
    filled = _filled(spark, d)
    return hierarchy.additivity(filled, _official(filled))


@query(f"{_GAP} SELECT {stamp('period')} AS period, round(m, 6) AS median_gap, round(x, 6) AS max_gap, x > 0.15 AS above FROM (SELECT date_trunc('day', ds) AS period, median(abs(gap)) AS m, max(abs(gap)) AS x FROM gap GROUP BY 1)")
def h6_additivity_by_day(spark, d):
    filled = _filled(spark, d)
    return hierarchy.additivity_by(hierarchy.additivity(filled, _official(filled)), "day", 0.15)


@query(f"{LEAVES}, gap AS (SELECT l.ds, sum(y) * (0.0001 * (year(l.ds) % 3)) AS gap FROM leaves l GROUP BY 1) SELECT {stamp('period')} AS period, round(m, 6) AS median_gap, round(x, 6) AS max_gap, x > 0.9 AS above FROM (SELECT date_trunc('year', ds) AS period, median(abs(gap)) AS m, max(abs(gap)) AS x FROM gap GROUP BY 1)")
def h6_additivity_by_year(spark, d):
    """Monthly revenue of the leaves against a total that is too high by a share that depends on the year."""
    leaves = Study.of(spark, d).leaves
    regional = leaves.select(F.concat_ws("/", "region", "nation").alias("region"), "ds", "y")
    official = regional.groupBy("ds").agg((F.sum("y") * (1 + 0.0001 * (F.year("ds") % 3))).alias("y"))
    return hierarchy.additivity_by(hierarchy.additivity(regional, official), "year", 0.9)


@query(f"{LEAVES} SELECT region, nation, count(y) AS n, round(avg(y), 3) AS mean, round(stddev_samp(y), 3) AS sd FROM leaves GROUP BY 1, 2", digits=3)
def h7_profile(spark, d):
    return hierarchy.profile(views.monthly_revenue(spark, d), "region", "nation")


# splits and base forecasts


@query(f"{LEAVES} SELECT unique_id, {stamp('ds')} AS ds, round(y, 6) AS y, CASE WHEN ds >= (SELECT min(ds) FROM (SELECT DISTINCT ds FROM hier ORDER BY ds DESC LIMIT 12)) THEN 'test' ELSE 'train' END AS part FROM hier")
def b1_split(spark, d):
    return backtest.last_dates_split(Study.of(spark, d).series, 12).select("unique_id", "ds", "y", "part")


@query(f"{LEAVES} SELECT {stamp('origin')} AS origin FROM origins")
def b2_origins(spark, d):
    return Study.of(spark, d).origins


@query(
    f"""{LEAVES} SELECT {stamp('origin')} AS origin, part, count(*) AS rows, round(sum(y), 6) AS total FROM (SELECT origin, y, CASE WHEN ds < origin THEN 'train' ELSE 'test' END AS part
  FROM hier JOIN origins ON ds >= origin - INTERVAL 36 MONTH AND ds < origin + INTERVAL 6 MONTH) GROUP BY 1, 2"""
)
def b3_rolling_split(spark, d):
    s = Study.of(spark, d)
    return backtest.rolling_split(s.series, s.origins, 36, HORIZON).groupBy("origin", "part").agg(F.count("*").alias("rows"), F.sum("y").alias("total"))


@query(f"{RESIDUALS} SELECT {stamp('origin')} AS origin, {stamp('max(ds)')} AS last_seen FROM resid GROUP BY origin HAVING max(ds) >= origin")
def b4_leakage(spark, d):
    return backtest.leakage(Study.of(spark, d).residuals())


@query(f"{RESIDUALS} SELECT {stamp('o.origin')} AS origin, {stamp('max(r.ds)')} AS last_seen FROM origins o JOIN resid r ON r.origin = o.origin AND o.origin < (SELECT max(origin) FROM origins) OR r.origin = (SELECT max(origin) FROM origins) AND o.origin = (SELECT min(origin) FROM origins) GROUP BY o.origin HAVING max(r.ds) >= o.origin")
def b4_leakage_found(spark, d):
    """The first origin is given the last one's residuals, the last one none: the first has seen its own time."""
    s = Study.of(spark, d)
    ends = F.broadcast(s.origins.agg(F.min("origin").alias("a"), F.max("origin").alias("b")))
    own = s.residuals().join(ends).select(F.when(F.col("origin") == F.col("b"), F.col("a")).otherwise(F.col("origin")).alias("origin"), "ds")
    return backtest.leakage(own)


@query(f"{LEAVES} SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, horizon, round(base, 6) AS base, round(naive, 6) AS naive FROM fc0")
def b5_seasonal_forecasts(spark, d):
    return Study.of(spark, d).base.groupBy("origin", "unique_id", "ds", "horizon").pivot("method", ["base", "naive"]).agg(F.first("y_hat"))


@query(
    f"""{LEAVES}, m AS (SELECT origin, unique_id, ds, horizon, avg(y) AS mean3, count(y) AS n FROM past GROUP BY 1, 2, 3, 4), l AS (SELECT origin, unique_id, arg_max(y, ds) AS last FROM hier JOIN origins ON ds < origin GROUP BY 1, 2)
SELECT {stamp('m.origin')} AS origin, m.unique_id, {stamp('m.ds')} AS ds, horizon, round(mean3, 6) AS mean3, round(last, 6) AS last FROM m JOIN l ON l.origin = m.origin AND l.unique_id = m.unique_id WHERE n = 3"""
)
def b6_naive_baselines(spark, d):
    s = Study.of(spark, d)
    mean = backtest.mean_of_seasons(s.series, s.origins, HORIZON, SEASON, 3).withColumnRenamed("y_hat", "mean3")
    return mean.join(backtest.last_value(s.series, s.origins).withColumnRenamed("y_hat", "last"), ["origin", "unique_id"])


@query()
def b7_fitted_series(spark, d):
    s = Study.of(spark, d)
    train = backtest.rolling_split(s.series, s.origins, 48, HORIZON).filter("part = 'train'").drop("part")
    return reconcile.fit_series(train, HORIZON, SEASON)


_SMOOTH = f"""{LEAVES.replace("WITH raw", "WITH RECURSIVE raw", 1)}, num AS (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) - 1 AS t FROM hier),
st AS (SELECT unique_id, CAST(0 AS BIGINT) AS t, avg(y) AS level, list(y ORDER BY t) AS seas, avg(y) AS m FROM num WHERE t < 12 GROUP BY 1),
run AS (SELECT unique_id, t, level, list_transform(seas, lambda x: x - m) AS seas FROM st
  UNION ALL SELECT r.unique_id, r.t + 1, 0.3 * (n.y - r.seas[r.t % 12 + 1]) + 0.7 * r.level, list_transform(r.seas, lambda x, i: CASE WHEN i = r.t % 12 + 1 THEN 0.2 * (n.y - r.level) + 0.8 * x ELSE x END) FROM run r JOIN num n ON n.unique_id = r.unique_id AND n.t = r.t)"""


@query(
    f"""{_SMOOTH} SELECT NULL AS origin, unique_id, {stamp('ds')} AS ds, NULL::BIGINT AS horizon, round(level + seas[t % 12 + 1], 4) AS y_hat FROM run JOIN num USING (unique_id, t) WHERE t >= 12
UNION ALL SELECT {stamp('origin')}, unique_id, {stamp('origin + to_months(CAST(h - 1 AS INTEGER))')}, h, round(level + seas[(t + h - 1) % 12 + 1], 4) FROM origins, range(1, 7) s(h), run WHERE t = datediff('month', (SELECT min(ds) FROM hier), origin)""",
    digits=4,
)
def b7_smoothed_at_origins(spark, d):
    """Fitted values once, and forecasts at every origin, of one run over each series."""
    s = Study.of(spark, d)
    return reconcile.smooth_at_origins(s.series, s.origins, HORIZON, SEASON)


@query(f"{RESIDUALS} SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, round(e, 6) AS e FROM resid")
def b10_residuals(spark, d):
    return Study.of(spark, d).residuals()


@query(f"{RESIDUALS} SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, round(e, 6) AS e FROM (SELECT *, dense_rank() OVER (PARTITION BY origin ORDER BY ds DESC) AS k FROM resid) WHERE k <= 20")
def b11_trailing_window(spark, d):
    return backtest.trailing_window(Study.of(spark, d).residuals(), 20)


@query(f"{LEAVES} SELECT {stamp('origin')} AS origin, fc0.unique_id, {stamp('fc0.ds')} AS ds, round(y - base, 6) AS e FROM fc0 JOIN hier ON hier.unique_id = fc0.unique_id AND hier.ds = fc0.ds")
def b12_out_of_sample_errors(spark, d):
    return Study.of(spark, d).own_errors()


@query(f"{RESIDUALS}, bias AS (SELECT origin, unique_id, avg(e) AS b FROM resid GROUP BY 1, 2) SELECT {stamp('f.origin')} AS origin, f.unique_id, {stamp('f.ds')} AS ds, horizon, round(base + b, 3) AS y_hat FROM fc0 f JOIN bias ON bias.origin = f.origin AND bias.unique_id = f.unique_id", digits=3)
def b13_debiased(spark, d):
    s = Study.of(spark, d)
    return backtest.debiased(s.own(), s.residuals())


@query(
    f"""{FORECASTS}, lags AS (SELECT unique_id, ds, y, lag(y, 12) OVER w AS a, lag(y, 24) OVER w AS b, lag(y, 36) OVER w AS c FROM hier WINDOW w AS (PARTITION BY unique_id ORDER BY ds)),
resid AS (SELECT origin, unique_id, y - (a + b + c - greatest(a, b, c) - least(a, b, c)) AS e FROM lags JOIN origins ON ds < origin WHERE c IS NOT NULL),
ins AS (SELECT unique_id, stddev_samp(e) AS s FROM resid GROUP BY 1), oos AS (SELECT unique_id, avg(abs(y - y_hat)) AS m FROM fc WHERE method = 'base' GROUP BY 1)
SELECT unique_id, round(s, 6) AS in_sample, round(m, 6) AS out_of_sample, round(m / s, 6) AS ratio FROM ins JOIN oos USING (unique_id)"""
)
def b15_error_ratio(spark, d):
    s = Study.of(spark, d)
    ins = s.residuals().groupBy("unique_id").agg(F.stddev_samp("e").alias("in_sample"))
    out = backtest.with_actuals(s.own(), s.series).groupBy("unique_id").agg(F.avg(F.abs(F.col("y") - F.col("y_hat"))).alias("out_of_sample"))
    return ins.join(out, "unique_id").withColumn("ratio", F.col("out_of_sample") / F.col("in_sample"))


# covariance and reconciliation

_PAIRS = ", pairs AS (SELECT a.origin, a.unique_id AS i, b.unique_id AS j, a.e AS ei, b.e AS ej FROM resid a JOIN resid b ON b.origin = a.origin AND b.ds = a.ds)"


def _relative(df: DataFrame, scale: float) -> DataFrame:
    return df.withColumn("w", F.col("w") / scale)


@query(f"{RESIDUALS}{_PAIRS} SELECT {stamp('origin')} AS origin, i, j, round(avg(ei * ej) / 1000000, 6) AS w, count(*) AS t FROM pairs WHERE i <= j GROUP BY origin, i, j")
def r1_covariance(spark, d):
    return _relative(reconcile.covariance(Study.of(spark, d).residuals()), 1e6)


@query(f"{RESIDUALS}{_PAIRS} SELECT {stamp('origin')} AS origin, i, j, round(covar_samp(ei, ej) / 1000000, 6) AS w, count(*) AS t FROM pairs WHERE i <= j GROUP BY origin, i, j")
def r1_covariance_library(spark, d):
    return _relative(reconcile.covariance(Study.of(spark, d).residuals(), "library"), 1e6)


_X = f"""{RESIDUALS}, rms AS (SELECT origin, unique_id, sqrt(avg(e * e)) AS s FROM resid GROUP BY 1, 2), x AS (SELECT r.origin, r.unique_id, r.ds, e / s AS x FROM resid r JOIN rms ON rms.origin = r.origin AND rms.unique_id = r.unique_id WHERE s > 0),
pt AS (SELECT a.origin, a.unique_id AS i, b.unique_id AS j, avg(a.x * b.x) AS r, avg(a.x * b.x * a.x * b.x) AS q, count(*) AS t FROM x a JOIN x b ON b.origin = a.origin AND b.ds = a.ds AND a.unique_id < b.unique_id GROUP BY 1, 2, 3),
lam AS (SELECT origin, greatest(0, least(1, max(t) / pow(max(t) - 1, 3) * sum(t * (q - r * r)) / sum(r * r))) AS intensity, max(t) AS t FROM pt GROUP BY 1)"""


@query(f"{_X} SELECT {stamp('origin')} AS origin, round(intensity, 6) AS intensity, t FROM lam")
def r2_shrinkage(spark, d):
    return factors.shrinkage(Study.of(spark, d).residuals())


@query(f"{_X}{_PAIRS}, w AS (SELECT origin, i, j, avg(ei * ej) / 1000000 AS w FROM pairs WHERE i <= j GROUP BY 1, 2, 3) SELECT {stamp('w.origin')} AS origin, i, j, round(CASE WHEN i = j THEN w ELSE (1 - intensity) * w END, 6) AS w FROM w JOIN lam ON lam.origin = w.origin")
def r3_shrunk(spark, d):
    moments = materialize(reconcile.pair_moments(Study.of(spark, d).residuals()), "moments")
    return _relative(reconcile.shrunk(moments.select("origin", "i", "j", F.col("plan").alias("w")), reconcile.intensity_of(moments)), 1e6)


@query(f"{_X} SELECT {stamp('origin')} AS origin, i, j, round(r * r, 6) AS r2, round(q, 6) AS q, t FROM pt")
def r17_pair_table(spark, d):
    return reconcile.pair_table(reconcile.pair_moments(Study.of(spark, d).residuals())).drop("r", "var_r")


@query(f"{_X} SELECT {stamp('origin')} AS origin, i, j, round(t * t * (q - r * r) / pow(t - 1, 3), 6) AS var_r FROM pt")
def r17_sampling_variances(spark, d):
    return reconcile.pair_table(reconcile.pair_moments(Study.of(spark, d).residuals())).select("origin", "i", "j", "var_r")


@query(
    f"""{RESIDUALS}, per AS (SELECT origin, unique_id, count(e) AS t, stddev_pop(e) AS sd FROM resid GROUP BY 1, 2), g AS (SELECT origin, min(t) AS t, min(sd) AS sd FROM per GROUP BY 1)
SELECT {stamp('origin')} AS origin, CASE WHEN t < 25 OR sd <= 0 THEN 'wls_struct' ELSE 'mint_shrink' END AS method, CASE WHEN t < 25 THEN 'few residuals' WHEN sd <= 0 THEN 'a series without variance' ELSE 'ok' END AS reason FROM g"""
)
def r5_choose_method(spark, d):
    return reconcile.choose_method(Study.of(spark, d).residuals(), 25)


def _method(name: str):
    def run(spark, d):
        return Study.of(spark, d).reconciled().filter(F.col("method") == name).select("origin", "unique_id", "ds", "horizon", "y_hat")

    source = {"bu": f"{LEAVES} , r AS (SELECT f.origin, e.unique_id, f.ds, f.horizon, sum(f.base) AS mu FROM fc0 f JOIN edges e ON e.leaf_id = f.unique_id GROUP BY 1, 2, 3, 4)", "ols": f"{LEAVES},{two_pass('r', '1.0')}", "wls_struct": f"{LEAVES},{two_pass('r', 'CAST(n.n_leaves AS DOUBLE)')}"}[name]
    return query(f"{source} SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, horizon, round(mu, 6) AS y_hat FROM r", {"bu": "r6_bottom_up", "ols": "r7_ols", "wls_struct": "r7_wls_struct"}[name])(run)


for _name in ("bu", "ols", "wls_struct"):
    _method(_name)


@query()
def r8_minimum_trace(spark, d):
    return Study.of(spark, d).minimum_trace()


# coherence, gate and metrics


@query(f"{FORECASTS}, sums AS (SELECT f.origin, f.method, f.ds, e.unique_id, sum(y_hat) AS s FROM fc f JOIN edges e ON e.leaf_id = f.unique_id GROUP BY 1, 2, 3, 4) SELECT {stamp('f.origin')} AS origin, f.method, round(max(abs(y_hat - s)), 6) AS gap FROM fc f JOIN sums s ON s.origin = f.origin AND s.method = f.method AND s.ds = f.ds AND s.unique_id = f.unique_id GROUP BY f.origin, f.method")
def g1_incoherence(spark, d):
    s = Study.of(spark, d)
    return metrics.incoherence(s.reconciled(), s.edges)


_SIGNED = "count(*) AS n, round(max(abs(y_hat - s)), 6) AS gap, round(min(y_hat - s), 6) + 0.0 AS lowest, round(max(y_hat - s), 6) + 0.0 AS highest"


@query(f"{FORECASTS}, sums AS (SELECT f.origin, f.method, f.ds, e.unique_id, sum(y_hat) AS s FROM fc f JOIN edges e ON e.leaf_id = f.unique_id AND e.unique_id <> e.leaf_id GROUP BY 1, 2, 3, 4) SELECT f.method, f.horizon, {_SIGNED} FROM fc f JOIN sums s ON s.origin = f.origin AND s.method = f.method AND s.ds = f.ds AND s.unique_id = f.unique_id GROUP BY f.method, f.horizon")
def g1_incoherence_by_horizon(spark, d):
    s = Study.of(spark, d)
    return metrics.incoherence_by(s.reconciled(), s.edges, ["method", "horizon"], ["origin", "method", "ds", "horizon"])


@query(f"{LEAVES}, fc AS (SELECT ds, unique_id, y + CASE WHEN level = 1 AND month(ds) = 3 THEN 0.001 * y WHEN level = 0 AND month(ds) = 4 THEN -0.002 * y ELSE 0 END AS y_hat FROM hier), sums AS (SELECT f.ds, e.unique_id, sum(y_hat) AS s FROM fc f JOIN edges e ON e.leaf_id = f.unique_id AND e.unique_id <> e.leaf_id GROUP BY 1, 2) SELECT f.unique_id, {_SIGNED} FROM fc f JOIN sums s ON s.ds = f.ds AND s.unique_id = f.unique_id GROUP BY f.unique_id")
def g1_incoherence_of_actuals(spark, d):
    """Actual values by aggregate, those of regions too high in March and the total's too low in April."""
    s = Study.of(spark, d)
    wrong = F.when((F.col("level") == 1) & (F.month("ds") == 3), 0.001 * F.col("y")).when((F.col("level") == 0) & (F.month("ds") == 4), -0.002 * F.col("y")).otherwise(0.0)
    return metrics.incoherence_by(s.series.withColumn("y", F.col("y") + wrong), s.edges, ["unique_id"], ["ds"], "y")


def gate_sql(fc: str = "fc", levels: str = "levels") -> str:
    """The gate's rows for forecasts and level means given as tables of a WITH list."""
    bad = "(y_hat IS NULL OR isnan(y_hat) OR isinf(y_hat))"
    return f""",
gs AS (SELECT f.origin, f.method, f.ds, e.unique_id, sum(y_hat) AS s FROM {fc} f JOIN edges e ON e.leaf_id = f.unique_id GROUP BY 1, 2, 3, 4),
gg AS (SELECT f.method, max(abs(y_hat - s)) AS gap FROM {fc} f JOIN gs ON gs.origin = f.origin AND gs.method = f.method AND gs.ds = f.ds AND gs.unique_id = f.unique_id GROUP BY 1),
gm AS (SELECT method, sum((SELECT count(DISTINCT unique_id) FROM edges) - own) AS missing FROM (SELECT method, origin, ds, count(DISTINCT unique_id) AS own FROM {fc} GROUP BY 1, 2, 3) GROUP BY 1),
gp AS (SELECT method, max(CASE WHEN NOT {bad} THEN abs(y_hat) END) AS top, count(*) FILTER ({bad}) AS bad, avg(CASE WHEN y_hat < 0 THEN 1.0 ELSE 0 END) AS neg FROM {fc} GROUP BY 1),
gl AS (SELECT level, method, avg(mase) AS mase FROM {levels} GROUP BY 1, 2), gb AS (SELECT level, mase AS b FROM gl WHERE method = 'bu'),
gw AS (SELECT method, max(mase / nullif(b, 0) - 1) AS worst, count(*) FILTER (mase <= b * 1.02) AS sound, CASE WHEN count(mase / nullif(b, 0)) = 3 THEN sum((mase / nullif(b, 0) - 1) * (level + 1)) / sum(level + 1) END AS weighted FROM gl LEFT JOIN gb USING (level) GROUP BY 1),
ga AS (SELECT * FROM gp JOIN gm USING (method) LEFT JOIN gg USING (method) LEFT JOIN gw USING (method)),
gate AS (SELECT method, 'complete' AS "check", CAST(missing AS DOUBLE) AS value, missing = 0 AS passed, true AS blocking FROM ga
  UNION ALL SELECT method, 'coherence', CASE WHEN NOT isnan(gap) THEN round(gap, 6) END, coalesce(NOT isnan(gap) AND (gap <= 1e-6 OR gap / greatest(top, 1e-12) <= 1e-9), false), true FROM ga
  UNION ALL SELECT method, 'finite', bad, bad = 0, true FROM ga UNION ALL SELECT method, 'negative', round(neg, 6), neg <= 0, true FROM ga
  UNION ALL SELECT method, 'accuracy', CASE WHEN NOT isnan(worst) THEN round(worst, 6) + 0.0 END, coalesce(sound = 3, false), true FROM ga
  UNION ALL SELECT method, 'weighted_change', CASE WHEN NOT isnan(weighted) THEN round(weighted, 6) + 0.0 END, true, false FROM ga)"""


LEVEL_WEIGHTS = {0: 1, 1: 2, 2: 3}


@query(f'{FORECASTS}{gate_sql()} SELECT method, "check", value, passed, blocking FROM gate')
def g4_gate(spark, d):
    s = Study.of(spark, d)
    return metrics.gate(s.reconciled(), s.edges, s.levels(), "bu", weights=LEVEL_WEIGHTS)


@query(f"{FORECASTS} SELECT {stamp('origin')} AS origin, unique_id, round(scale, 3) AS scale FROM scales", digits=3)
def m1_mase_scale(spark, d):
    return Study.of(spark, d).scales()


@query(f"{FORECASTS} SELECT {stamp('origin')} AS origin, {_L}, unique_id, method, round(mase, 6) AS mase FROM mase")
def m2_mase(spark, d):
    s = Study.of(spark, d)
    return metrics.mase(s.reconciled(), s.scales(), s.nodes)


@query(f"{FORECASTS} SELECT {stamp('origin')} AS origin, {_L}, method, round(mase, 6) AS mase FROM levels")
def m3_by_level(spark, d):
    return Study.of(spark, d).levels()


@query(f"{FORECASTS} SELECT {_L}, method, round(avg(mase), 6) AS mean, round(stddev_samp(mase), 6) AS sd, count(*) AS n FROM levels GROUP BY level, method")
def m4_summary(spark, d):
    return metrics.summary(Study.of(spark, d).levels())


@query(f"{FORECASTS} SELECT {_L}, method, round(avg(mase / nullif(ref, 0) - 1), 6) + 0.0 AS mean, round(stddev_samp(mase / nullif(ref, 0) - 1), 6) AS sd, round(min(mase / nullif(ref, 0) - 1), 6) + 0.0 AS low, round(max(mase / nullif(ref, 0) - 1), 6) + 0.0 AS high, count(mase / nullif(ref, 0)) AS n, count(*) FILTER (mase / nullif(ref, 0) - 1 < -1e-9) AS wins FROM paired GROUP BY level, method")
def m5_relative_change(spark, d):
    return metrics.relative_change(Study.of(spark, d).levels(), "bu")


@query(f"{FORECASTS} SELECT {_L}, method, round(1 - avg(mase) / nullif(avg(ref), 0), 6) + 0.0 AS gain, round(avg(CASE WHEN mase < ref - 1e-9 THEN 1.0 ELSE 0 END), 6) AS win_share, count(DISTINCT origin) AS n FROM paired GROUP BY level, method")
def m6_aggregate_gain(spark, d):
    return metrics.aggregate_gain(Study.of(spark, d).levels(), "bu")


@query(f"{FORECASTS} SELECT {_L.replace('level AS', 'l.level AS')}, l.method, r.method AS reference, round(1 - avg(l.mase) / nullif(avg(r.mase), 0), 6) + 0.0 AS gain FROM levels l JOIN levels r ON r.origin = l.origin AND r.level = l.level AND r.method IN ('bu', 'naive') GROUP BY l.level, l.method, r.method")
def m7_gain_table(spark, d):
    return metrics.gain_table(Study.of(spark, d).levels(), ["bu", "naive"])


@query(f"{FORECASTS}, f1 AS (SELECT f.origin, level, method, horizon, avg(abs(y - y_hat) / nullif(scale, 0)) AS m FROM fc f JOIN scales s ON s.origin = f.origin AND s.unique_id = f.unique_id GROUP BY 1, 2, 3, 4) SELECT {_L}, method, horizon, round(avg(m), 6) AS mase FROM f1 GROUP BY level, method, horizon")
def m8_mase_by_horizon(spark, d):
    s = Study.of(spark, d)
    return metrics.mase_by_horizon(s.reconciled(), s.scales(), s.nodes)


_BY_H = f"""{FORECASTS}, f1 AS (SELECT f.origin, level, method, horizon, avg(abs(y - y_hat) / nullif(scale, 0)) AS m FROM fc f JOIN scales s ON s.origin = f.origin AND s.unique_id = f.unique_id GROUP BY 1, 2, 3, 4), hz AS (SELECT level, method, horizon, avg(m) AS mase FROM f1 GROUP BY 1, 2, 3)"""


def _by_horizon(spark, d):
    s = Study.of(spark, d)
    return materialize(metrics.mase_by_horizon(s.reconciled(), s.scales(), s.nodes), "horizons")


@query(f"{_BY_H} SELECT {_L.replace('level AS', 'h.level AS')}, h.method, h.horizon, round(1 - h.mase / nullif(r.mase, 0), 6) + 0.0 AS gain FROM hz h JOIN hz r ON r.level = h.level AND r.horizon = h.horizon AND r.method = 'bu'")
def m8_gain_by_horizon(spark, d):
    return metrics.gain_by_horizon(_by_horizon(spark, d), "bu")


@query(f"{_BY_H}, b AS (SELECT level, method, CASE WHEN horizon <= 2 THEN '1-2' ELSE '3-' END AS band, avg(mase) AS mase FROM hz GROUP BY 1, 2, 3) SELECT {_L.replace('level AS', 'b.level AS')}, b.method, b.band, round(b.mase, 6) AS mase, round(1 - b.mase / nullif(r.mase, 0), 6) + 0.0 AS gain FROM b JOIN b r ON r.level = b.level AND r.band = b.band AND r.method = 'bu'")
def m8_gain_by_band(spark, d):
    return metrics.gain_by_band(_by_horizon(spark, d), "bu", 2)


_MONTHS = f"{FORECASTS}, mo AS (SELECT origin AS month, level, method, avg(mase) AS mase FROM levels GROUP BY 1, 2, 3), mg AS (SELECT m.*, r.mase AS ref FROM mo m JOIN mo r ON r.month = m.month AND r.level = m.level AND r.method = 'base')"


@query(f"{_MONTHS} SELECT {stamp('month')} AS month, {_L}, method, round(1 - mase / nullif(ref, 0), 6) + 0.0 AS gain, mase < ref - 1e-9 AS won FROM mg")
def m9_monthly_gain(spark, d):
    return metrics.monthly_gain(Study.of(spark, d).levels(), "base")


@query(f"{_MONTHS} SELECT {_L}, method, count(*) AS months, count(*) FILTER (mase < ref - 1e-9) AS won FROM mg GROUP BY level, method")
def m9_months_won(spark, d):
    return metrics.months_won(Study.of(spark, d).levels(), "base")


METHODS = ["base", "naive", "bu", "ols", "wls_struct"]


@query(f"{FORECASTS} SELECT {_L}, {stamp('origin')} AS origin, " + ", ".join(f"round(max(mase) FILTER (method = '{m}'), 6) AS {m}" for m in METHODS) + " FROM levels GROUP BY level, origin")
def m16_by_origin(spark, d):
    return metrics.by_origin(Study.of(spark, d).levels(), METHODS)


@query(f"{FORECASTS} SELECT {stamp('origin')} AS month, {_L}, method, round(avg(mase), 6) AS mase, count(*) AS n FROM levels GROUP BY origin, level, method")
def m9_monthly(spark, d):
    return metrics.monthly(Study.of(spark, d).levels())


@query(
    f"""{FORECASTS}, per AS (SELECT f.origin, f.level, f.unique_id, method, avg(abs(y - y_hat)) AS mae, sqrt(avg((y - y_hat) * (y - y_hat))) AS rmse, 100 * avg(CASE WHEN y <> 0 THEN abs(y - y_hat) / y END) AS mape, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0 END) AS zero_share, avg(abs(y - y_hat)) / nullif(any_value(scale), 0) AS mase
  FROM fc f JOIN scales s ON s.origin = f.origin AND s.unique_id = f.unique_id GROUP BY 1, 2, 3, 4), long AS (UNPIVOT per ON mae, rmse, mape, zero_share, mase INTO NAME metric VALUE value)
SELECT {stamp('origin')} AS origin, {_L}, method, metric, round(avg(value), 6) AS value FROM long GROUP BY origin, level, method, metric"""
)
def m10_error_metrics(spark, d):
    s = Study.of(spark, d)
    return metrics.error_metrics(s.reconciled(), s.scales(), s.nodes)


@query(f"{FORECASTS} SELECT {_L}, {stamp('origin')} AS origin, count(*) OVER w AS k, round(1 - sum(mase) OVER w / nullif(sum(ref) OVER w, 0), 6) + 0.0 AS gain FROM paired WHERE method = 'wls_struct' WINDOW w AS (PARTITION BY level ORDER BY origin)")
def m12_running_gain(spark, d):
    return metrics.running_gain(Study.of(spark, d).levels(), "wls_struct", "bu")


@query(f"{FORECASTS} SELECT f.unique_id, f.method, round(avg(f.y_hat - b.y_hat), 6) AS adjustment FROM fc f JOIN fc b ON b.origin = f.origin AND b.unique_id = f.unique_id AND b.ds = f.ds AND b.method = 'base' WHERE f.method <> 'base' GROUP BY 1, 2")
def m16_mean_adjustment(spark, d):
    return metrics.mean_adjustment(Study.of(spark, d).reconciled())


# tests

def sql_erfc(x: str) -> str:
    """The complementary error function of a number that isn't negative, as tails.erfc has it."""
    t = f"(1 / (1 + ({x}) / 2))"
    poly = str(ERFC[-1])
    for c in ERFC[-2::-1]:
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp({poly} - ({x}) * ({x})))"


_LAST = f"{RESIDUALS}, err AS (SELECT unique_id, ds, e FROM resid WHERE origin = (SELECT max(origin) FROM origins))"
_ACF = f"""{_LAST}, x AS (SELECT unique_id, e - avg(e) OVER (PARTITION BY unique_id) AS d, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS t, count(*) OVER (PARTITION BY unique_id) AS n FROM err),
g AS (SELECT a.unique_id, k AS lag, sum(a.d * b.d) / max(a.n) AS g, max(a.n) AS n FROM x a JOIN x b ON b.unique_id = a.unique_id JOIN range(0, 13) r(k) ON b.t = a.t + k GROUP BY 1, 2)"""


def _last_errors(spark, d):
    s = Study.of(spark, d)
    last = s.origins.agg(F.max("origin").alias("last"))
    return s.residuals().join(F.broadcast(last), F.col("origin") == F.col("last")).select("unique_id", "ds", "e")


@query(f"{_LAST} SELECT unique_id, count(e) AS n, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS sd, round(avg(e) / nullif(stddev_samp(e) / sqrt(count(e)), 0), 6) AS t, abs(avg(e) / nullif(stddev_samp(e) / sqrt(count(e)), 0)) > 2 AS biased FROM err GROUP BY 1")
def t1_bias_table(spark, d):
    return inference.bias_table(_last_errors(spark, d), "unique_id")


_HAC = f"""{_ACF.replace("range(0, 13)", "range(0, (SELECT CAST(ceil(1.3 * sqrt(max(n))) AS BIGINT) + 1 FROM x))")}, b AS (SELECT unique_id, count(e) AS n, avg(e) AS mean, stddev_samp(e) AS sd, ceil(1.3 * sqrt(count(e))) AS lags FROM err GROUP BY 1),
h AS (SELECT unique_id, b.n, any_value(mean) AS mean, any_value(lags) AS lags, any_value(sd) AS sd, sqrt(greatest(0, sum(CASE WHEN lag = 0 THEN g ELSE 2 * (1 - lag / (lags + 1)) * g END)) / b.n) AS se FROM g JOIN b USING (unique_id) WHERE lag <= lags GROUP BY unique_id, b.n),
hac AS (SELECT *, mean / nullif(se, 0) AS t FROM h)"""


@query(
    f"""{_HAC} SELECT unique_id, n, round(mean, 6) AS mean, CAST(lags AS BIGINT) AS lags, round(se, 6) AS se, round(sd / sqrt(n), 6) AS naive_se, round(t, 6) AS t, round({sql_erfc('abs(t) / sqrt(2.0)')}, 6) AS p FROM hac"""
)
def t2_hac_mean(spark, d):
    return inference.hac_mean(_last_errors(spark, d), ["unique_id"])


@query(f"{_ACF} SELECT unique_id, k AS lags, round(max(n * (n + 2)) * sum(pow(g / g0, 2) / (n - lag)), 6) AS q FROM g JOIN (SELECT unique_id, g AS g0 FROM g WHERE lag = 0 AND g > 0) USING (unique_id) JOIN (VALUES (6), (12)) v(k) ON lag > 0 AND lag <= k GROUP BY 1, 2")
def t3_ljung_box(spark, d):
    return inference.ljung_box(_last_errors(spark, d), ["unique_id"], [6, 12])


@query()
def t3_ljung_box_p(spark, d):
    return inference.ljung_box_test(_last_errors(spark, d), ["unique_id"], [6, 12])


@query(f"{_ACF} SELECT unique_id, lag, round(g / g0, 6) AS rho FROM g JOIN (SELECT unique_id, g AS g0 FROM g WHERE lag = 0 AND g > 0) USING (unique_id)")
def t4_acf(spark, d):
    return inference.acf(_last_errors(spark, d), ["unique_id"], 12).drop("n")


@query(
    f"""{FORECASTS}, d AS (SELECT level, method, mase - ref AS d FROM paired WHERE method IN ('ols', 'wls_struct')),
r AS (SELECT *, rank() OVER (PARTITION BY level, method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY level, method, abs(d)) - 1) / 2 AS r FROM d WHERE d <> 0),
s AS (SELECT level, method, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS rank_sum FROM r GROUP BY 1, 2)
SELECT CAST(b.level AS BIGINT) AS level, b.method, n, round(mean, 6) AS mean, round(t, 6) AS t, round(better, 6) AS better, round(CAST(rank_sum AS DOUBLE), 6) AS rank_sum
FROM (SELECT level, method, count(d) AS n, avg(d) AS mean, avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0) AS t, avg(CASE WHEN d < 0 THEN 1.0 ELSE 0 END) AS better FROM d GROUP BY 1, 2) b LEFT JOIN s ON s.level = b.level AND s.method = b.method"""
)
def t6_paired(spark, d):
    levels = Study.of(spark, d).levels()
    both = metrics._against(levels, "bu", "origin", "level").filter(F.col("method").isin("ols", "wls_struct"))
    return inference.paired(both.select("level", "method", (F.col("mase") - F.col("ref")).alias("d")), ["level", "method"]).drop("sd", "nonzero", "ties")


@query(
    f"""{_HAC}, p AS (SELECT unique_id, round({sql_erfc('abs(t) / sqrt(2.0)')}, 9) AS p FROM hac WHERE t IS NOT NULL),
o AS (SELECT *, row_number() OVER (ORDER BY p, unique_id) AS k, count(*) OVER () AS m FROM p), a AS (SELECT unique_id, p, least(1, max((m - k + 1) * p) OVER (ORDER BY k)) AS adjusted FROM o)
SELECT 'all' AS family, unique_id, round(p, 6) AS p, round(adjusted, 6) AS adjusted, adjusted <= 0.05 AS reject FROM a"""
)
def t5_holm(spark, d):
    """Over the mean tests of all series."""
    p = inference.hac_mean(_last_errors(spark, d), ["unique_id"]).filter("p is not null").select(F.lit("all").alias("family"), "unique_id", F.round("p", 9).alias("p"))
    return inference.holm(p, ["family"], ["unique_id"])


@query(f"{_LAST} SELECT a.unique_id AS i, b.unique_id AS j, round(corr(a.e, b.e), 6) AS r FROM err a JOIN err b ON b.ds = a.ds AND a.unique_id < b.unique_id GROUP BY 1, 2")
def t10_correlations(spark, d):
    return inference.correlations(_last_errors(spark, d))


# counts

COUNTS = """WITH ev AS (SELECT user_id AS item, CAST(ts AS DATE) AS day FROM events), days AS (SELECT unnest(generate_series((SELECT min(day) FROM ev)::TIMESTAMP, (SELECT max(day) FROM ev)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day),
c AS (SELECT item, day, count(*) AS k FROM ev GROUP BY 1, 2), g AS (SELECT i.item, d.day, coalesce(c.k, 0) AS k FROM (SELECT DISTINCT item FROM ev) i CROSS JOIN days d LEFT JOIN c ON c.item = i.item AND c.day = d.day),
hist AS (SELECT item, k, count(*) AS c FROM g WHERE day < (SELECT max(day) FROM days) GROUP BY 1, 2), tot AS (SELECT item, max(k) AS top, sum(c) AS n FROM hist GROUP BY 1),
pk AS (SELECT t.item, r.k, coalesce(h.c, 0) / t.n AS p FROM tot t JOIN range(0, 1000) r(k) ON r.k <= t.top LEFT JOIN hist h ON h.item = t.item AND h.k = r.k),
cdf AS (SELECT *, sum(p) OVER (PARTITION BY item ORDER BY k) AS cdf FROM pk), act AS (SELECT item, k AS y FROM g WHERE day = (SELECT max(day) FROM days))"""


def _items(spark, d):
    """(item, grp, pmf, y)."""
    days = views.table(spark, d, "events").agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    return counts.daily_pmf(views.user_day_counts(spark, d), days)


def _counts(spark, d):
    items = _items(spark, d)
    return items.select("item", "pmf"), items.select("item", "y")


@query(f"{COUNTS} SELECT item, k, round(p, 6) AS p, round(cdf, 6) AS cdf FROM cdf")
def c1_pmf(spark, d):
    return counts.exploded(_counts(spark, d)[0], "item")


@query(f"{COUNTS} SELECT item, round(m, 6) AS mean, round(v - m * m, 6) AS var, round((v - m * m) / nullif(m, 0), 6) AS dispersion FROM (SELECT item, sum(k * p) AS m, sum(k * k * p) AS v FROM pk GROUP BY 1)")
def c2_moments(spark, d):
    return counts.moments(_counts(spark, d)[0], "item")


@query(f"{COUNTS} SELECT item, min(k) AS q FROM cdf WHERE cdf >= 0.9 - 1e-12 GROUP BY 1")
def c3_quantile(spark, d):
    return counts.quantile(_counts(spark, d)[0], 0.9, "item")


@query(
    f"""{COUNTS}, lo AS (SELECT item, min(k) AS lo FROM cdf WHERE cdf >= 0.05 - 1e-12 GROUP BY 1), hi AS (SELECT item, min(k) AS hi FROM cdf WHERE cdf >= 0.95 - 1e-12 GROUP BY 1)
SELECT item, round(CAST(hi - lo + 20 * greatest(lo - y, 0) + 20 * greatest(y - hi, 0) AS DOUBLE), 6) AS mis FROM lo JOIN hi USING (item) JOIN act USING (item)"""
)
def c10_interval_score(spark, d):
    pmf, y = _counts(spark, d)
    return counts.interval_score(pmf, y, "item")


@query(f"{COUNTS} SELECT item, round(sum(pow(cdf - CASE WHEN y <= k THEN 1 ELSE 0 END, 2)) + greatest(max(y) - max(k) - 1, 0), 6) AS rps FROM cdf JOIN act USING (item) GROUP BY 1")
def c11_ranked_probability_score(spark, d):
    pmf, y = _counts(spark, d)
    return counts.ranked_probability_score(pmf, y, "item")


@query(f"{COUNTS} SELECT count(*) AS items, round(avg(p), 6) AS mean_p0, round(avg(CASE WHEN y = 0 THEN 1.0 ELSE 0 END), 6) AS share_actual_zero FROM pk JOIN act USING (item) WHERE k = 0")
def c17_intermittency(spark, d):
    pmf, y = _counts(spark, d)
    return counts.intermittency(pmf, y, "item")


# studies, past errors and resampling


@query(
    f"""{FORECASTS}, per AS (SELECT f.origin, f.level, f.unique_id, method, avg(abs(y - y_hat)) AS mae, sqrt(avg((y - y_hat) * (y - y_hat))) AS rmse, 100 * avg(CASE WHEN y <> 0 THEN abs(y - y_hat) / y END) AS mape, avg(CASE WHEN y = 0 THEN 1.0 ELSE 0 END) AS zero_share, avg(abs(y - y_hat)) / nullif(any_value(scale), 0) AS mase
  FROM fc f JOIN scales s ON s.origin = f.origin AND s.unique_id = f.unique_id GROUP BY 1, 2, 3, 4), long AS (UNPIVOT per ON mae, rmse, mape, zero_share, mase INTO NAME metric VALUE value),
lv AS (SELECT origin, level, method, metric, avg(value) AS value FROM long GROUP BY 1, 2, 3, 4)
SELECT CAST(a.level AS BIGINT) AS level, a.metric, a.method, round(1 - avg(a.value) / nullif(avg(r.value), 0), 6) + 0.0 AS gain, count(DISTINCT a.origin) AS n FROM lv a JOIN lv r ON r.origin = a.origin AND r.level = a.level AND r.metric = a.metric AND r.method = 'bu' GROUP BY 1, 2, 3"""
)
def m11_gain_by_metric(spark, d):
    s = Study.of(spark, d)
    return metrics.gain_by_metric(metrics.error_metrics(s.reconciled(), s.scales(), s.nodes), "bu")


_STUDY = "CASE WHEN date_part('year', {}) < 2000 THEN 'early' ELSE 'late' END"


@query(f"{FORECASTS} SELECT {_STUDY.format('origin')} AS study, {_L}, method, round(1 - avg(mase) / nullif(avg(ref), 0), 6) + 0.0 AS gain, round(avg(CASE WHEN mase < ref - 1e-9 THEN 1.0 ELSE 0 END), 6) AS win_share, count(DISTINCT origin) AS n FROM paired GROUP BY 1, level, method")
def m14_study_summary(spark, d):
    levels = Study.of(spark, d).levels().withColumn("study", F.when(F.year("origin") < 2000, "early").otherwise("late"))
    return metrics.aggregate_gain(levels, "bu", "study")


@query(
    f"""{FORECASTS}, err AS (SELECT origin, unique_id, y - y_hat AS e FROM fc WHERE method = 'base'), fin AS (SELECT a.origin, b.origin AS past FROM origins a JOIN origins b ON b.origin + INTERVAL 6 MONTH <= a.origin),
enough AS (SELECT origin FROM fin GROUP BY 1 HAVING count(*) >= 2), pv AS (SELECT fin.origin, unique_id, var_samp(e) AS v FROM fin JOIN enough USING (origin) JOIN err ON err.origin = fin.past GROUP BY 1, 2),
src AS (SELECT fc0.*, pv.v FROM fc0 JOIN pv ON pv.origin = fc0.origin AND pv.unique_id = fc0.unique_id),{two_pass("pe", "f.v", "src")}
SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, horizon, round(mu, 6) AS y_hat FROM pe"""
)
def r9_past_error_variances(spark, d):
    s = Study.of(spark, d)
    errors = backtest.with_actuals(s.own(), s.series).withColumn("e", F.col("y") - F.col("y_hat"))
    variances = backtest.past_error_variances(errors, s.origins, HORIZON, 2)
    return reconcile.tree_least_squares(s.own(), s.nodes, variances, len(KEYS)).select("origin", "unique_id", "ds", "horizon", "y_hat")


def uniform(*parts: str) -> str:
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)})), 1, 8) AS BIGINT) / 4294967296.0)"


@query(
    f"""{FORECASTS}, o AS (SELECT origin, row_number() OVER (ORDER BY origin) - 1 AS pick, count(*) OVER () AS n FROM (SELECT DISTINCT origin FROM levels)),
dr AS (SELECT rep, CAST(floor({uniform("0", "rep", "slot")} * 5) AS BIGINT) AS pick FROM range(1, 201) a(rep), range(1, 6) b(slot)),
mm AS (SELECT rep, level, method, round(avg(mase), 9) AS mase FROM dr JOIN o USING (pick) JOIN levels ON levels.origin = o.origin GROUP BY 1, 2, 3), rk AS (SELECT *, rank() OVER (PARTITION BY rep, level ORDER BY mase) AS r FROM mm)
SELECT {_L}, method, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0 END), 6) AS p_best, round(avg(r), 6) AS mean_rank, round(quantile_cont(CAST(r AS DOUBLE), 0.05), 6) AS rank_05, round(quantile_cont(CAST(r AS DOUBLE), 0.95), 6) AS rank_95 FROM rk GROUP BY level, method"""
)
def m13_rank_probabilities(spark, d):
    return resample.rank_probabilities(Study.of(spark, d).levels())


_BOOT = f"""{RESIDUALS}, inst AS (SELECT origin, ds, row_number() OVER (PARTITION BY origin ORDER BY ds) - 1 AS pick, count(*) OVER (PARTITION BY origin) AS n FROM (SELECT DISTINCT origin, ds FROM resid)),
dr AS (SELECT DISTINCT i.origin, rep, CAST(floor({uniform("0", "rep", "1")} * n) AS BIGINT) AS pick FROM (SELECT DISTINCT origin, n FROM inst) i, range(1, 102) a(rep)),
sh AS (SELECT d.origin, d.rep, r.unique_id, r.e FROM dr d JOIN inst i ON i.origin = d.origin AND i.pick = d.pick JOIN resid r ON r.origin = d.origin AND r.ds = i.ds),
sm AS (SELECT f.origin, f.ds, s.rep, e.unique_id, sum(f.base + s.e) AS v FROM fc0 f JOIN sh s ON s.origin = f.origin AND s.unique_id = f.unique_id JOIN edges e ON e.leaf_id = f.unique_id GROUP BY 1, 2, 3, 4),
qs AS (SELECT origin, unique_id, ds, quantile_cont(v, 0.9) AS q_hat FROM sm GROUP BY 1, 2, 3)"""


def _quantiles(s: Study) -> DataFrame:
    return resample.joint_bootstrap_quantiles(s.own(), s.residuals(), s.edges, 0.9)


@query(f"{_BOOT} SELECT {stamp('origin')} AS origin, unique_id, {stamp('ds')} AS ds, round(q_hat, 5) AS q_hat FROM qs", digits=5)
def r12_joint_bootstrap(spark, d):
    return _quantiles(Study.of(spark, d))


@query(f"{_BOOT} SELECT CAST(h.level AS BIGINT) AS level, round(avg(CASE WHEN y <= q_hat THEN 1.0 ELSE 0 END), 6) AS coverage, count(*) AS n FROM qs JOIN hier h ON h.unique_id = qs.unique_id AND h.ds = qs.ds GROUP BY 1")
def r13_coverage(spark, d):
    s = Study.of(spark, d)
    return resample.coverage(_quantiles(s), s.series, s.nodes)


@query(
    f"""{FORECASTS}, l AS (SELECT b.unique_id, b.ds, abs(b.y - b.y_hat) - abs(w.y - w.y_hat) AS e FROM fc b JOIN fc w ON w.origin = b.origin AND w.unique_id = b.unique_id AND w.ds = b.ds AND w.method = 'wls_struct' WHERE b.method = 'base'),
x AS (SELECT unique_id, e - avg(e) OVER (PARTITION BY unique_id) AS d, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS t, count(*) OVER (PARTITION BY unique_id) AS n FROM l),
g AS (SELECT a.unique_id, k AS lag, sum(a.d * b.d) / max(a.n) AS g, max(a.n) AS n FROM x a JOIN x b ON b.unique_id = a.unique_id JOIN range(0, 6) r(k) ON b.t = a.t + k GROUP BY 1, 2),
v AS (SELECT unique_id, sum(CASE WHEN lag = 0 THEN g ELSE 2 * g END) AS v, max(n) AS n FROM g GROUP BY 1), m AS (SELECT unique_id, avg(e) AS mean FROM l GROUP BY 1)
SELECT unique_id, n, round(CASE WHEN v > 0 THEN mean / sqrt(v / n) * sqrt((n + 1 - 12 + 30.0 / n) / n) END, 4) AS dm FROM v JOIN m USING (unique_id)""",
    digits=4,
)
def t7_diebold_mariano(spark, d):
    f = Study.of(spark, d).reconciled()
    keys = ["origin", "unique_id", "ds"]
    loss = {m: f.filter(F.col("method") == m).select(*keys, F.abs(F.col("y") - F.col("y_hat")).alias(m)) for m in ("base", "wls_struct")}
    both = loss["base"].join(loss["wls_struct"], keys).select("unique_id", "ds", (F.col("base") - F.col("wls_struct")).alias("e"))
    return inference.diebold_mariano(both, ["unique_id"], HORIZON)


_EXT = """, one AS (SELECT ds, sum(y) AS y FROM filled GROUP BY 1), ext AS (SELECT a.ds, a.y, 0.97 * b.y AS ext FROM one a LEFT JOIN one b ON b.ds = a.ds - INTERVAL 24 HOUR),
orig AS (SELECT date_trunc('day', (SELECT max(ds) FROM one)) - to_days(CAST(k AS INTEGER)) AS origin FROM range(1, 8) t(k)),
bias AS (SELECT origin, avg(ext - y) AS bias FROM orig JOIN ext ON ds < origin AND ds >= origin - INTERVAL 168 HOUR GROUP BY 1),
fx AS (SELECT o.origin, e.ds, e.ext AS raw, e.ext - bias AS debiased FROM orig o JOIN ext e ON e.ds >= o.origin AND e.ds < o.origin + INTERVAL 24 HOUR LEFT JOIN bias b ON b.origin = o.origin)"""


def _external(spark, d):
    total = _filled(spark, d).groupBy("ds").agg(F.sum("y").alias("y"))
    before = total.select((F.col("ds") + F.expr("INTERVAL 24 HOURS")).alias("ds"), (0.97 * F.col("y")).alias("ext"))
    official = total.join(before, "ds", "left")
    last = total.agg(F.date_trunc("day", F.max("ds")).alias("last"))
    origins = last.select(F.explode(F.expr("sequence(last - INTERVAL 7 DAYS, last - INTERVAL 1 DAY, INTERVAL 1 DAY)")).alias("origin"))
    return official, backtest.external_forecast(official, origins, 24, 168)


@query(f"{EVENTS}{_EXT} SELECT {stamp('origin')} AS origin, {stamp('ds')} AS ds, round(raw, 8) AS raw, round(debiased, 8) AS debiased FROM fx", digits=8)
def b8_external_forecast(spark, d):
    return _external(spark, d)[1]


@query(f"{EVENTS}{_EXT} SELECT {stamp('origin')} AS origin, round(avg(abs(one.y - raw)), 6) AS raw, round(avg(abs(one.y - debiased)), 6) AS debiased FROM fx JOIN one ON one.ds = fx.ds GROUP BY origin")
def m15_external_errors(spark, d):
    official, forecast = _external(spark, d)
    return forecast.join(official.select("ds", "y"), "ds").groupBy("origin").agg(F.avg(F.abs(F.col("y") - F.col("raw"))).alias("raw"), F.avg(F.abs(F.col("y") - F.col("debiased"))).alias("debiased"))


@query(
    f"""{RESIDUALS}, own AS (SELECT r.origin, r.ds, e.unique_id, e.leaf_id, r.e FROM resid r JOIN edges e ON e.leaf_id = r.unique_id), l AS (SELECT origin, unique_id, leaf_id, quantile_cont(e, 0.9) AS q FROM own GROUP BY 1, 2, 3),
ls AS (SELECT origin, unique_id, sum(q) AS s FROM l GROUP BY 1, 2), w AS (SELECT origin, unique_id, ds, sum(e) AS e FROM own GROUP BY 1, 2, 3), ws AS (SELECT origin, unique_id, quantile_cont(e, 0.9) AS q FROM w GROUP BY 1, 2)
SELECT {stamp('ls.origin')} AS origin, ls.unique_id, round(s, 3) AS sum_of_quantiles, round(q, 3) AS quantile_of_sum FROM ls JOIN ws ON ws.origin = ls.origin AND ws.unique_id = ls.unique_id""",
    digits=3,
)
def r14_quantile_of_sum(spark, d):
    s = Study.of(spark, d)
    return resample.quantile_of_sum(s.residuals(), s.edges, 0.9)


@query(
    f"""{COUNTS}, md AS (SELECT item, min(k) AS q FROM cdf WHERE cdf >= 0.5 - 1e-12 GROUP BY 1), lo AS (SELECT item, min(k) AS lo FROM cdf WHERE cdf >= 0.05 - 1e-12 GROUP BY 1), hi AS (SELECT item, min(k) AS hi FROM cdf WHERE cdf >= 0.95 - 1e-12 GROUP BY 1),
rp AS (SELECT item, sum(pow(cdf - CASE WHEN y <= k THEN 1 ELSE 0 END, 2)) + greatest(max(y) - max(k) - 1, 0) AS rps FROM cdf JOIN act USING (item) GROUP BY 1)
SELECT item % 10 AS grp, round(avg(abs(q - y)), 6) AS median_error, round(avg(hi - lo + 20 * greatest(lo - y, 0) + 20 * greatest(y - hi, 0)), 6) AS mis, round(avg(rps), 6) AS rps FROM md JOIN lo USING (item) JOIN hi USING (item) JOIN rp USING (item) JOIN act USING (item) GROUP BY 1"""
)
def c12_level_scores(spark, d):
    pmf, y = _counts(spark, d)
    scores = counts.item_scores(pmf, y, "item")
    return scores.groupBy((F.col("item") % 10).alias("grp")).agg(*(F.avg(c).alias(c) for c in ("median_error", "mis", "rps")))


@query(
    f"""{FORECASTS}, s AS (SELECT m.unique_id, m.method, m.mase / nullif(r.mase, 0) - 1 AS c FROM mase m JOIN mase r ON r.origin = m.origin AND r.unique_id = m.unique_id AND r.method = 'base' WHERE m.method IN ('ols', 'wls_struct'))
SELECT unique_id, method, round(avg(c), 6) + 0.0 AS mean, round(avg(CASE WHEN c < -1e-9 THEN 1.0 ELSE 0 END), 6) AS win_share, count(c) AS n FROM s GROUP BY 1, 2"""
)
def t9_change_by_series(spark, d):
    s = Study.of(spark, d)
    return metrics.change_by_series(metrics.mase(s.reconciled(), s.scales(), s.nodes), "base", ["ols", "wls_struct"])
