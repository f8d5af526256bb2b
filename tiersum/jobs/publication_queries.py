"""Registered queries: raw files made from the supplied tables and read back, manifests, the registry and the gated job."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize, scratch_dir
from tiersum.jobs import publication
from tiersum.jobs.queries import _DIGESTS, _L, EVENTS, LEAVES, query, stamp
from tiersum.jobs.study import HORIZON, KEYS, SEASON, Study
from tiersum.operators import hierarchy
from tiersum.sources import raw, views

#: A short code of each event type, as raw files have them.
CODES = {"c1": "click", "c2": "view", "c3": "purchase", "c4": "signup", "c5": "error"}


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _instant(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ssXXX")


def _raw_files(spark, d) -> str:
    """Half-hourly values of the events by code, as semicolon files."""
    path, events = _folder(spark, "raw"), views.half_hourly_events(spark, d)
    code = F.create_map(*(F.lit(x) for c, n in CODES.items() for x in (n, c)))
    events.select(F.coalesce(code[F.col("region")], F.col("region")).alias("code"), _instant("ds").alias("ds"), "y").write.option("sep", ";").option("header", "true").csv(path)
    return path


@query(f"{EVENTS} SELECT region, {stamp('ds')} AS ds, round(y, 6) AS y, count(*) AS n FROM ev GROUP BY 1, 2, 3")
def io1_raw_regional(spark, d):
    return raw.read_regional(spark, _raw_files(spark, d), CODES).groupBy("region", "ds", "y").agg(F.count("*").alias("n"))


@query(f"{EVENTS}, t AS (SELECT ds, sum(y) AS y, count(*) AS n FROM ev GROUP BY 1) SELECT {stamp('t.ds')} AS ds, round(t.y, 6) AS y, round(b.y * 0.97, 6) AS ext FROM t LEFT JOIN t b ON b.ds = t.ds - INTERVAL 24 HOUR")
def io2_raw_official(spark, d):
    total = materialize(views.half_hourly_events(spark, d).groupBy("ds").agg(F.sum("y").alias("y")), "total")
    before = total.select((F.col("ds") + F.expr("INTERVAL 24 HOURS")).alias("ds"), (0.97 * F.col("y")).alias("ext"))
    path = _folder(spark, "official")
    total.join(before, "ds", "left").select(_instant("ds").alias("ds"), "y", "ext").write.option("sep", ";").option("header", "true").csv(path)
    return raw.read_official(spark, path)


@query(f"{LEAVES} SELECT 'robustness' AS study, {_L}, unique_id, {stamp('ds')} AS ds, round(y, 6) AS y FROM hier")
def io3_result_table(spark, d):
    """Series written as a result table by study, and read from there."""
    path = _folder(spark, "results")
    Study.of(spark, d).series.withColumn("study", F.lit("robustness")).write.partitionBy("study").parquet(path)
    return spark.read.parquet(path).select("study", "level", "unique_id", "ds", "y")


@query("SELECT * FROM (VALUES ('changed', 1), ('missing', 1)) v(problem, files)")
def io4_manifest(spark, d):
    """All raw files against their manifest, in which one hash and one name are wrong."""
    path = _raw_files(spark, d)
    own = materialize(raw.manifest_of(spark, path).filter("file like 'part-%'"), "manifest")
    first = own.agg(F.min("file").alias("first"))
    wrong = own.join(F.broadcast(first)).select("file", F.when(F.col("file") == F.col("first"), F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    wrong = wrong.union(first.select(F.concat(F.lit("lost-"), "first"), F.sha2(F.lit("lost"), 256)))
    return raw.manifest_violations(spark, path, wrong).groupBy("problem").agg(F.count("*").alias("files"))


_LINES = "l AS (SELECT event_type AS region, strftime(ts, '%Y-%m-%d') || ';' || count(*) AS line FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d')), s AS (SELECT region, sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS sha256 FROM l GROUP BY 1)"


@query(f"WITH {_LINES} SELECT region, sha256, CASE WHEN region = (SELECT min(region) FROM s) THEN 'changed' END AS problem FROM s UNION ALL SELECT 'lost', NULL, 'missing'")
def io4_streamed_digests(spark, d):
    """A file of daily counts for each event type: what each hashes to, against a manifest with one wrong digest and one file too many."""
    path = _folder(spark, "daily")
    days = views.table(spark, d, "events").groupBy(F.col("event_type").alias("region"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    lines = days.select("region", F.concat_ws(";", "day", F.col("n").cast("string")).alias("value"))
    lines.repartition("region").sortWithinPartitions("region", "value").write.partitionBy("region").text(path)
    own = materialize(raw.manifest_of(spark, path).filter("file like 'region=%/part-%'"), "manifest")
    named = own.select("file", F.regexp_extract("file", "region=([^/]+)/", 1).alias("region"), "sha256")
    first = named.agg(F.min("region").alias("first"))
    wrong = named.join(F.broadcast(first)).select("file", F.when(F.col("region") == F.col("first"), F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    problems = raw.manifest_violations(spark, path, wrong.union(spark.sql("select 'region=lost/part-0' as file, 'x' as sha256")))
    both = named.select("file", "sha256").join(problems, "file", "full")
    return both.select(F.regexp_extract("file", "region=([^/]+)/", 1).alias("region"), "sha256", "problem")


@query(f"{LEAVES}{_DIGESTS}, h AS (SELECT sha256(string_agg('0:' || d2, '')) AS s_hash FROM (SELECT sha256(string_agg(d, '' ORDER BY d)) AS d2 FROM digests)) SELECT sha256('other') AS registered, s_hash FROM h")
def h4_hash_violations(spark, d):
    """The hierarchy against a registry that knows its version with another hash, and another version with any."""
    current = hierarchy.fingerprint(Study.of(spark, d).edges, buckets=1)
    known = spark.sql("select 'v1' as source, sha2('other', 256) as s_hash union all select 'v2', 'x'")
    return hierarchy.hash_violations(current, known, "v1").select("registered", "s_hash")


@query()
def g8_gated_job(spark, d):
    """Two runs of one version, with tolerances that let the reconciled forecasts pass and with one that no forecast can."""
    s, path = Study.of(spark, d), _folder(spark, "published")
    contract = publication.Contract(KEYS, HORIZON, SEASON, worse_by=1e6, negative_share=1.0, weights={0: 1.0, 1: 1.0, 2: 1.0})
    open_run = publication.run_job(s.leaves, contract, path, "v1", "open")
    contract.worse_by = -1.0
    return open_run.union(publication.run_job(s.leaves, contract, path, "v1", "blocked"))
