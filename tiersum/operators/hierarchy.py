"""Hierarchies: every level of a leaf table, the summing structure as edges, its fingerprint and additivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path(total: str | None, keys: list[str]) -> Column:
    """Joined path of a node: the total's name and its key values."""
    return F.concat_ws("/", *([F.lit(total)] if total else []), *keys)


def build_hierarchy(leaves: DataFrame, keys: list[str], total: str = "Total") -> DataFrame:
    """leaves(*keys, ds, y) -> (level, unique_id, ds, y), sums at the total and every prefix of keys.

    One pass with GROUPING SETS. level counts from 0 at the total. A null y is refused: a sum over it would be silently low.
    """
    checked = leaves.withColumn("y", F.when(F.col("y").isNull(), F.raise_error(F.lit("a leaf value is null"))).otherwise(F.col("y")))
    sets = [[F.col("ds"), *(F.col(k) for k in keys[:n])] for n in range(len(keys) + 1)]
    rolled = checked.groupingSets(sets, "ds", *keys).agg(F.sum("y").alias("y"), F.grouping_id().alias("gid"))
    level = len(keys) - F.bit_count("gid")  # the grouping id has a bit for each key that is summed over
    return rolled.select(level.cast("int").alias("level"), path(total, keys).alias("unique_id"), "ds", "y")


def nodes(leaves: DataFrame, keys: list[str], total: str = "Total") -> DataFrame:
    """(level, unique_id, parent, n_leaves): one row per node; the total's parent is null."""
    own = leaves.select(*keys).distinct()
    out = None
    for n in range(len(keys) + 1):
        at = own.groupBy(*keys[:n]).agg(F.count("*").alias("n_leaves")) if n else own.agg(F.count("*").alias("n_leaves"))
        up = path(total, keys[: n - 1]) if n else F.lit(None).cast("string")
        part = at.select(F.lit(n).alias("level"), path(total, keys[:n]).alias("unique_id"), up.alias("parent"), "n_leaves")
        out = part if out is None else out.union(part)
    return out


def edges(leaves: DataFrame, keys: list[str], total: str = "Total") -> DataFrame:
    """(unique_id, leaf_id, level): the ones of the summing matrix, a leaf's own included."""
    above = F.array(*(F.struct(path(total, keys[:n]).alias("unique_id"), F.lit(n).alias("level")) for n in range(len(keys) + 1)))
    return leaves.select(*keys).distinct().select(path(total, keys).alias("leaf_id"), F.explode(above).alias("e")).select("e.unique_id", "leaf_id", "e.level")


def fingerprint(edge_table: DataFrame, buckets: int = 64) -> DataFrame:
    """(s_hash): SHA-256 over all edges, in two steps: digests of sorted buckets, then the digest of those."""
    row = F.sha2(F.concat_ws("|", "unique_id", "leaf_id", "level"), 256).alias("d")
    bucket = F.pmod(F.crc32(F.col("d").cast("binary")), F.lit(buckets)).alias("b")
    parts = edge_table.select(row).withColumn("b", bucket).groupBy("b").agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list("d"))), 256).alias("d"))
    return parts.agg(F.sha2(F.concat_ws("", F.sort_array(F.collect_list(F.concat_ws(":", F.col("b").cast("string"), "d")))), 256).alias("s_hash"))


def hash_violations(current: DataFrame, registry: DataFrame, source: str) -> DataFrame:
    """current(s_hash), registry(source, s_hash) -> the registered hashes of this source that differ."""
    known = registry.filter(F.col("source") == source).select("source", F.col("s_hash").alias("registered"))
    return known.join(F.broadcast(current)).filter("registered <> s_hash")


def additivity(leaves: DataFrame, official: DataFrame) -> DataFrame:
    """leaves(region, ds, y), official(ds, y) -> (ds, gap): official less the sum of leaves, null unless all leaves are there."""
    want = leaves.select("region").distinct().agg(F.count("*").alias("want"))
    sums = leaves.groupBy("ds").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    joined = official.select("ds", F.col("y").alias("total")).join(sums, "ds", "left").join(F.broadcast(want))
    return joined.select("ds", F.when(F.col("n") == F.col("want"), F.col("total") - F.col("s")).alias("gap"))


def additivity_by(gaps: DataFrame, unit: str, tolerance: float) -> DataFrame:
    """(period, median_gap, max_gap, above): absolute gaps by calendar unit."""
    size = F.abs("gap")
    out = gaps.groupBy(F.date_trunc(unit, "ds").alias("period")).agg(F.median(size).alias("median_gap"), F.max(size).alias("max_gap"))
    return out.withColumn("above", F.col("max_gap") > tolerance)


def profile(series: DataFrame, *keys: str) -> DataFrame:
    """(*keys, n, mean, sd) of y."""
    return series.groupBy(*keys).agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"))
