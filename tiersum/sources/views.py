"""The supplied tables as leaf series of a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complete_grid(leaves: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Every key at every instant from the first to the last of the table, a missing y being 0."""
    span = leaves.agg(F.min("ds").alias("first"), F.max("ds").alias("last"))  # one row
    grid = leaves.select(*keys).distinct().join(F.broadcast(span)).select(*keys, F.explode(F.expr(f"sequence(first, last, interval {step})")).alias("ds"))
    return grid.join(leaves, [*keys, "ds"], "left").select(*keys, "ds", F.coalesce("y", F.lit(0.0)).alias("y"))


#: The tables that monthly_revenue reads.
REVENUE_TABLES = ["orders", "customer", "nation", "region"]


def monthly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, nation, ds, y): revenue in thousands by month of order, on a complete grid."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.date_trunc("month", "o_orderdate").alias("ds"), "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = F.broadcast(places.select("n_nationkey", F.col("r_name").alias("region"), F.col("n_name").alias("nation")))  # a fixed dimension of nations
    sums = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "ds").agg(F.sum("o_totalprice").alias("s"))
    leaves = sums.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select("region", "nation", "ds", F.round(F.col("s") / 1000, 5).alias("y"))
    return complete_grid(leaves, ["region", "nation"], "1 month")


def half_hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region, ds, y): one raw row per event, its type as region, its time floored to 30 minutes."""
    floor = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 1800) * 1800)
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("region"), floor.alias("ds"), F.round("value", 4).alias("y"))


def user_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, grp, day, k): events of each user on each day with any of theirs. Days without events are left to the histogram."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.to_date("ts").alias("day"))
    return events.groupBy("item", "day").agg(F.count("*").alias("k")).select("item", (F.col("item") % 10).alias("grp"), "day", "k")
