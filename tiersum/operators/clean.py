"""Cleaning of raw interval data. raw: (region, ds, y), with repeated instants, missing slots and null values."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize


def distinct_instants(raw: DataFrame) -> DataFrame:
    """(region, ds, y, n, spread): the mean of each instant's values, their number and their range."""
    return raw.groupBy("region", "ds").agg(F.avg("y").alias("y"), F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("spread"))


def duplicate_counts(instants: DataFrame) -> DataFrame:
    """(region, rows, duplicates_identical, duplicates_conflicting, missing_values)."""
    many = F.col("n") > 1
    return instants.groupBy("region").agg(F.sum("n").alias("rows"), F.count_if(many & (F.col("spread") == 0)).alias("duplicates_identical"), F.count_if(many & (F.col("spread") > 0)).alias("duplicates_conflicting"), F.count_if(F.col("y").isNull()).alias("missing_values"))


def complete_slots(instants: DataFrame, minutes: int = 30) -> DataFrame:
    """(region, ds, y, present): each region's grid from its first to its last instant; missing slots have a null y."""
    span = instants.groupBy("region").agg(F.min("ds").alias("a"), F.max("ds").alias("b"))
    grid = span.select("region", F.explode(F.expr(f"sequence(a, b, interval {minutes} minutes)")).alias("ds"))
    own = instants.select("region", "ds", "y", F.lit(True).alias("present"))
    return grid.join(own, ["region", "ds"], "left").select("region", "ds", "y", F.coalesce("present", F.lit(False)).alias("present"))


def hourly_mean(slots: DataFrame) -> DataFrame:
    """(region, ds, y): the mean of an hour's known slots, never their sum; an hour without any is null."""
    return slots.groupBy("region", F.date_trunc("hour", "ds").alias("ds")).agg(F.avg("y").alias("y"))


def gaps(hourly: DataFrame) -> DataFrame:
    """(region, start, hours): runs of null hours."""
    order = Window.partitionBy("region").orderBy("ds")
    marked = hourly.withColumn("island", F.row_number().over(order) - F.sum(F.col("y").isNull().cast("int")).over(order))
    return marked.filter("y is null").groupBy("region", "island").agg(F.min("ds").alias("start"), F.count("*").alias("hours")).drop("island")


def long_gaps(hourly: DataFrame, max_gap_hours: int = 1) -> DataFrame:
    """The gaps that are longer than allowed."""
    return gaps(hourly).filter(F.col("hours") > max_gap_hours)


def refuse_long_gaps(hourly: DataFrame, max_gap_hours: int = 1) -> DataFrame:
    """hourly itself; raises, naming start and length, if a gap is longer than allowed."""
    bad = long_gaps(hourly, max_gap_hours).orderBy("start").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['region']}: no data for {bad[0]['hours']} h from {bad[0]['start']}")
    return hourly


def interpolated(hourly: DataFrame) -> DataFrame:
    """(region, ds, y, imputed): interior gaps filled in a straight line; nulls at the ends stay."""
    back = Window.partitionBy("region").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("region").orderBy("ds").rowsBetween(0, Window.unboundedFollowing)
    t = F.unix_timestamp("ds").cast("double")
    known = F.when(F.col("y").isNotNull(), t)
    ends = hourly.select("region", "ds", "y", t.alias("t"), F.last("y", True).over(back).alias("y0"), F.last(known, True).over(back).alias("t0"), F.first("y", True).over(ahead).alias("y1"), F.first(known, True).over(ahead).alias("t1"))
    line = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("t") - F.col("t0")) / (F.col("t1") - F.col("t0"))
    filled = F.when(F.col("y").isNotNull(), F.col("y")).otherwise(line)
    return ends.select("region", "ds", filled.alias("y"), (F.col("y").isNull() & filled.isNotNull()).alias("imputed"))


def _within(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    out = df if start is None else df.filter(F.col("ds") >= F.lit(start).cast("timestamp"))
    return out if end is None else out.filter(F.col("ds") < F.lit(end).cast("timestamp"))


def quality_table(raw: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per region: rows, duplicates, missing slots and values of all its raw rows; null hours and the longest run of them in [start, end).

    Every null hour in range counts as imputed, those at the ends too, which no line can fill. Regions without any hour in range have 0.
    """
    instants = distinct_instants(raw)
    slots = complete_slots(instants)
    hours = hourly_mean(_within(slots, start, end))
    missing = slots.groupBy("region").agg(F.count_if(~F.col("present")).alias("missing_halfhours"))
    nulls = hours.groupBy("region").agg(F.count_if(F.col("y").isNull()).alias("imputed_hours"))
    longest = gaps(hours).groupBy("region").agg(F.max("hours").alias("longest_gap_hours"))
    out = duplicate_counts(instants).join(missing, "region").join(nulls, "region", "left").join(longest, "region", "left")
    return out.fillna(0, ["imputed_hours", "longest_gap_hours"])


class Prepared(NamedTuple):
    """hourly: (region, ds, y, imputed), imputed telling that the hour had no value; quality: `quality_table` of the same range."""

    hourly: DataFrame
    quality: DataFrame


def prepare_all(raw: DataFrame, start: str, end: str, max_gap_hours: int = 1) -> Prepared:
    """All steps for all regions at once: instants, grid, the range [start, end), hourly means, refusal of long gaps, straight lines.

    Raises, naming region, start and length, if a run of null hours in range, at the ends too, is longer than max_gap_hours. Hours outside the range are never
    used to fill one inside.
    """
    hours = materialize(hourly_mean(_within(complete_slots(distinct_instants(raw)), start, end)), "hours")
    filled = interpolated(refuse_long_gaps(hours, max_gap_hours)).drop("imputed").join(hours.select("region", "ds", F.col("y").isNull().alias("imputed")), ["region", "ds"])
    return Prepared(filled.select("region", "ds", "y", "imputed"), quality_table(raw, start, end))


def prepare(raw: DataFrame, start: str, end: str, max_gap_hours: int = 1) -> DataFrame:
    """The hourly table of `prepare_all`."""
    return prepare_all(raw, start, end, max_gap_hours).hourly


def completeness(series: DataFrame) -> DataFrame:
    """(check, violations): null or non-finite values, and differing first dates, last dates and lengths of the series."""
    per = series.groupBy("unique_id").agg(F.min("ds").alias("a"), F.max("ds").alias("b"), F.count("*").alias("n"), F.count_if(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))).alias("bad"))
    sums = per.agg(F.sum("bad").alias("values"), (F.count_distinct("a") - 1).alias("first_dates"), (F.count_distinct("b") - 1).alias("last_dates"), (F.count_distinct("n") - 1).alias("lengths"))
    return sums.unpivot([], ["values", "first_dates", "last_dates", "lengths"], "check", "violations")


def short_name(unique_id, names: dict[str, str] | None = None):
    """The last part of a path, or its name in a dictionary."""
    last = F.element_at(F.split(unique_id, "/"), -1)
    if not names:
        return last
    pairs = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(pairs[last], last)
