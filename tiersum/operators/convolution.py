"""Sums of independent counts by a tree of convolutions, and draws of the items given their sums.

Items of a group are dealt into buckets of about FAN, buckets into buckets of buckets, up to one node a group. Every node is a task's work, in
which at most a few hundred distributions are folded or a total is split among them; only the arrays of sums are as long as a group's reach.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize

FAN = 256
#: Arrays that are both longer than this are folded by Fourier transforms, in which probabilities below TINY of the largest are lost in rounding and count as 0.
DIRECT, TINY = 1024, 1e-15
#: Cells of a matrix of conditional probabilities at most, unless one total needs more.
CELLS = 1 << 21


def fold(a: np.ndarray, b: np.ndarray, top: int | None = None) -> np.ndarray:
    """Distribution of the sum of two independent counts, without what is above `top`. It reaches as far as both together, though the ends may be too small for a number and read 0."""
    if min(len(a), len(b)) <= DIRECT:
        out = np.convolve(a, b)
    else:
        n = len(a) + len(b) - 1
        size = 1 << (n - 1).bit_length()
        out = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n]
        out[out < TINY * out.max()] = 0.0
    return out if top is None else out[: top + 1]


def reach(pmf: np.ndarray) -> np.ndarray:
    """The array up to its last value above 0."""
    used = np.flatnonzero(pmf)
    return pmf[: used[-1] + 1] if len(used) else pmf[:1]


def _layers(pmfs: list[np.ndarray], top: int | None) -> list[list[np.ndarray]]:
    """The distributions, those of sums of two, of four, ... up to that of all."""
    out = [[p if top is None else p[: top + 1] for p in pmfs]]
    while len(out[-1]) > 1:
        low = out[-1]
        out.append([fold(low[k], low[k + 1], top) if k + 1 < len(low) else low[k] for k in range(0, len(low), 2)])
    return out


def total_pmf(pmfs: list[np.ndarray], top: int | None = None) -> np.ndarray:
    return _layers(pmfs, top)[-1][0] if pmfs else np.ones(1)


def draw_left(left: np.ndarray, right: np.ndarray, totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """For each total, which both can reach together, a value of the left count drawn given that total."""
    distinct, at = np.unique(totals, return_inverse=True)
    u, out = rng.random(len(totals)), np.zeros(len(totals), np.int64)
    step = max(1, CELLS // len(left))
    for lo in range(0, len(distinct), step):
        own = distinct[lo : lo + step]
        a = np.arange(min(len(left), int(own[-1]) + 1))
        rest = own[:, None] - a[None, :]
        share = np.where((rest >= 0) & (rest < len(right)), left[a][None, :] * right[np.clip(rest, 0, len(right) - 1)], 0.0)
        reach = np.cumsum(share, axis=1)
        here = np.flatnonzero((at >= lo) & (at < lo + step))
        rows = at[here] - lo
        last = np.array([np.flatnonzero(s)[-1] for s in share])
        for k in range(0, len(here), step):
            part, own_rows = here[k : k + step], rows[k : k + step]
            found = (reach[own_rows] <= (u[part] * reach[own_rows, -1])[:, None]).sum(axis=1)
            out[part] = np.minimum(found, last[own_rows])
    return out


def split_totals(pmfs: list[np.ndarray], totals: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One value for each item and total, drawn given that they add up to the total. Totals beyond the items' reach give -1 everywhere."""
    totals = np.asarray(totals)
    out = np.full((len(pmfs), len(totals)), -1)
    layers = _layers([reach(np.asarray(p, float)) for p in pmfs], max(0, int(totals.max(initial=0))))
    whole = layers[-1][0]
    ok = np.flatnonzero((totals >= 0) & (totals < len(whole)) & (whole[np.clip(totals, 0, len(whole) - 1)] > 0))
    if not len(ok):
        return out
    now = [totals[ok].astype(np.int64)]
    for low in layers[-2::-1]:
        below = []
        for k, t in enumerate(now):
            if 2 * k + 1 < len(low):
                a = draw_left(low[2 * k], low[2 * k + 1], t, rng)
                below += [a, t - a]
            else:
                below.append(t)
        now = below
    out[:, ok] = np.stack(now)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many tasks as the session works with. Arrays are small as files and long to work on, so that Spark's own sizes would put them into one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table whose size Spark knows; no Python worker is started to read them."""
    names = [part.split()[0] for part in schema.split(", ")]
    return spark.createDataFrame(pa.table([list(column) for column in zip(*rows)], names), schema) if rows else spark.createDataFrame([], schema)


NODE = "group string, node string, pmf array<double>"


def _tree(pmfs: DataFrame, groups: DataFrame, tops: dict[str, int] | None) -> list[DataFrame]:
    """pmfs(item, pmf), groups(item, group) -> layers (group, parent, node, pmf) from the items up, the last having one node a group and no parent."""
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / FAN).alias("parents"))
    most = sizes.agg(F.max("parents")).first()[0] or 1
    parent = F.pmod(F.xxhash64("item"), F.col("parents"))
    layers = [pmfs.join(groups, "item").join(sizes, "group").select("group", parent.alias("parent"), F.col("item").cast("string").alias("node"), "pmf")]
    last = F.greatest(F.lit(1), F.size("pmf") - F.coalesce(F.array_position(F.transform(F.reverse("pmf"), lambda x: x > 0), True) - 1, F.lit(0)))
    layers[0] = layers[0].withColumn("pmf", F.slice("pmf", F.lit(1), last.cast("int")))  # an item's zeros at the end are no part of its reach

    def up(children: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("node")
        name = children["group"].iloc[0]
        top = tops.get(name) if tops else None
        pmf = total_pmf([np.asarray(p, float) for p in children["pmf"]], top)
        return pd.DataFrame({"group": [name], "node": [str(children["parent"].iloc[0])], "pmf": [pmf]})

    while True:
        layers[-1] = materialize(layers[-1], "tree")
        nodes = spread(layers[-1], "group", "parent").groupBy("group", "parent").applyInPandas(up, NODE)
        layers.append(nodes.select("group", F.floor(F.col("node").cast("long") / FAN).alias("parent"), "node", "pmf"))
        if most == 1:
            layers[-1] = materialize(layers[-1], "tree")
            return layers
        most = -(-most // FAN)


def sum_pmfs(pmfs: DataFrame, groups: DataFrame) -> DataFrame:
    """pmfs(item, pmf), groups(item, group) -> (group, pmf): the exact distribution of each group's sum of independent items. Items may be in several groups."""
    return _tree(pmfs, groups, None)[-1].select("group", "pmf")


def split_lists(pmfs: DataFrame, groups: DataFrame, totals: dict[str, np.ndarray], seed: int = 0, layers: list[DataFrame] | None = None) -> DataFrame:
    """pmfs(item, pmf), groups(item, group), each group's drawn totals -> (group, item, ks): an array of draws for each item, drawn given that they add up to their group's total.

    Totals go down the tree, each node splitting its own among its children. Totals beyond a group's reach give -1 for all its items. Draws depend on seed, group and
    node only. The number of totals is the caller's; each row of the tree has as many.
    """
    spark = pmfs.sparkSession
    layers = layers or _tree(pmfs, groups, {g: max(0, int(np.max(t, initial=0))) for g, t in totals.items()})
    rows = [(g, "0", [int(x) for x in t]) for g, t in totals.items()]
    now = local_table(spark, rows, "group string, node string, totals array<long>")

    def down(depth: int):
        def split(children: pd.DataFrame, total: pd.DataFrame) -> pd.DataFrame:
            if not len(children) or not len(total):
                return pd.DataFrame(columns=["group", "node", "totals"])
            children = children.sort_values("node")
            name, node = children["group"].iloc[0], int(children["parent"].iloc[0])
            rng = np.random.default_rng([seed, zlib.crc32(name.encode()), depth, node])
            got = split_totals([np.asarray(p, float) for p in children["pmf"]], np.asarray(total["totals"].iloc[0]), rng)
            return pd.DataFrame({"group": name, "node": children["node"].to_numpy(), "totals": list(got)})

        return split

    for depth, layer in enumerate(layers[-2::-1]):
        keyed = spread(layer.withColumn("at", F.col("parent").cast("string")), "group", "at").groupBy("group", "at")
        above = spread(now.withColumn("at", F.col("node")), "group", "at").groupBy("group", "at")
        now = materialize(keyed.cogroup(above).applyInPandas(down(depth), "group string, node string, totals array<long>"), "split")
    return now.select("group", F.col("node").alias("item"), F.col("totals").alias("ks"))


def split_groups(pmfs: DataFrame, groups: DataFrame, totals: dict[str, np.ndarray], seed: int = 0, layers: list[DataFrame] | None = None) -> DataFrame:
    """split_lists with a row a draw: (group, item, sample, k)."""
    return split_lists(pmfs, groups, totals, seed, layers).select("group", "item", F.posexplode("ks").alias("sample", "k")).withColumn("k", F.col("k").cast("int"))


def window(mean: float, sd: float, own_mean: float, own_sd: float, size: int) -> tuple[int, int]:
    """The stretch of counts in which the product of a distribution and a normal density has its mass: twelve deviations around both means and all between."""
    low = min(mean - 12 * sd, own_mean - 12 * own_sd)
    high = max(mean + 12 * sd, own_mean + 12 * own_sd)
    first = int(min(max(0.0, np.floor(low)), size - 1))
    return first, int(max(min(size, np.ceil(high) + 1), first + 1))


def systematic(weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Positions resampled in proportion to the weights."""
    reach = np.cumsum(weights / weights.sum())
    return np.minimum(np.searchsorted(reach, (np.arange(len(weights)) + rng.random()) / len(weights), "right"), len(weights) - 1)


def draw_group_totals(first: list[int], pmfs: list[np.ndarray], inside: np.ndarray, mean: np.ndarray, cov: np.ndarray, samples: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Draws of all groups' totals from the product of their distributions and a normal density of the aggregates -> (samples x groups, effective sizes by aggregate).

    pmfs[g] starts at first[g]; inside[k, g]: aggregate k contains group g. Groups are drawn one after another, each given the former and every aggregate that it
    completes, whose density given the aggregates completed before is a factor; samples are resampled by what their next factor adds up to. So each aggregate has weights of its own.
    """
    last = np.array([np.flatnonzero(row)[-1] if row.any() else -1 for row in inside])
    sums, draws = np.zeros((samples, len(mean))), np.zeros((samples, len(pmfs)), np.int64)
    ess, done = np.full(len(mean), float(samples)), np.empty(0, int)
    for g, (low, pmf) in enumerate(zip(first, pmfs)):
        values, new = low + np.arange(len(pmf)), np.flatnonzero(last == g)
        with np.errstate(divide="ignore"):
            log_p = np.log(pmf)
        if len(new):
            link = cov[np.ix_(new, done)] @ np.linalg.pinv(cov[np.ix_(done, done)], hermitian=True) if len(done) else np.zeros((len(new), 0))
            rest = cov[np.ix_(new, new)] - link @ cov[np.ix_(done, new)]
            q = np.linalg.pinv((rest + rest.T) / 2, hermitian=True)
            gap = sums[:, new] - mean[new] - (sums[:, done] - mean[done]) @ link.T
            line, square, fixed = gap @ q.sum(axis=0), q.sum(), np.einsum("ij,jk,ik->i", gap, q, gap)
        else:
            line, square, fixed = np.zeros(samples), 0.0, np.zeros(samples)
        step, total = max(1, CELLS // len(pmf)), np.empty(samples)
        part = lambda at: log_p[None, :] - 0.5 * (fixed[at, None] + 2 * line[at, None] * values[None, :] + square * values[None, :].astype(float) ** 2)  # noqa: E731, B023
        for lo in range(0, samples, step):
            at = np.arange(lo, min(samples, lo + step))
            logs = part(at)
            top = logs.max(axis=1)
            total[at] = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
        weights = np.exp(total - total.max())
        if len(new):
            ess[new] = weights.sum() ** 2 / (weights**2).sum()
            kept = systematic(weights, rng)
            sums, draws, line, fixed = sums[kept], draws[kept], line[kept], fixed[kept]
        u = rng.random(samples)
        for lo in range(0, samples, step):
            at = np.arange(lo, min(samples, lo + step))
            logs = part(at)
            reach = np.cumsum(np.exp(logs - logs.max(axis=1)[:, None]), axis=1)
            draws[at, g] = values[np.minimum((reach <= (u[at] * reach[:, -1])[:, None]).sum(axis=1), len(pmf) - 1)]
        sums += draws[:, g][:, None] * inside[None, :, g]
        done = np.concatenate((done, new))
    return draws, ess
