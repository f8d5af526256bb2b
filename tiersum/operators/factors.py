"""Shrunk covariances of any number of series in factor form: W = intensity * D + (1 - intensity) * E'E / T, D the diagonal of E'E / T.

No row, matrix or message grows with the square of the number of series: only T x T matrices are formed, T being the instants
of the residuals, as sums over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize
from tiersum.operators.reconcile import covariance, shrunk, tree_least_squares
from tiersum.operators.reconcile import minimum_trace as dense_minimum_trace

#: Doubles of partial sums that a task holds before it gives them out.
HELD = 1 << 22
#: An intensity below this counts as this: the solve divides by the diagonal part.
LEAST_INTENSITY = 1e-9


def series_rows(residuals: DataFrame) -> DataFrame:
    """residuals(origin, unique_id, ds, e), complete -> (origin, unique_id, x): each series' residuals in order of time, one row a series."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("ds", "e"))), lambda s: s["e"])
    return residuals.groupBy("origin", "unique_id").agg(x.alias("x"))


def expanded(rows: DataFrame, least: int = 2, every: int = 1) -> DataFrame:
    """series rows -> (origin, t, unique_id, x): the first t instants, for t = least, least + every, ... up to all of them."""
    n = F.size("x")
    sizes = F.when(n >= least, F.sequence(F.lit(least), n, F.lit(every))).otherwise(F.array().cast("array<int>"))
    return rows.select("origin", "unique_id", "x", F.explode(sizes).alias("t")).select("origin", F.col("t").cast("long").alias("t"), "unique_id", F.slice("x", F.lit(1), F.col("t")).alias("x"))


def _stack(values: pd.Series) -> np.ndarray:
    if len({len(v) for v in values}) > 1:
        raise ValueError("arrays of unequal length: keep complete instants only")
    return np.stack(values.to_numpy()).astype(float)


def _summed(rows: DataFrame, keys: tuple[str, ...], inputs: list[str], products, width: int) -> DataFrame:
    """(*keys, s, row): sums over the rows of one key of products(*inputs as matrices), a matrix of `width` times as many columns as rows of the first's width.

    Each task adds up its own rows; only sums are shuffled, one row for each line of the matrix.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pd.DataFrame:
            frames = [pd.DataFrame([key], columns=list(keys)).loc[np.zeros(len(m), int)].assign(s=np.arange(len(m), dtype=np.int32), row=list(m)) for key, m in held.items()]
            held.clear()
            return pd.concat(frames)

        for batch in batches:
            for key, part in batch.groupby(list(keys), sort=False):
                got = products(*(_stack(part[c]) if isinstance(part[c].iloc[0], (list, np.ndarray)) else part[c].to_numpy(float) for c in inputs))
                held[key] = held[key] + got if key in held else got
            if sum(m.size for m in held.values()) > HELD:
                yield out()
        if held:
            yield out()

    partial = rows.select(*keys, *inputs).mapInPandas(run, f"{kinds}, s int, row array<double>")
    lists = F.collect_list("row")
    total = F.aggregate(lists, F.transform(F.get(lists, F.lit(0)), lambda _: F.lit(0.0)), lambda a, r: F.zip_with(a, r, lambda u, v: u + v))
    return partial.groupBy(*keys, "s").agg(total.alias("row"))


def grams(rows: DataFrame, keys: tuple[str, ...] = ("origin",)) -> DataFrame:
    """series rows -> (*keys, s, g, plain, square, fourth, varying, m), a row for each instant s, all summed over the series.

    g: row s of the T x T matrix of products of the residuals over their root mean square; plain: the same of the residuals themselves; square,
    fourth: sums at s of the second and fourth powers of the former; varying: series that aren't 0 throughout; m: series.
    """

    def products(x: np.ndarray) -> np.ndarray:
        scale = np.sqrt((x * x).mean(axis=1))
        varying = scale > 0
        z = x[varying] / scale[varying, None]
        t = x.shape[1]
        more = np.column_stack(((z**2).sum(axis=0), (z**4).sum(axis=0), np.full(t, varying.sum()), np.full(t, len(x))))
        return np.hstack((z.T @ z, x.T @ x, more))

    got = _summed(rows, keys, ["x"], products, 2)
    t = F.size("row") / 2 - 2
    at = lambda k: F.element_at("row", F.lit(-k))
    return got.select(*keys, "s", F.slice("row", F.lit(1), t.cast("int")).alias("g"), F.slice("row", (t + 1).cast("int"), t.cast("int")).alias("plain"), at(4).alias("square"), at(3).alias("fourth"), at(2).cast("long").alias("varying"), at(1).cast("long").alias("m"))


def intensities(gram: DataFrame, keys: tuple[str, ...] = ("origin",)) -> DataFrame:
    """grams -> (*keys, intensity, n): the Schaefer-Strimmer intensity and the number of instants, without any pair of series.

    Over all pairs, the squared correlations add up to |G|^2 / T^2 and the mean squared products to the mean of the squared sums of squares; each series' pair with
    itself is taken off. Clipped to [0, 1]; 1 without correlations or with a single instant.
    """
    norm = F.aggregate("g", F.lit(0.0), lambda a, v: a + v * v)
    per = gram.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(norm).alias("norm"), F.sum(F.col("square") ** 2).alias("square"), F.sum("fourth").alias("fourth"), F.max("varying").alias("varying"))
    n = F.col("n")
    r2 = F.col("norm") / (n * n) - F.col("varying")
    q = (F.col("square") - F.col("fourth")) / n
    raw = F.when(r2 > 1e-12 * F.col("varying"), F.try_divide(n * n * (q - r2), F.pow(n - 1, F.lit(3)) * r2))
    return per.select(*keys, F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(1.0)).alias("intensity"), F.col("n").alias("n"))


def shrinkage(residuals: DataFrame) -> DataFrame:
    """residuals(origin, unique_id, ds, e), complete -> (origin, intensity, t)."""
    return intensities(grams(series_rows(residuals))).withColumnRenamed("n", "t")


def expanding_shrinkage(residuals: DataFrame, least: int = 2, every: int = 1) -> DataFrame:
    """(origin, t, intensity): from the first t instants, for every t from `least` on."""
    keys = ("origin", "t")
    return intensities(grams(expanded(series_rows(residuals), least, every), keys), keys).select("origin", "t", "intensity")


def weighted(rows: DataFrame, intensity: DataFrame, keys: tuple[str, ...] = ("origin",), base: str = "plan") -> DataFrame:
    """series rows, intensity(*keys, intensity) -> (*keys, unique_id, v, f): W = diag(v) + F F', f being the series' line of F.

    base 'plan': from the mean of products; 'library': from the sample covariance. A series without variance gets 0, a key without intensity has 1.
    """
    if base not in ("plan", "library"):
        raise ValueError(f"unknown base {base!r}")
    lam = F.greatest(F.coalesce("intensity", F.lit(1.0)), F.lit(LEAST_INTENSITY))
    both = rows.join(intensity.select(*keys, "intensity"), list(keys), "left")
    n, sum_of = F.size("x"), lambda f: F.aggregate("x", F.lit(0.0), lambda a, e: a + f(e))
    if base == "library":
        both = both.filter(n > 1).withColumn("mean", sum_of(lambda e: e) / n)
        both, n = both.withColumn("x", F.transform("x", lambda e: e - F.col("mean"))), n - 1
    square = sum_of(lambda e: e * e) / n
    scale = F.sqrt((1 - lam) / n)
    return both.select(*keys, "unique_id", (lam * square).alias("v"), scale.alias("c"), "x").select(*keys, "unique_id", "v", F.transform("x", lambda e: F.col("c") * e).alias("f"))


def minimum_trace(forecasts: DataFrame, nodes: DataFrame, residuals: DataFrame, intensity: DataFrame, depth: int, keys=("ds", "horizon"), base: str = "plan") -> DataFrame:
    """Reconciliation with the shrunk covariance of residuals(origin, unique_id, ds, e) on a tree -> (origin, *keys, unique_id, y_hat).

    W = diag(v) + F F'. With R the projection of least squares with weights v, two passes of the tree, the result is R y - R F a, where
    (I + F' V^-1 (F - R F)) a = F' V^-1 (y - R y) is a T x T system for each origin. Series without variance get a tiny one. Every series needs the same steps.
    """
    keys, tiny = list(keys), 1e-12
    weights = materialize(weighted(series_rows(residuals), intensity, base=base), "factors")
    mean = weights.groupBy("origin").agg(F.avg("v").alias("mean"))
    floor = F.when(F.col("mean") > 0, tiny * F.col("mean")).otherwise(1.0)
    variance = weights.select("origin", "unique_id", "v").join(mean, "origin").select("origin", "unique_id", F.greatest("v", floor).alias("v"))
    long = weights.select("origin", "unique_id", F.posexplode("f").alias("s", "y_hat"))
    passed = tree_least_squares(long, nodes, variance, depth, ("origin", "s")).withColumnRenamed("y_hat", "r")
    lines = passed.groupBy("origin", "unique_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "r"))), lambda p: p["r"]).alias("rf"))
    own = forecasts.select("origin", *keys, "unique_id", "y_hat")
    plain = tree_least_squares(own, nodes, variance, depth, ("origin", *keys)).withColumnRenamed("y_hat", "r")
    steps = own.join(plain, ["origin", *keys, "unique_id"]).groupBy("origin", "unique_id").agg(F.array_sort(F.collect_list(F.struct(*keys, "y_hat", "r"))).alias("steps"))
    rows = materialize(steps.join(lines, ["origin", "unique_id"]).join(weights.select("origin", "unique_id", "f"), ["origin", "unique_id"]).join(variance, ["origin", "unique_id"]), "factors")
    gaps = F.concat(F.zip_with("f", "rf", lambda a, b: a - b), F.transform("steps", lambda p: p["y_hat"] - p["r"]))
    sides = rows.select("origin", "f", F.transform(gaps, lambda g: g / F.col("v")).alias("gap"))
    system = _summed(sides, ("origin",), ["f", "gap"], lambda f, g: f.T @ g, 1)

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(group.sort_values("s")["row"].to_numpy())
        t = len(m)
        a = np.linalg.solve(np.eye(t) + m[:, :t], m[:, t:])
        return pd.DataFrame({"origin": [group["origin"].iloc[0]], "a": [a.T.tolist()]})

    kind = own.schema["origin"].dataType.simpleString()
    moves = system.groupBy("origin").applyInPandas(solve, f"origin {kind}, a array<array<double>>")
    # by parts of an origin's series, so that one origin isn't one task; Spark broadcasts the moves where they are small
    parts = F.broadcast(rows.agg(F.ceil(F.count("*") / 100_000).cast("int").alias("parts")))
    spread = moves.join(parts).select("origin", "a", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts") - 1, F.lit(0)))).alias("part"))
    dealt = rows.join(parts).withColumn("part", F.pmod(F.xxhash64("unique_id"), F.greatest("parts", F.lit(1))).cast("int"))
    change = lambda k: F.aggregate(F.zip_with("rf", F.get("a", k), lambda u, v: u * v), F.lit(0.0), lambda x, y: x + y)
    done = dealt.join(spread, ["origin", "part"]).select("origin", "unique_id", F.explode(F.transform("steps", lambda p, k: F.struct(*(p[c].alias(c) for c in keys), (p["r"] - change(k)).alias("y_hat")))).alias("p"))
    return done.select("origin", *(F.col(f"p.{c}").alias(c) for c in keys), "unique_id", F.col("p.y_hat").alias("y_hat"))


#: Up to so many series a covariance is one task's matrix, which has fewer rows than the factors if there are many instants.
DENSE_SERIES = 256


def minimum_trace_of(forecasts: DataFrame, nodes: DataFrame, edges: DataFrame, residuals: DataFrame, depth: int, keys=("ds", "horizon"), base: str = "plan") -> DataFrame:
    """Reconciliation with the shrunk covariance of residuals(origin, unique_id, ds, e), for the origins that have residuals: as a matrix for few series, else in factor form."""
    residuals = materialize(residuals, "residuals")
    own = forecasts.join(residuals.select("origin").distinct(), "origin", "left_semi")
    intensity = materialize(shrinkage(residuals), "intensity")
    if nodes.count() > DENSE_SERIES:
        return minimum_trace(own, nodes, residuals, intensity, depth, keys, base)
    return dense_minimum_trace(own, edges, shrunk(covariance(residuals, base), intensity), keys)


#: Shifts tried at each end of the spectrum in a pass, and passes: 17^6 parts of the first bracket.
SHIFTS, PASSES = 16, 6


def _shifts(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    share = np.arange(1, SHIFTS + 1) / (SHIFTS + 1)
    return low * (high / low) ** share


def spectrum(weights: DataFrame, gram: DataFrame, intensity: DataFrame, keys: tuple[str, ...] = ("origin",)) -> DataFrame:
    """weighted, grams, intensities -> (*keys, t, m, intensity, rank_w1, cond_w1, smallest, largest, cond_w), of W and of W1 = E'E / T.

    Rank and condition of W1 come from the eigenvalues of the T x T matrix E E' / T, the condition being infinite below full rank. The ends of W's spectrum are
    narrowed down by counts: W - mu I has as many negative eigenvalues as diag(v) - mu I has, plus those of -I - F'(diag(v) - mu I)^-1 F, less T; each pass tries
    32 values of mu for every key at once, in sums over the series.
    """
    on, names = list(keys), [f"{k} {weights.schema[k].dataType.simpleString()}" for k in keys]

    def first(group: pd.DataFrame, lam: pd.DataFrame) -> pd.DataFrame:
        columns = [*on, "n", "m", "intensity", "rank_w1", "cond_w1", "lo_max", "hi_max", "lo_min", "hi_min"]
        if not len(group) or not len(lam):
            return pd.DataFrame(columns=columns)
        plain = np.stack(group.sort_values("s")["plain"].to_numpy())
        t, m, share = len(plain), int(group["m"].iloc[0]), float(lam["intensity"].iloc[0])
        told, share = share, max(share, LEAST_INTENSITY)
        values = np.sort(np.linalg.eigvalsh(plain / t))[::-1][: min(m, t)]
        top = max(float(values[0]), 0.0)
        rank = int((values > top * m * np.finfo(float).eps).sum())
        least, most = float(lam["least"].iloc[0]) / share, float(lam["most"].iloc[0]) / share  # of D
        cond = float(values[m - 1] and top / values[m - 1]) if rank == m else np.inf
        low, high = max(share * most, (1 - share) * top, most), share * most + (1 - share) * top
        return pd.DataFrame([[*group[on].iloc[0], t, m, told, rank, cond, low * (1 - 1e-9), high * (1 + 1e-9), share * least * (1 - 1e-9), least * (1 + 1e-9)]], columns=columns)

    ends = weights.groupBy(*on).agg(F.min("v").alias("least"), F.max("v").alias("most"))
    schema = ", ".join([*names, "n long, m long, intensity double, rank_w1 long, cond_w1 double, lo_max double, hi_max double, lo_min double, hi_min double"])
    state = materialize(gram.groupBy(*on).cogroup(intensity.join(ends, on).groupBy(*on)).applyInPandas(first, schema), "spectrum")

    def products(f: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        mus = np.concatenate((_shifts(a[0], b[0]), _shifts(c[0], d[0])))
        blocks, below = [], []
        for mu in mus:
            gap = v - mu
            gap = np.where(gap == 0, np.finfo(float).tiny, gap)
            blocks.append(f.T @ (f / gap[:, None]))
            below.append(np.full(f.shape[1], (gap < 0).sum()))
        return np.hstack((*blocks, np.column_stack(below)))

    def narrow(group: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        if not len(group) or not len(old):
            return old
        rows, t = np.stack(group.sort_values("s")["row"].to_numpy()), len(group)
        out = old.iloc[0].copy()
        mus = [_shifts(out["lo_max"], out["hi_max"]), _shifts(out["lo_min"], out["hi_min"])]
        counts = []
        for k in range(2 * SHIFTS):
            block = rows[:, k * t : (k + 1) * t]
            inner = np.linalg.eigvalsh(-np.eye(t) - (block + block.T) / 2)
            counts.append(int(rows[0, 2 * SHIFTS * t + k]) + int((inner < 0).sum()) - t)
        all_below, some_below = [c >= out["m"] for c in counts[:SHIFTS]], [c > 0 for c in counts[SHIFTS:]]
        k = all_below.index(True) if True in all_below else SHIFTS
        edges = np.concatenate(([out["lo_max"]], mus[0], [out["hi_max"]]))
        out["lo_max"], out["hi_max"] = edges[k], edges[k + 1]
        k = some_below.index(True) if True in some_below else SHIFTS
        edges = np.concatenate(([out["lo_min"]], mus[1], [out["hi_min"]]))
        out["lo_min"], out["hi_min"] = edges[k], edges[k + 1]
        return pd.DataFrame([out])[old.columns.tolist()]

    bounds = ["lo_max", "hi_max", "lo_min", "hi_min"]
    for _ in range(PASSES):
        tried = weights.join(state.select(*on, *bounds).filter("lo_min > 0"), on)
        sums = _summed(tried, keys, ["f", "v", *bounds], products, 2 * SHIFTS)
        state = materialize(sums.groupBy(*on).cogroup(state.groupBy(*on)).applyInPandas(narrow, schema), "spectrum")
    low, high = F.sqrt(F.col("lo_min") * F.col("hi_min")), F.sqrt(F.col("lo_max") * F.col("hi_max"))
    cond = F.when(F.col("lo_min") > 0, high / low).otherwise(F.lit(float("inf")))
    return state.select(*on, *([] if "t" in on else [F.col("n").alias("t")]), "m", "intensity", "rank_w1", "cond_w1", low.alias("smallest"), high.alias("largest"), cond.alias("cond_w"))


def weight_diagnostics(residuals: DataFrame, least: int | None = None, every: int = 1) -> DataFrame:
    """residuals(origin, unique_id, ds, e), complete -> `spectrum` by origin; with `least`, by origin and each number t of first instants from there on."""
    rows, keys = series_rows(residuals), ("origin",)
    if least is not None:
        rows, keys = expanded(rows, least, every), ("origin", "t")
    rows = materialize(rows, "rows")
    gram = materialize(grams(rows, keys), "gram")
    intensity = materialize(intensities(gram, keys), "intensity")
    return spectrum(materialize(weighted(rows, intensity, keys), "weights"), gram, intensity, keys)
