"""Residual covariances and reconciliation of base forecasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bottom_up(forecasts: DataFrame, edges: DataFrame, keys=("origin", "ds", "horizon")) -> DataFrame:
    """forecasts(*keys, unique_id, y_hat) -> the same columns, every node being the sum of its leaves' forecasts."""
    leaf = forecasts.select(*keys, F.col("unique_id").alias("leaf_id"), "y_hat")
    return leaf.join(edges.select("unique_id", "leaf_id"), "leaf_id").groupBy(*keys, "unique_id").agg(F.sum("y_hat").alias("y_hat"))


def tree_least_squares(forecasts: DataFrame, nodes: DataFrame, variance: DataFrame | None, depth: int, keys=("origin", "ds", "horizon")) -> DataFrame:
    """Least squares with a diagonal weight matrix on a tree, exactly, in one pass up and one down.

    nodes(level, unique_id, parent), leaves at level `depth`; variance([origin,] unique_id, v), or None for equal ones (OLS).
    Upwards, a node combines its own forecast with the sum of its children by precision; downwards, the gap between a
    node and the sum of its children is shared in proportion to their variances. One aggregation and two joins a level, no matrix.
    """
    keys = list(keys)
    base = forecasts.select(*keys, "unique_id", "y_hat").join(nodes.select("level", "unique_id", "parent"), "unique_id")
    if variance is None:
        base = base.withColumn("v", F.lit(1.0))
    else:
        base = base.join(variance, [c for c in ("origin", "unique_id") if c in variance.columns])
    up = {depth: base.filter(F.col("level") == depth).select(*keys, "unique_id", "parent", F.col("y_hat").alias("mu"), F.col("v").alias("var"))}
    sums = {}
    for level in range(depth - 1, -1, -1):
        sums[level] = up[level + 1].groupBy(*keys, F.col("parent").alias("unique_id")).agg(F.sum("mu").alias("c_mu"), F.sum("var").alias("c_var"))
        joined = base.filter(F.col("level") == level).join(sums[level], [*keys, "unique_id"])
        var = 1 / (1 / F.col("v") + 1 / F.col("c_var"))
        up[level] = joined.select(*keys, "unique_id", "parent", (var * (F.col("y_hat") / F.col("v") + F.col("c_mu") / F.col("c_var"))).alias("mu"), var.alias("var"))
    down = up[0].select(*keys, "unique_id", F.col("mu").alias("y_hat"))
    out = down
    for level in range(depth):
        gap = down.join(sums[level], [*keys, "unique_id"]).select(*keys, F.col("unique_id").alias("parent"), (F.col("y_hat") - F.col("c_mu")).alias("gap"), "c_var")
        down = up[level + 1].join(gap, [*keys, "parent"]).select(*keys, "unique_id", (F.col("mu") + F.col("var") / F.col("c_var") * F.col("gap")).alias("y_hat"))
        out = out.union(down)
    return out


#: Series of a block in products of residuals.
BLOCK = 256


def _block_pairs(residuals: DataFrame) -> DataFrame:
    """residuals(origin, unique_id, ds, e) -> (origin, lo, hi, block, unique_id, x): each series' residuals in order of time, for each pair of its block with another.

    One row a series and block: nothing grows with the square of the number of series.
    """
    x = F.transform(F.array_sort(F.collect_list(F.struct("ds", "e"))), lambda s: s["e"])
    series = residuals.groupBy("origin", "unique_id").agg(x.alias("x"))
    blocks = F.lit(max(1, -(-residuals.agg(F.count_distinct("unique_id")).first()[0] // BLOCK)))
    dealt = series.withColumn("block", F.pmod(F.xxhash64("unique_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.select("origin", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "unique_id", "x")


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(ids, matrix) of both sides of a block pair, instants in rows, and whether they are one."""
    group = group.sort_values("unique_id")
    same = group["lo"].iloc[0] == group["hi"].iloc[0]
    parts = []
    for name in ("lo", "hi"):
        own = group[group["block"] == group[name].iloc[0]]
        if not len(own):
            return None
        if len({len(x) for x in own["x"]}) > 1:
            raise ValueError("residuals of unequal length: keep complete instants only")
        parts += [own["unique_id"].to_numpy(), np.stack(own["x"].to_numpy()).T.astype(float)]
    return (*parts, same)


def pair_moments(residuals: DataFrame) -> DataFrame:
    """residuals(origin, unique_id, ds, e), complete -> (origin, i, j, t, plan, sample, r, q) for i <= j, one pass for all of them.

    plan: mean of products; sample: sample covariance; r: uncentred correlation; q: mean of squared products of residuals over
    their root mean square, null where one is 0. Products of blocks of series are taken by tasks of their own.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sides = _sides(group)
        if sides is None:
            return pd.DataFrame(columns=names)
        a, x, b, y, same = sides
        t = len(x)
        plan, sample = x.T @ y / t, (x - x.mean(axis=0)).T @ (y - y.mean(axis=0)) / (t - 1) if t > 1 else np.full((len(a), len(b)), np.nan)
        with np.errstate(invalid="ignore", divide="ignore"):
            xs, ys = (v / np.sqrt((v * v).mean(axis=0)) for v in (x, y))
            r, q = xs.T @ ys / t, (xs * xs).T @ (ys * ys) / t
        at, to = np.triu_indices(len(a)) if same else (k.ravel() for k in np.indices(plan.shape))
        swap = a[at] > b[to]
        out = pd.DataFrame({"origin": group["origin"].iloc[0], "i": np.where(swap, b[to], a[at]), "j": np.where(swap, a[at], b[to]), "t": t})
        for name, v in (("plan", plan), ("sample", sample), ("r", r), ("q", q)):
            out[name] = np.where(np.isfinite(v[at, to]), v[at, to], None)
        return out[names]

    names = ["origin", "i", "j", "t", "plan", "sample", "r", "q"]
    kind = residuals.schema["origin"].dataType.simpleString()
    return _block_pairs(residuals).groupBy("origin", "lo", "hi").applyInPandas(run, f"origin {kind}, i string, j string, t long, plan double, sample double, r double, q double")


def covariance(residuals: DataFrame, base: str = "plan") -> DataFrame:
    """residuals(origin, unique_id, ds, e), complete -> (origin, i, j, w, t) for i <= j.

    base 'plan' is the uncentred mean of products, 'library' the sample covariance.
    """
    if base not in ("plan", "library"):
        raise ValueError(f"unknown base {base!r}")
    return pair_moments(residuals).select("origin", "i", "j", F.col("plan" if base == "plan" else "sample").alias("w"), "t")


def pair_table(moments: DataFrame) -> DataFrame:
    """pair_moments -> (origin, i, j, r, r2, q, var_r, t) for i < j, series without variance left out.

    r2: squared uncentred correlation; var_r: its sampling variance, t^2 / (t - 1)^3 (q - r2).
    """
    t = F.col("t")
    rows = moments.filter("i < j and r is not null and q is not null").withColumn("r2", F.col("r") * F.col("r"))
    return rows.select("origin", "i", "j", "r", "r2", "q", F.try_divide(t * t * (F.col("q") - F.col("r2")), F.pow(t - 1, F.lit(3))).alias("var_r"), "t")


def intensity_of(moments: DataFrame) -> DataFrame:
    """pair_moments -> (origin, intensity, t): the Schaefer-Strimmer intensity, sum of Var(r_ij) / sum of r_ij^2 over i <> j, clipped to
    [0, 1]; 1 without correlations or with a single instant."""
    return pair_table(moments).groupBy("origin").agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.sum("var_r"), F.sum("r2")))), F.lit(1.0)).alias("intensity"), F.max("t").alias("t"))


def shrunk(cov: DataFrame, intensity: DataFrame) -> DataFrame:
    """(origin, i, j, w): variances kept, covariances times 1 - intensity; an origin without one has 1."""
    joined = cov.join(intensity.select("origin", "intensity"), "origin", "left")
    return joined.select("origin", "i", "j", F.when(F.col("i") == F.col("j"), F.col("w")).otherwise((1 - F.coalesce("intensity", F.lit(1.0))) * F.col("w")).alias("w"))


#: Series of a covariance held as a matrix at most; `factors` has no such bound.
MAX_SERIES = 4_000


def structure(edges: DataFrame) -> tuple[list[str], np.ndarray]:
    """(ids, aggregates first; constraint matrix C = [I, -A]) of a hierarchy small enough for a full covariance; raises for larger ones."""
    most = MAX_SERIES * 64
    rows = [tuple(r) for r in edges.select("unique_id", "leaf_id").limit(most + 1).collect()]
    leaves = sorted({b for _, b in rows})
    tops = sorted({a for a, _ in rows} - set(leaves))
    if len(rows) > most or len(tops) + len(leaves) > MAX_SERIES:
        raise ValueError(f"more than {MAX_SERIES} series: use the factor form, which needs no matrix")
    at = {u: k for k, u in enumerate(tops + leaves)}
    c = np.hstack((np.eye(len(tops)), np.zeros((len(tops), len(leaves)))))
    for a, b in rows:
        if at[a] < len(tops):
            c[at[a], at[b]] = -1
    return tops + leaves, c


def _dense(group: pd.DataFrame, order: list[str]) -> np.ndarray:
    at = {u: k for k, u in enumerate(order)}
    w = np.zeros((len(order), len(order)))
    i, j = group["i"].map(at).to_numpy(), group["j"].map(at).to_numpy()
    w[i, j] = w[j, i] = group["w"]
    return w


def _gain(w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """W C' (C W C')^-1: what a unit of incoherence adds to each series."""
    inner = c @ w @ c.T
    try:
        return np.linalg.solve(inner, c @ w).T
    except np.linalg.LinAlgError:  # singular: coherent residuals
        return w @ c.T @ np.linalg.pinv(inner)


def minimum_trace(forecasts: DataFrame, edges: DataFrame, weights: DataFrame, keys=("ds", "horizon")) -> DataFrame:
    """Reconciliation with a full covariance: weights(origin, i, j, w), i <= j -> (origin, *keys, unique_id, y_hat).

    In constraint form: a forecast changes by W C' (C W C')^-1 times the incoherences of its step. Each origin's solve is one task,
    which gets the incoherences, one row a step and aggregate, and returns a row a step and series.
    """
    keys = list(keys)
    order, c = structure(edges)
    tops = order[: len(c)]
    own = forecasts.select("origin", *keys, "unique_id", "y_hat")
    above = edges.filter("unique_id <> leaf_id").select("unique_id", "leaf_id")
    sums = own.withColumnRenamed("unique_id", "leaf_id").join(above, "leaf_id").groupBy("origin", *keys, "unique_id").agg(F.sum("y_hat").alias("s"))
    gaps = own.join(sums, ["origin", *keys, "unique_id"]).select("origin", *keys, "unique_id", (F.col("y_hat") - F.col("s")).alias("gap"))

    def solve(weight: pd.DataFrame, gap: pd.DataFrame) -> pd.DataFrame:
        if not len(weight) or not len(gap):
            return pd.DataFrame(columns=["origin", *keys, "unique_id", "change"])
        wide = gap.pivot_table(index=keys, columns="unique_id", values="gap")[tops]
        change = wide.to_numpy() @ _gain(_dense(weight, order), c).T
        steps = wide.index.to_frame(index=False)
        out = steps.loc[np.repeat(np.arange(len(steps)), len(order))].reset_index(drop=True)
        out["origin"], out["unique_id"], out["change"] = weight["origin"].iloc[0], np.tile(order, len(steps)), change.ravel()
        return out[["origin", *keys, "unique_id", "change"]]

    kinds = ", ".join(f"{k} {own.schema[k].dataType.simpleString()}" for k in ("origin", *keys))
    changes = weights.groupBy("origin").cogroup(gaps.groupBy("origin")).applyInPandas(solve, f"{kinds}, unique_id string, change double")
    return own.join(changes, ["origin", *keys, "unique_id"]).select("origin", *keys, "unique_id", (F.col("y_hat") - F.col("change")).alias("y_hat"))


def choose_method(residuals: DataFrame, min_rows: int, more_series: bool = False, condition: DataFrame | None = None, max_condition: float = 1e8) -> DataFrame:
    """(origin, method, reason): shrunk covariance, or structural weights with the first reason that applies.

    more_series: refuse more series than residuals; condition(origin, cond_w): refuse one above max_condition, or none at all.
    """
    per = residuals.groupBy("origin", "unique_id").agg(F.count("e").alias("t"), F.stddev_pop("e").alias("sd"))
    got = per.groupBy("origin").agg(F.min("t").alias("t"), F.min("sd").alias("sd"), F.count("*").alias("m"))
    reason = F.when(F.col("t") < min_rows, "few residuals")
    if more_series:
        reason = reason.when(F.col("m") > F.col("t"), "more series than residuals")
    reason = reason.when(F.col("sd") <= 0, "a series without variance")
    if condition is not None:
        got = got.join(condition.select("origin", "cond_w"), "origin", "left")
        reason = reason.when(~F.coalesce(F.col("cond_w") <= max_condition, F.lit(False)), "ill-conditioned")
    reason = reason.otherwise("ok")
    return got.select("origin", F.when(reason == "ok", "mint_shrink").otherwise("wls_struct").alias("method"), reason.alias("reason"))


def allocate_bias(bias: DataFrame, nodes: DataFrame, variance: DataFrame | None, depth: int) -> DataFrame:
    """bias(case, unique_id, bias), all nodes -> (case, unique_id, bias): where the biases of base forecasts go by reconciliation with diagonal weights.

    The projection is linear, so that biases pass through the tree like forecasts; a bias of 1 in one series gives that column of P.
    """
    return tree_least_squares(bias.withColumnRenamed("bias", "y_hat"), nodes, variance, depth, ("case",)).withColumnRenamed("y_hat", "bias")


def projection(nodes: DataFrame, variance: DataFrame | None, depth: int) -> DataFrame:
    """(in_id, out_id, p): the coordinates of P for diagonal weights, of a hierarchy small enough to look at (checked): m^2 rows."""
    if nodes.count() > MAX_SERIES:
        raise ValueError(f"more than {MAX_SERIES} series: P has a row for each two of them")
    unit = nodes.select("unique_id").crossJoin(nodes.select(F.col("unique_id").alias("case"))).select("case", "unique_id", (F.col("case") == F.col("unique_id")).cast("double").alias("bias"))
    return allocate_bias(unit, nodes, variance, depth).select(F.col("case").alias("in_id"), F.col("unique_id").alias("out_id"), F.col("bias").alias("p"))


def projection_errors(p: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, error): the largest |P S - S|, |P P - P| and |G S - I|, of which G is P's rows of leaves."""
    p = p.select("in_id", "out_id", "p")
    s = edges.select(F.col("unique_id").alias("in_id"), "leaf_id")
    ps = p.join(s, "in_id").groupBy("out_id", "leaf_id").agg(F.sum("p").alias("v"))
    one = edges.select(F.col("unique_id").alias("out_id"), "leaf_id", F.lit(1.0).alias("s"))
    left = ps.join(one, ["out_id", "leaf_id"], "left").select("out_id", "leaf_id", F.abs(F.col("v") - F.coalesce("s", F.lit(0.0))).alias("gap"))
    again = p.toDF("in_id", "mid", "p1").join(p.toDF("mid", "out_id", "p2"), "mid").groupBy("in_id", "out_id").agg(F.sum(F.col("p1") * F.col("p2")).alias("pp"))
    square = again.join(p, ["in_id", "out_id"]).agg(F.max(F.abs(F.col("pp") - F.col("p"))).alias("error"))
    leaf = edges.select(F.col("leaf_id").alias("out_id")).distinct()
    named = [("unbiased", left.agg(F.max("gap").alias("error"))), ("idempotent", square), ("left_inverse", left.join(leaf, "out_id", "left_semi").agg(F.max("gap").alias("error")))]
    out = None
    for name, part in named:
        part = part.select(F.lit(name).alias("check"), "error")
        out = part if out is None else out.union(part)
    return out


def reconciled_variance(nodes: DataFrame, variance: DataFrame, depth: int) -> DataFrame:
    """(unique_id, v_base, v): variance of each reconciled series, the diagonal of P W P', for the diagonal weights W = variance(unique_id, v).

    By the two passes of the tree: a node's variance given all below it, then given everything.
    """
    base = nodes.select("level", "unique_id", "parent").join(variance.select("unique_id", "v"), "unique_id")
    up = {depth: base.filter(F.col("level") == depth).select("unique_id", "parent", "v", F.col("v").alias("var"))}
    sums = {}
    for level in range(depth - 1, -1, -1):
        sums[level] = up[level + 1].groupBy(F.col("parent").alias("unique_id")).agg(F.sum("var").alias("c_var"))
        up[level] = base.filter(F.col("level") == level).join(sums[level], "unique_id").select("unique_id", "parent", "v", (F.col("v") * F.col("c_var") / (F.col("v") + F.col("c_var"))).alias("var"))
    down = up[0].select("unique_id", F.col("v").alias("v_base"), F.col("var").alias("v"))
    out = down
    for level in range(depth):
        above = down.join(sums[level], "unique_id").select(F.col("unique_id").alias("parent"), F.col("v").alias("p_v"), "c_var")
        share = F.col("var") / F.col("c_var")
        down = up[level + 1].join(above, "parent").select("unique_id", F.col("v").alias("v_base"), (F.col("var") - F.col("var") * share + share * share * F.col("p_v")).alias("v"))
        out = out.union(down)
    return out


#: (values, season, h) -> (h forecasts, fitted values one step ahead).
Fitter = Callable[[np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]


def additive_smoother(y: np.ndarray, season: int, h: int, alpha: float = 0.3, gamma: float = 0.2) -> tuple[np.ndarray, np.ndarray]:
    """Exponential smoothing of a level and additive seasonal terms. The first season starts them and has no fitted values."""
    level, seasonal = y[:season].mean(), y[:season] - y[:season].mean()
    fitted = np.full(len(y), np.nan)
    for t, v in enumerate(y):
        k = t % season
        if t >= season:
            fitted[t] = level + seasonal[k]
        before, level = level, alpha * (v - seasonal[k]) + (1 - alpha) * level
        seasonal[k] = gamma * (v - before) + (1 - gamma) * seasonal[k]
    return np.array([level + seasonal[(len(y) + k) % season] for k in range(h)]), fitted


def fit_series(train: DataFrame, h: int, season: int, unit: str = "month", fitter: Fitter = additive_smoother) -> DataFrame:
    """train(origin, unique_id, ds, y) -> (origin, unique_id, ds, horizon, y_hat): one fit per origin and series.

    Forecasts have a horizon from 1 on; fitted values, for the instants of train, have none (null).
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ds")
        ahead, fitted = fitter(group["y"].to_numpy(float), season, h)
        known = np.isfinite(fitted)
        past = pd.DataFrame({"ds": group["ds"].to_numpy()[known], "horizon": None, "y_hat": fitted[known]})
        out = pd.concat([pd.DataFrame({"ds": pd.NaT, "horizon": np.arange(1, h + 1), "y_hat": ahead}), past.astype({"horizon": object})])
        out["origin"], out["unique_id"] = group["origin"].iloc[0], group["unique_id"].iloc[0]
        return out[["origin", "unique_id", "ds", "horizon", "y_hat"]]

    got = train.groupBy("origin", "unique_id").applyInPandas(fit, "origin timestamp, unique_id string, ds timestamp, horizon int, y_hat double")
    return got.withColumn("ds", F.coalesce("ds", F.expr(f"timestampadd({unit}, horizon - 1, origin)")))


def smooth_at_origins(series: DataFrame, origins: DataFrame, h: int, season: int, unit: str = "month", alpha: float = 0.3, gamma: float = 0.2) -> DataFrame:
    """series(unique_id, ds, y) -> (origin, unique_id, ds, horizon, y_hat): `additive_smoother` on everything before each origin, in one run over each series.

    The state is the same whatever the origin, so that a run passes all origins: it leaves the fitted values once (origin and horizon null, each one step ahead of
    its past) and at every origin with a season before it the forecasts of h steps. Series of the same instants run together, a vector a step. The origins, a few
    for each instant of a study, go to all tasks (refused above 100,000).
    """
    dates = [r["origin"] for r in origins.select("origin").distinct().orderBy("origin").limit(100_001).collect()]
    if len(dates) > 100_000:
        raise ValueError("more than 100000 origins")
    cuts = pd.to_datetime(pd.Series(dates, dtype="object")).to_numpy("datetime64[ns]")
    own = series.groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("ds", "y"))).alias("p"))
    arrays = own.select("unique_id", F.transform("p", lambda p: F.unix_micros(p["ds"])).alias("at"), F.transform("p", lambda p: p["y"].cast("double")).alias("y"))

    def frame(names, values, at=None, origin=None, horizon=None) -> pd.DataFrame:
        n = values.shape[1]
        ds = np.tile(at, len(names)) if at is not None else pd.NaT
        return pd.DataFrame({"origin": origin if origin is not None else pd.NaT, "unique_id": np.repeat(names, n), "ds": ds, "horizon": np.tile(horizon, len(names)) if horizon is not None else None, "y_hat": values.ravel()}).astype({"origin": "datetime64[ns]", "ds": "datetime64[ns]", "horizon": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(batch["at"].map(lambda a: np.asarray(a, np.int64).tobytes()), sort=False):
                at = np.frombuffer(key, np.int64).astype("datetime64[us]").astype("datetime64[ns]")
                y, names, t = np.stack(part["y"].to_numpy()).astype(float), part["unique_id"].to_numpy(), len(at)
                if t < season:
                    continue
                level = y[:, :season].mean(axis=1)
                seasonal, fitted = y[:, :season] - level[:, None], np.empty((len(y), t - season))
                stops = np.searchsorted(at, cuts, "left")  # values before each origin
                for k in range(t + 1):
                    if k >= season:
                        for o in np.flatnonzero(stops == k):
                            ahead = level[:, None] + seasonal[:, (k + np.arange(h)) % season]
                            yield frame(names, ahead, origin=cuts[o], horizon=np.arange(1, h + 1))
                    if k == t:
                        break
                    j = k % season
                    if k >= season:
                        fitted[:, k - season] = level + seasonal[:, j]
                    before, level = level, alpha * (y[:, k] - seasonal[:, j]) + (1 - alpha) * level
                    seasonal[:, j] = gamma * (y[:, k] - before) + (1 - gamma) * seasonal[:, j]
                if t > season:
                    yield frame(names, fitted, at=at[season:])

    got = arrays.mapInPandas(run, "origin timestamp, unique_id string, ds timestamp, horizon int, y_hat double")
    return got.withColumn("ds", F.coalesce("ds", F.expr(f"timestampadd({unit}, horizon - 1, origin)")))


def fitted_values(fits: DataFrame, series: DataFrame) -> DataFrame:
    """fit_series -> residuals(origin, unique_id, ds, e) of the fitted values."""
    return fits.filter("horizon is null").join(series.select("unique_id", "ds", "y"), ["unique_id", "ds"]).select("origin", "unique_id", "ds", (F.col("y") - F.col("y_hat")).alias("e"))
