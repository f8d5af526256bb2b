"""The gated job: check the hierarchy's fingerprint, forecast, choose a method, reconcile, gate, then publish or block."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyspark
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersum.functions import files
from tiersum.functions.scratch import materialize
from tiersum.operators import backtest, clean, factors, hierarchy, metrics, reconcile

REGISTRY = "source string, s_hash string"
#: What a run leaves. Below _attempts, which readers skip, until it is committed; then each below run_id=...
PARTS = ["forecast_reconciled", "gate_report", "lineage"]


@dataclass
class Contract:
    """keys: of the leaves, coarse to fine. h, season: steps of `unit`. window: residuals are of so many last dates."""

    keys: list[str]
    h: int
    season: int
    unit: str = "month"
    window: int = 60
    min_residuals: int = 24
    max_condition: float = 1e8
    abs_tol: float = 1e-6
    rel_tol: float = 1e-9
    negative_share: float = 0.0
    worse_by: float = 0.02
    weights: dict[int, float] | None = None


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(source, s_hash) of the known source versions, none where there is no registry yet."""
    try:
        return spark.read.schema(REGISTRY).json(path)
    except AnalysisException:
        return spark.createDataFrame([], REGISTRY)


def check_hash(spark: SparkSession, edges: DataFrame, source: str, path: str) -> str:
    """The hierarchy's fingerprint; a source version known with another one is refused, an unknown one is registered.

    A version's record is a file of its own that only one job can write; one that comes second is held against it.
    """
    own = hierarchy.fingerprint(edges).first()["s_hash"]
    record = f"{path}/{hashlib.sha256(source.encode()).hexdigest()[:32]}.json"
    files.put_once(spark, record, json.dumps({"source": source, "s_hash": own}) + "\n")
    known = json.loads(files.get(spark, record))["s_hash"]
    if known != own:
        raise ValueError(f"the hierarchy of {source} has changed: {known[:12]} is registered, this is {own[:12]}; a changed hierarchy needs a new version")
    return own


def _commit(path: str, run: str) -> str:
    return f"{path}/_commits/{quote(run, safe='')}.json"


def settle(spark: SparkSession, path: str) -> None:
    """Move the parts of committed runs to where readers look, after which their attempts are gone; uncommitted attempts stay unseen.

    Every job does so before and after its own commit, so that a run whose job died after its commit is finished by the next.
    """
    for attempt in files.names(spark, f"{path}/_attempts"):
        run = unquote(attempt.rsplit("@", 1)[0])
        record = files.get(spark, _commit(path, run))
        if record is None or json.loads(record)["attempt"] != attempt:
            continue
        for part in PARTS:
            source, target = f"{path}/_attempts/{attempt}/{part}", f"{path}/{part}/run_id={quote(run, safe='')}"
            if files.exists(spark, source) and not files.exists(spark, target):
                files.move(spark, source, target)
        files.delete(spark, f"{path}/_attempts/{attempt}")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, attempt, published) of the committed runs."""
    schema = "run_id string, attempt string, published boolean"
    return spark.read.schema(schema).json(f"{path}/_commits/*.json") if files.names(spark, f"{path}/_commits") else spark.createDataFrame([], schema)


def read_published(spark: SparkSession, path: str) -> DataFrame | None:
    """The forecasts of all committed and published runs, None before the first. Runs whose job died after its commit are finished first."""
    settle(spark, path)
    return spark.read.parquet(f"{path}/forecast_reconciled") if files.names(spark, f"{path}/forecast_reconciled") else None


def publish(forecasts: DataFrame, checks: DataFrame, lineage: dict, path: str) -> bool:
    """Writes lineage and gate report of a run, and its forecasts if all blocking checks passed. A run is committed once: one that is already is refused.

    forecasts(origin, unique_id, ds, y_hat) go to forecast_reconciled/run_id=.../forecast_date=.... All parts are written to an attempt's own folder; then one
    record, which only one attempt can write, tells which attempt is the run and whether it is published. A run that died before may be run again.
    Returns whether the forecasts were published.
    """
    spark, run = forecasts.sparkSession, lineage["run_id"]
    settle(spark, path)
    if files.exists(spark, _commit(path, run)):
        raise ValueError(f"run {run} exists already")
    attempt = f"{quote(run, safe='')}@{uuid.uuid4().hex}"
    stage = f"{path}/_attempts/{attempt}"
    report = checks.select("check", "value", "passed", "blocking")
    passed = not checks.isEmpty() and checks.filter("blocking and not passed").isEmpty()
    told = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in (lineage | {"published": passed, "spark": pyspark.__version__}).items()}
    if passed:
        out = forecasts.withColumn("forecast_date", F.date_format("origin", "yyyy-MM-dd"))
        out.write.partitionBy("forecast_date").parquet(f"{stage}/{PARTS[0]}")
    report.coalesce(1).write.json(f"{stage}/{PARTS[1]}")
    spark.createDataFrame([(told,)], "lineage map<string,string>").coalesce(1).write.json(f"{stage}/{PARTS[2]}")
    if not files.put_once(spark, _commit(path, run), json.dumps({"run_id": run, "attempt": attempt, "published": passed}) + "\n"):
        raise ValueError(f"run {run} exists already: another attempt was faster")
    settle(spark, path)
    return passed


def run_job(leaves: DataFrame, contract: Contract, path: str, source: str, run_id: str) -> DataFrame:
    """leaves(*keys, ds, y) -> one row: (run_id, method, reason, s_hash, checks, failures, published).

    The last h dates are held out for the gate. Results go below path, once for a run_id.
    """
    spark, keys, h = leaves.sparkSession, contract.keys, contract.h
    depth = len(keys)
    series = materialize(hierarchy.build_hierarchy(leaves, keys), "series")
    bad = clean.completeness(series).filter("violations > 0").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['violations']} violations of {bad[0]['check']} in the series")
    nodes, edges = (materialize(f(leaves, keys), "structure") for f in (hierarchy.nodes, hierarchy.edges))
    s_hash = check_hash(spark, edges, source, f"{path}/registry")
    split = backtest.last_dates_split(series, h)
    origins = materialize(split.filter("part = 'test'").agg(F.min("ds").alias("origin")), "origin")
    base = backtest.seasonal_forecasts(series, origins, h, contract.season, contract.unit).filter("method = 'base'").drop("method")
    base = materialize(base, "base")
    residuals = backtest.trailing_window(backtest.fitted_residuals(series, origins, contract.season), contract.window)
    residuals = materialize(residuals, "residuals")
    if not backtest.leakage(residuals).isEmpty():
        raise ValueError("residuals from the forecast's own time")
    condition = factors.weight_diagnostics(residuals)
    chosen = reconcile.choose_method(residuals, contract.min_residuals, condition=condition, max_condition=contract.max_condition).first()
    if chosen is not None and chosen["method"] == "mint_shrink":
        method, reason = "mint_shrink", chosen["reason"]
        own = factors.minimum_trace_of(base, nodes, edges, residuals, depth)
    else:
        method, reason = "wls_struct", chosen["reason"] if chosen is not None else "no residuals"
        own = reconcile.tree_least_squares(base, nodes, nodes.select("unique_id", F.col("n_leaves").cast("double").alias("v")), depth)
    columns = ["origin", "unique_id", "ds", "horizon", "method", "y_hat"]
    both = own.withColumn("method", F.lit(method)).select(columns).union(reconcile.bottom_up(base, edges).withColumn("method", F.lit("bottom_up")).select(columns))
    forecasts = materialize(backtest.with_actuals(both, series), "forecasts")
    scales = metrics.mase_scale(series, origins, contract.season)
    levels = metrics.by_level(metrics.mase(forecasts, scales, nodes))
    c = contract
    checks = metrics.gate(forecasts, edges, levels, "bottom_up", c.abs_tol, c.rel_tol, c.negative_share, c.worse_by, c.weights).filter(F.col("method") == method)
    if not metrics.missing_scales(forecasts, scales).isEmpty():  # no accuracy can be told for these series
        checks = checks.withColumn("passed", F.col("passed") & (F.col("check") != "accuracy"))
    checks = materialize(checks, "checks")
    lineage = {"run_id": run_id, "source": source, "s_hash": s_hash, "method_used": method, "method_reason": reason, "contract": vars(contract)}
    published = publish(forecasts.filter(F.col("method") == method).select("origin", "unique_id", "ds", "horizon", "y_hat"), checks, lineage, path)
    told = checks.filter("blocking").agg(F.count("*").alias("checks"), F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("check")))).alias("failures"))
    return told.select(F.lit(run_id).alias("run_id"), F.lit(method).alias("method"), F.lit(reason).alias("reason"), F.lit(s_hash).alias("s_hash"), "checks", F.concat_ws(",", "failures").alias("failures"), F.lit(published).alias("published"))
