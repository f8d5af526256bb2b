"""The rolling study on monthly revenue: hierarchy, origins, base forecasts, reconciliations and scales."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersum.functions import files, scratch
from tiersum.functions.scratch import materialize
from tiersum.operators import backtest, factors, hierarchy, metrics, reconcile
from tiersum.sources import views

KEYS, SEASON, HORIZON = ["region", "nation"], 12, 6
FIRST_BACK, EVERY, ORIGINS = 29, 6, 5
#: Named studies of origins. All but the first grow with the table.
STUDIES = {"start": {"origins": ["1999-01-01", "2000-01-01"]}, "robustness": {"every": 1, "history": 36, "ahead": HORIZON - 1}, "seasonal": {"every": 3, "history": 36, "ahead": HORIZON - 1}}


@dataclass
class Study:
    leaves: DataFrame
    series: DataFrame
    nodes: DataFrame
    edges: DataFrame
    origins: DataFrame
    base: DataFrame
    made: DataFrame | None = None
    state: tuple = ()

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str, name: str | None = None) -> Study:
        """The study of five half-yearly origins, or a named one.

        Its tables are made once for each folder in an application, and again when the scratch folder was cleared or a file of the folder's tables has changed.
        """
        key = (spark.sparkContext.applicationId, sf_dir, name)
        state = (scratch.era(), files.signature(spark, [f"{sf_dir}/{t}.parquet" for t in views.REVENUE_TABLES]))
        if key not in _STUDIES or _STUDIES[key].state != state:
            if name is None:
                leaves = materialize(views.monthly_revenue(spark, sf_dir), "leaves")  # every later step reads the aggregated leaves, not the orders
                series = materialize(hierarchy.build_hierarchy(leaves, KEYS), "series")
                origins = backtest.origins_between(leaves, FIRST_BACK, EVERY, ORIGINS)
                nodes, edges = hierarchy.nodes(leaves, KEYS), hierarchy.edges(leaves, KEYS)
            else:
                main = cls.of(spark, sf_dir)
                leaves, series, nodes, edges = main.leaves, main.series, main.nodes, main.edges
                origins = backtest.study_origins(series, STUDIES, name).select("origin")
            origins = materialize(origins, "origins")
            base = materialize(backtest.seasonal_forecasts(series, origins, HORIZON, SEASON), "base")
            _STUDIES[key] = cls(leaves, series, materialize(nodes, "nodes"), materialize(edges, "edges"), origins, base, state=state)
        return _STUDIES[key]

    def own(self) -> DataFrame:
        return self.base.filter("method = 'base'").drop("method")

    def reconciled(self) -> DataFrame:
        """(origin, unique_id, ds, horizon, method, y_hat, y) for base, naive, bottom-up, OLS and structural weights."""
        if self.made is not None:
            return self.made
        base = self.base
        own, weights = base.filter("method = 'base'").drop("method"), self.nodes.select("unique_id", F.col("n_leaves").cast("double").alias("v"))
        columns = ["origin", "unique_id", "ds", "horizon", "method", "y_hat"]
        parts = {"bu": reconcile.bottom_up(own, self.edges), "ols": reconcile.tree_least_squares(own, self.nodes, None, len(KEYS)), "wls_struct": reconcile.tree_least_squares(own, self.nodes, weights, len(KEYS))}
        out = base.select(columns)
        for name, part in parts.items():
            out = out.union(part.withColumn("method", F.lit(name)).select(columns))
        self.made = materialize(backtest.with_actuals(out, self.series), "reconciled")
        return self.made

    def scales(self) -> DataFrame:
        return metrics.mase_scale(self.series, self.origins, SEASON)

    def levels(self) -> DataFrame:
        return metrics.by_level(metrics.mase(self.reconciled(), self.scales(), self.nodes))

    def residuals(self) -> DataFrame:
        return backtest.fitted_residuals(self.series, self.origins, SEASON)

    def minimum_trace(self) -> DataFrame:
        return factors.minimum_trace_of(self.own(), self.nodes, self.edges, self.residuals(), len(KEYS))

    def past_errors(self, min_past: int, window: int | None = None) -> DataFrame:
        return backtest.past_errors(self.own_errors(), self.origins, HORIZON, min_past, window)

    def past_error_trace(self, min_past: int, window: int | None = None) -> DataFrame:
        """Reconciliation with the shrunk sample covariance of past out-of-sample errors."""
        return factors.minimum_trace_of(self.own(), self.nodes, self.edges, self.past_errors(min_past, window), len(KEYS), base="library")

    def own_errors(self) -> DataFrame:
        """(origin, unique_id, ds, e) of the base forecasts."""
        return backtest.with_actuals(self.own(), self.series).select("origin", "unique_id", "ds", (F.col("y") - F.col("y_hat")).alias("e"))

    def all_methods(self, min_past: int, window: int | None = None) -> DataFrame:
        """`reconciled` and three more methods: the shrunk covariance of fitted residuals, and past out-of-sample errors with a full and a diagonal one.

        Origins with fewer than min_past finished ones lack the last two.
        """
        variances = backtest.past_error_variances(self.own_errors(), self.origins, HORIZON, min_past, window)
        parts = {"mint_shrink": self.minimum_trace(), "mint_oos": self.past_error_trace(min_past, window), "wls_oos": reconcile.tree_least_squares(self.own(), self.nodes, variances, len(KEYS))}
        columns = ["origin", "unique_id", "ds", "horizon", "method", "y_hat"]
        out = self.reconciled().select(columns)
        for name, part in parts.items():
            out = out.union(part.withColumn("method", F.lit(name)).select(columns))
        return materialize(backtest.with_actuals(out, self.series), "methods")


_STUDIES: dict[tuple, Study] = {}
