"""Many origins at once: against a loop over the origins, and without joins that compare every row with every origin."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiersum.operators import backtest, metrics, reconcile

START = datetime(2020, 1, 1)


@pytest.fixture
def tables(spark):
    rng = np.random.default_rng(3)
    rows = [(u, START + timedelta(days=int(k)), float(rng.normal())) for u, first, last in (("a", 0, 90), ("b", 20, 60), ("c", 85, 90)) for k in range(first, last)]
    rows.append(("a", START + timedelta(days=95), None))
    origins = [START + timedelta(days=k, hours=h) for k, h in ((-5, 0), (0, 0), (7, 0), (8, 12), (40, 0), (41, 0), (88, 0), (200, 0))]
    return rows, origins, spark.createDataFrame(rows, "unique_id string, ds timestamp, y double").repartition(3), spark.createDataFrame([(o,) for o in origins], "origin timestamp")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_values_and_scales(spark, tables):
    rows, origins, series, table = tables
    last, scale = {}, {}
    for o in origins:
        for u in "abc":
            own = [(t, y) for v, t, y in rows if v == u and t < o]
            if own:
                last[o, u] = max(own)[1]
            d = [abs(b[1] - a[1]) for a, b in zip(sorted(own), sorted(own)[7:]) if b[1] is not None]
            if d:
                scale[o, u] = np.mean(d)
    assert {(r.origin, r.unique_id): r.y_hat for r in backtest.last_value(series, table).collect()} == last
    got = {(r.origin, r.unique_id): r.scale for r in metrics.mase_scale(series, table, 7).collect()}
    assert set(got) == set(scale) and all(got[k] == pytest.approx(scale[k]) for k in scale)


@pytest.mark.parametrize("train", [None, 10])
def test_windows(spark, tables, train):
    rows, origins, series, table = tables
    want = sorted((o, u, t, "train" if t < o else "test") for o in origins for u, t, _ in rows if t < o + timedelta(days=3) and (train is None or t >= o - timedelta(days=train)))
    got = backtest.rolling_split(series, table, train, 3, "day")
    assert sorted((r.origin, r.unique_id, r.ds, r.part) for r in got.collect()) == want
    assert backtest.rolling_split(series, table.limit(0), train, 3, "day").count() == 0


def test_no_nested_loop_over_origins(spark, tables):
    _, _, series, table = tables
    made = [backtest.rolling_split(series, table, 10, 3, "day"), backtest.last_value(series, table), metrics.mase_scale(series, table, 7)]
    assert not any(join in plan(df) for df in made for join in ("NestedLoop", "CartesianProduct"))


def test_one_run_equals_a_fit_for_each_origin(spark):
    rng = np.random.default_rng(4)
    rows = [(u, datetime(2015 + k // 12, k % 12 + 1, 1), float(10 + 3 * np.sin(k) + rng.normal())) for u, n in (("a", 60), ("b", 60), ("c", 30), ("d", 7)) for k in range(n)]
    series = spark.createDataFrame(rows, "unique_id string, ds timestamp, y double")
    origins = [datetime(2016, 1, 1), datetime(2017, 6, 1), datetime(2019, 12, 1), datetime(2015, 3, 1)]
    table = spark.createDataFrame([(o,) for o in origins], "origin timestamp")
    got = reconcile.smooth_at_origins(series, table, 4, 12).collect()
    ahead = {(r.origin, r.unique_id, r.horizon): (r.ds, r.y_hat) for r in got if r.origin}
    fitted = {(r.unique_id, r.ds): r.y_hat for r in got if not r.origin}
    want_ahead, want_fitted = {}, {}
    for u in "abcd":
        own = sorted((t, y) for v, t, y in rows if v == u)
        for o in origins:
            past = np.array([y for t, y in own if t < o])
            if len(past) >= 12:
                f, _ = reconcile.additive_smoother(past, 12, 4)
                for k, v in enumerate(f):
                    month = o.month - 1 + k
                    want_ahead[o, u, k + 1] = (datetime(o.year + month // 12, month % 12 + 1, 1), v)
        if len(own) > 12:
            _, f = reconcile.additive_smoother(np.array([y for _, y in own]), 12, 4)
            want_fitted |= {(u, t): v for (t, _), v in zip(own[12:], f[12:])}
    assert set(ahead) == set(want_ahead) and all(ahead[k][0] == want_ahead[k][0] and ahead[k][1] == pytest.approx(want_ahead[k][1]) for k in ahead)
    assert set(fitted) == set(want_fitted) and all(fitted[k] == pytest.approx(want_fitted[k]) for k in fitted)
    assert reconcile.smooth_at_origins(series.limit(0), table, 4, 12).count() == 0
    assert reconcile.smooth_at_origins(series, table.limit(0), 4, 12).filter(F.col("origin").isNotNull()).count() == 0
