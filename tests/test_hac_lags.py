import math

import numpy as np

from tiersum.jobs import queries
from tiersum.operators import inference


def brute_se(e):
    n, d = len(e), e - e.mean()
    last = math.ceil(1.3 * math.sqrt(n))
    g = [d[k:] @ d[: n - k] / n for k in range(min(n, last + 1))]
    return math.sqrt((g[0] + 2 * sum((1 - k / (last + 1)) * g[k] for k in range(1, len(g)))) / n)


def test_all_lags_of_long_series(spark, monkeypatch):
    rng = np.random.default_rng(3)
    series = {f"s{n}": np.convolve(rng.normal(size=n + 19), np.ones(20), "valid") for n in (2, 40, 300)}
    rows = [(u, t, float(v)) for u, e in series.items() for t, v in enumerate(e)]
    errors = spark.createDataFrame(rows, "unique_id string, ds int, e double")
    monkeypatch.setattr(queries, "_last_errors", lambda spark, d: errors)
    for got in (inference.hac_mean(errors, ["unique_id"]), queries.t2_hac_mean(spark, "")):
        se = {r.unique_id: r.se for r in got.collect()}
        assert all(math.isclose(se[u], brute_se(e), rel_tol=1e-5, abs_tol=1e-6) for u, e in series.items())
