"""The cleaning step as a whole against a plain pandas version."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tiersum.operators import clean

START = datetime(2024, 3, 1)
FROM, TO = "2024-03-01 03:00:00", "2024-03-02 20:00:00"


def rows(seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for region in ("n", "s"):
        for k in range(96):
            if rng.random() < 0.8 or k in (0, 95):
                out.append((region, START + timedelta(minutes=30 * k), float(rng.integers(1, 50)) if rng.random() < 0.9 else None))
                if rng.random() < 0.2:
                    out.append((region, START + timedelta(minutes=30 * k), out[-1][2] if rng.random() < 0.5 else 7.0))
    # null hours at both ends of the range and inside
    edges = [START + timedelta(hours=h, minutes=m) for h in (3, 43, 20) for m in (0, 30)]
    return [(r, t, None if r == "n" and t in edges else y) for r, t, y in out]


def plain(own):
    """hourly, missing and quality of one region's rows."""
    frame = pd.DataFrame(own, columns=["region", "ds", "y"])
    per = frame.groupby("ds")["y"]
    n, spread, mean = per.size(), per.max() - per.min(), per.mean()
    grid = mean.reindex(pd.date_range(mean.index.min(), mean.index.max(), freq="30min"))
    hourly = grid[(grid.index >= FROM) & (grid.index < TO)].resample("1h").mean()
    runs, now = [0], 0
    for missing in hourly.isna():
        now = now + 1 if missing else 0
        runs.append(now)
    quality = {"rows": len(frame), "duplicates_identical": int(((n > 1) & (spread == 0)).sum()), "duplicates_conflicting": int(((n > 1) & (spread > 0)).sum()), "missing_halfhours": len(grid) - len(mean), "missing_values": int(mean.isna().sum()), "imputed_hours": int(hourly.isna().sum()), "longest_gap_hours": max(runs)}
    return hourly.interpolate(limit_area="inside"), hourly.isna(), quality


def test_prepare_equals_a_plain_version(spark):
    data = rows()
    got = clean.prepare_all(spark.createDataFrame(data, "region string, ds timestamp, y double").repartition(3), FROM, TO, 24)
    hourly, quality = got.hourly.collect(), {r.region: r.asDict() for r in got.quality.collect()}
    for region in ("n", "s"):
        y, missing, want = plain([r for r in data if r[0] == region])
        own = {r.ds: r for r in hourly if r.region == region}
        assert set(own) == {t.to_pydatetime() for t in y.index}
        for t in y.index:
            r = own[t.to_pydatetime()]
            assert r.imputed == missing[t] and (r.y is None if np.isnan(y[t]) else r.y == pytest.approx(y[t]))
        assert {k: v for k, v in quality[region].items() if k != "region"} == want
    assert quality["n"]["imputed_hours"] >= 3 and sum(r.y is None for r in hourly) >= 2


def test_long_gaps_are_refused(spark):
    data = [r for r in rows() if not (r[0] == "s" and START + timedelta(hours=10) <= r[1] < START + timedelta(hours=14))]
    table = spark.createDataFrame(data, "region string, ds timestamp, y double")
    with pytest.raises(ValueError, match="s: no data for [45]"):
        clean.prepare_all(table, FROM, TO, 3)
    assert clean.prepare_all(table, FROM, TO, 6).hourly.count() > 0
    later = clean.prepare_all(table, "2024-03-01 15:00:00", TO, 3)  # the gap is outside
    assert {r.longest_gap_hours < 4 for r in later.quality.collect()} == {True}
