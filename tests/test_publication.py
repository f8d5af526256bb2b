"""The commit protocol: a run that dies at any step leaves nothing to be seen and can be run again."""

from pathlib import Path

import pytest

from tiersum.functions import files, scratch
from tiersum.jobs import publication
from tiersum.jobs.study import Study
from tiersum.operators import hierarchy
from tiersum.sources import views

FORECASTS = "origin timestamp, unique_id string, ds timestamp, horizon int, y_hat double"


@pytest.fixture
def run(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a", None, 1, 2.0), (None, "b", None, 1, 3.0)], FORECASTS).selectExpr("timestamp'2024-01-01' as origin", "unique_id", "timestamp'2024-01-01' as ds", "horizon", "y_hat")
    checks = spark.createDataFrame([("finite", 0.0, True, True)], "check string, value double, passed boolean, blocking boolean")
    path = f"{tmp_path}/out"
    return path, lambda name, ok=True: publication.publish(rows, checks.withColumn("passed", checks["passed"] & ok), {"run_id": name}, path)


def visible(spark, path):
    """What plain readers see, without any settling."""
    return {part: [n for n in files.names(spark, f"{path}/{part}") if n.startswith("run_id=")] for part in publication.PARTS}


WRITES = ["parquet", "json1", "json2", "commit"]


@pytest.mark.parametrize("step", WRITES)
def test_death_before_the_commit(spark, run, monkeypatch, step):
    from pyspark.sql.readwriter import DataFrameWriter

    path, publish = run
    count = iter(range(9))

    def dies(*a, **b):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if step == "parquet":
            m.setattr(DataFrameWriter, "parquet", dies)
        elif step == "commit":
            m.setattr(files, "put_once", dies)
        else:
            own = DataFrameWriter.json
            m.setattr(DataFrameWriter, "json", lambda self, p, **b: own(self, p, **b) if next(count) < int(step[-1]) - 1 else dies())
        with pytest.raises(RuntimeError, match="killed"):
            publish("r/1")
    assert visible(spark, path) == dict.fromkeys(publication.PARTS, []) and publication.read_published(spark, path) is None
    assert publish("r/1") and publication.read_published(spark, path).count() == 2
    assert {r.run_id for r in publication.read_published(spark, path).select("run_id").collect()} == {"r/1"}
    with pytest.raises(ValueError, match="exists"):
        publish("r/1")


@pytest.mark.parametrize("moved", [0, 1, 2])
def test_death_after_the_commit(spark, run, monkeypatch, moved):
    """The run counts as published and is finished by whoever comes next."""
    path, publish = run
    own, count = files.move, iter(range(9))

    def move(session, source, target):
        if "_attempts" in source and next(count) >= moved:
            raise RuntimeError("killed")
        own(session, source, target)

    with monkeypatch.context() as m:
        m.setattr(files, "move", move)
        with pytest.raises(RuntimeError, match="killed"):
            publish("r1")
    assert sum(map(len, visible(spark, path).values())) == moved
    with pytest.raises(ValueError, match="exists"):
        publish("r1")
    assert visible(spark, path) == dict.fromkeys(publication.PARTS, ["run_id=r1"])
    assert publication.read_published(spark, path).count() == 2 and files.names(spark, f"{path}/_attempts") == []
    assert [tuple(r)[::2] for r in publication.commits(spark, path).collect()] == [("r1", True)]


def test_two_attempts_at_once(spark, run, monkeypatch):
    path, publish = run
    own = files.put_once

    def second_first(session, target, text):
        monkeypatch.setattr(files, "put_once", own)
        publish("r1", ok=False)
        return own(session, target, text)

    monkeypatch.setattr(files, "put_once", second_first)
    with pytest.raises(ValueError, match="faster"):
        publish("r1")
    assert publication.read_published(spark, path) is None and visible(spark, path)["lineage"] == ["run_id=r1"]
    assert not publication.commits(spark, path).first().published


def test_registry_is_written_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/registry"
    one, other = (spark.createDataFrame([(0, "T", leaf)], "level int, unique_id string, leaf_id string") for leaf in ("a", "b"))
    own = hierarchy.fingerprint(one).first()["s_hash"]
    assert publication.check_hash(spark, one, "v1", path) == own == publication.check_hash(spark, one, "v1", path)
    with pytest.raises(ValueError, match="changed"):
        publication.check_hash(spark, other, "v1", path)
    assert publication.check_hash(spark, other, "v2", path) != own
    assert {(r.source, r.s_hash == own) for r in publication.registry(spark, path).collect()} == {("v1", True), ("v2", False)}
    assert not files.put_once(spark, f"{tmp_path}/registry/{files.names(spark, path)[0]}", "x")


def test_studies_outlive_clear_and_see_new_tables(spark, tmp_path):
    source = Path("/root/testdata/sf0.001")
    if not source.exists():
        pytest.skip("no test tables")
    for t in views.REVENUE_TABLES:
        spark.read.parquet(f"{source}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    first = Study.of(spark, str(tmp_path))
    assert Study.of(spark, str(tmp_path)) is first
    n = first.nodes.count()
    scratch.clear(spark)
    again = Study.of(spark, str(tmp_path))
    assert again is not first and again.nodes.count() == n
    spark.read.parquet(f"{source}/nation.parquet").filter("n_nationkey < 10").write.mode("overwrite").parquet(f"{tmp_path}/nation.parquet")
    assert Study.of(spark, str(tmp_path)).nodes.count() < n
