"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

from tiersum.functions import files

#: How often the scratch folder has been cleared: what is kept of its tables holds within one era.
_ERA = 0
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; on a cluster executors wouldn't share it, so that it raises.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tiersum-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tiersum/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, so a lost executor costs one stage."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def era() -> int:
    return _ERA


def drop(stored: DataFrame | None) -> None:
    """Delete a table that `materialize` returned and that nothing reads any more."""
    if stored is not None and (path := _PATHS.pop(stored, None)):
        files.delete(stored.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all of this application's tables, when their results have been used. Whoever keeps tables makes them anew in the next era."""
    global _ERA
    _ERA += 1
    files.delete(spark, scratch_dir(spark))
