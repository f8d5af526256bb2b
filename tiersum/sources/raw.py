"""Raw files: half-hourly regional values, the official total with its external forecast, checks against a manifest, count hierarchies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersum.functions import files

#: Format of the raw files: semicolons, a header, UTF-8 with or without a byte order mark, instants with their offset.
OPTIONS = {"sep": ";", "header": "true", "encoding": "UTF-8", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "mode": "FAILFAST"}


def read_regional(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """(region, ds, y) of all files below path, columns code; instant; value. Nothing is corrected: repeated rows, nulls and gaps stay.

    Codes without a name keep the code; names may be left out. Instants are UTC in a session with that time zone.
    """
    raw = spark.read.options(**OPTIONS).schema("code string, ds timestamp, y double").csv(path)
    named = F.create_map(*(F.lit(x) for pair in (names or {"": ""}).items() for x in pair))
    return raw.select(F.coalesce(named[F.col("code")], F.col("code")).alias("region"), "ds", "y")


def read_official(spark: SparkSession, path: str) -> DataFrame:
    """(ds, y, ext): official total and external forecast, columns instant; value; forecast."""
    return spark.read.options(**OPTIONS).schema("ds timestamp, y double, ext double").csv(path)


#: Bytes of a file that a task holds at a time.
CHUNK = 4 << 20
#: Schemes whose files a task can open as streams, and what the opener calls them.
STREAMED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


def _open(uri: str):
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pa_fs.LocalFileSystem().open_input_stream(f"/{rest.lstrip('/')}")
    system, path = pa_fs.FileSystem.from_uri(f"{STREAMED[scheme]}:{rest}")
    return system.open_input_stream(path)


def stream_digest(stream, chunk: int = CHUNK) -> str:
    """sha256 of all that a stream gives, in lowercase hex, a chunk at a time."""
    h = hashlib.sha256()
    while data := stream.read(chunk):
        h.update(data)
    return h.hexdigest()


def manifest_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256) of the files below path, file being the place below it.

    Each file is hashed in one task, chunk by chunk, whatever its size. Only on file systems that tasks can't open as streams a file is read as a whole,
    up to Spark's limit of 2 GB.
    """
    root = files.qualified(spark, path)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    file = F.when(F.col("path").startswith(f"{root}/"), F.substring("path", len(root) + 2, 1 << 20)).otherwise(F.element_at(F.split("path", "/"), -1))
    # Spark's reader passes over files without content
    names = [(s.getPath().toString().removeprefix(f"{root}/"),) for s in files.listed(spark, path) if s.getLen() == 0]
    empty = spark.createDataFrame(names, "file string").withColumn("sha256", F.sha2(F.lit(b""), 256))
    if root.partition(":")[0] not in STREAMED:
        return found.select(file.alias("file"), F.sha2("content", 256).alias("sha256")).union(empty)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, uri in zip(batch["file"], batch["path"]):
                with _open(uri) as stream:
                    yield pd.DataFrame({"file": [name], "sha256": [stream_digest(stream)]})

    return found.select(file.alias("file"), "path").mapInPandas(run, "file string, sha256 string").union(empty)


def manifest_violations(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, problem): files of the manifest(file, sha256) that are missing or changed. Files that it doesn't name are left alone."""
    found = manifest_of(spark, path).withColumnRenamed("sha256", "own")
    both = manifest.join(found, "file", "left")
    return both.filter("own is null or own <> sha256").select("file", F.when(F.col("own").isNull(), "missing").otherwise("changed").alias("problem"))


#: Tables of a count hierarchy.
COUNT_TABLES = {
    "upper": "id string, mu double, actual double",
    "upper_resid": "id string, t int, e double",
    "bottom": "item string, grp string, pmf array<double>, actual double",
    "edges": "upper_id string, item string",
}


def read_counts(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The typed tables of a count hierarchy below path, one Parquet table each; columns of other types or names are refused."""
    out = {}
    for name, schema in COUNT_TABLES.items():
        own = spark.read.parquet(f"{path}/{name}")
        want = {c.split()[0]: c.split()[1] for c in schema.split(", ")}
        if dict(own.dtypes) != want:
            raise ValueError(f"{name} has {dict(own.dtypes)}, not {want}")
        out[name] = own.select(*want)
    return out
