"""Small files that are written once, moves and listings, on any file system that Spark reads."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, none where it doesn't exist."""
    if not exists(spark, folder):
        return []
    return sorted(s.getPath().getName() for s in _system(spark, folder).listStatus(_path(spark, folder)))


def delete(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder to a place where nothing is; raises where something is. As atomic as the file system's renames."""
    files = spark._jvm.org.apache.hadoop.fs
    folder = _path(spark, target).getParent()
    _system(spark, target).mkdirs(folder)
    kind = getattr(files, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.NONE
    system = _system(spark, target)
    at = [system.makeQualified(_path(spark, p)) for p in (source, target)]
    files.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration()).rename(*at, options)


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; whether this call wrote it. Nobody ever sees a part of it."""
    if exists(spark, path):
        return False
    folder = path.rsplit("/", 1)[0]
    part = f"{folder}/_{uuid.uuid4().hex}"
    out = _system(spark, part).create(_path(spark, part), False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        move(spark, part, path)
    except Exception:
        delete(spark, part)
        if exists(spark, path):
            return False
        raise
    return True


def get(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    if not exists(spark, path):
        return None
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def listed(spark: SparkSession, path: str) -> Iterator:
    """The status of each file below a path."""
    found = _system(spark, path).listFiles(_path(spark, path), True)
    while found.hasNext():
        yield found.next()


def qualified(spark: SparkSession, path: str) -> str:
    return _system(spark, path).makeQualified(_path(spark, path)).toString().rstrip("/")


def signature(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of all files below the paths: another one when any of them is written anew."""
    h = hashlib.sha256()
    for path in paths:
        rows = [f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in listed(spark, path)]
        h.update("\n".join(sorted(rows)).encode() + b"\n\n")
    return h.hexdigest()
