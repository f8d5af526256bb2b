"""What the corpus operators share: scratch tables, hold-out remainders, bounded worker caches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tiersum.functions.scratch import materialize

__all__ = ["WordCache", "few", "fit_texts", "forget", "is_held_out", "join_hot", "materialize", "per_worker", "remainder", "table"]

#: Tables of at most so many narrow rows may be broadcast, after a count of the rows.
BROADCAST_ROWS = 1_000_000
#: A key with more rows than this is hot: its rows aren't brought together.
HOT_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def is_held_out(id_col: Column, modulus: int, held: int = 2) -> Column:
    """True where the remainder is `held`. Rows without an id are held out: nothing is learned from them."""
    return F.coalesce(remainder(id_col, modulus) == held, F.lit(True))


def few(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if a count finds it small; else Spark shuffles it. df should be a stored table."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fit_texts(docs: DataFrame, sample: DataFrame, kind: str, id_col: str, text_col: str, max_bytes: int) -> DataFrame:
    """sample(id, kind), a bounded number of distinct ids -> (text, kind): one text for each id that has a document.

    Of several documents of one id the smallest text counts; null is empty. The texts of each kind, in order of a hash of the id,
    are taken while they have max_bytes together; texts above a 16th of max_bytes are left out.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.octet_length("text") <= max_bytes // 16)
    one = texts.join(F.broadcast(sample), "id").groupBy("id", kind).agg(F.min("text").alias("text"))
    total = F.sum(F.octet_length("text")).over(Window.partitionBy(kind).orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    return one.withColumn("total", total).filter(F.col("total") <= max_bytes).select("text", kind)


def join_hot(rows: DataFrame, named: DataFrame, keys: list[str], copies: str = "copies", hot: int = HOT_ROWS) -> DataFrame:
    """rows joined to named, a stored table with one row per key and the number of rows that have it.

    Rows of hot keys, of which there are fewer than rows / hot, stay where they are and meet a broadcast; the others are
    shuffled. rows is read twice and should be a stored table. `copies` is dropped.
    """
    often = named.filter(F.col(copies) > hot)
    n = often.count()
    if not n:
        return rows.join(named.drop(copies), keys)
    if n > BROADCAST_ROWS:  # more than BROADCAST_ROWS * hot rows: no key holds much of them
        return rows.join(named.drop(copies), keys)
    rest = rows.join(F.broadcast(often.select(*keys)), keys, "left_anti").join(named.filter(F.col(copies) <= hot).drop(copies), keys)
    return rows.join(F.broadcast(often.drop(copies)), keys).unionByName(rest)


#: Longer words are never kept by a worker, so that a cache is bounded in bytes as well.
LONG_WORD = 64


class WordCache:
    """A map from word to value of at most two generations of `size` entries, so that frequent words stay; long words don't."""

    def __init__(self, make: Callable, size: int = 150_000):
        self.make, self.size, self.young, self.old = make, size, {}, {}

    def __call__(self, word):
        if len(word) > LONG_WORD:
            return self.make(word)
        value = self.young.get(word)
        if value is None:
            value = self.old.get(word)
            if value is None:
                value = self.make(word)
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[word] = value
        return value

    def many(self, words: list) -> list:
        found = list(map(self.young.get, words))
        return [self(w) if x is None else x for w, x in zip(words, found)] if None in found else found


_PER_WORKER: dict = {}


def _task() -> int | None:
    context = TaskContext.get()
    return context.taskAttemptId() if context else None


def forget() -> None:
    """Drop what earlier tasks have left in this worker. Stages that keep nothing call it, so that the memory is free for them."""
    task = _task()
    for other in [k for k, v in _PER_WORKER.items() if v[2] != task]:
        del _PER_WORKER[other]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
    if trim:
        trim(0)


def per_worker(key, make: Callable):
    """A value kept by a Python worker across tasks; one per kind, so that a newer model replaces an older.

    A task that needs a new value drops what it hasn't used itself, so that the caches of several stages don't add up.
    """
    kind, task = key[0], _task()
    held = _PER_WORKER.get(kind)
    if held is None or held[0] != key:
        _PER_WORKER.pop(kind, None)
        forget()
        held = _PER_WORKER[kind] = [key, make(), task]
    held[2] = task
    return held[1]
