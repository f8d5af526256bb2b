"""Quality classifier: ordinal cumulative-link (proportional odds) regression over hashed text.

A text's latent score has two parts: the mean over its tokens of the weights of their hashed features, and the sum of the
weights of the distinct words and beginnings of words in it, divided by the square root of their number. The first tells
prose from junk; in the second a single telling word counts, however long the text. With thresholds
t_1 < ... < t_{K-1}, P(grade >= k) = sigmoid(s - t_k): one weight vector is shared by all grades. Thresholds stay in
order because all but the first are stored as logarithms of the gaps. The fit takes a bounded sample of rated rows and
keeps weights at zero that it can't support; scoring covers every row and whole texts.
"""

from __future__ import annotations

import itertools
import operator
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersum.llm import toxicity
from tiersum.llm.common import WordCache, fit_texts, is_held_out, per_worker

DIMENSIONS = 1 << 16
#: At most so many rated rows are fitted, an equal number from each grade.
MAX_FIT_ROWS = 6_000
#: Bytes of text of each grade that are fitted at most.
MAX_FIT_BYTES = 16 << 20
MAX_GRADES = 16
HOLD_OUT = 4
#: Weights are drawn to zero by so much of the likelihood's mean for each unit; chosen on folds of the labelled rows that aren't held out.
SPARSITY = 2e-4
#: Values that the fit, which is the driver's, handles at a time: it holds 8 bytes for each of all.
BLOCK = 1 << 18
#: A worker keeps the values of at most twice so many words.
CACHED_WORDS = 100_000
#: One object for each feature's number, shared by all words.
NUMBERS = list(range(DIMENSIONS))


def _kind(c: str) -> str:
    return "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c


_ASCII_KINDS = "".join(_kind(chr(i)) for i in range(128))
_RUN = re.compile(r"(.)\1+", re.DOTALL)


def shape(word: str) -> str:
    """Character kinds with runs collapsed: 'Hello!!' is 'Aa!'."""
    if word.isascii():
        return "a" if word.isalpha() and word.islower() else _RUN.sub(r"\1", word.translate(_ASCII_KINDS))
    return "".join([k for k, _ in itertools.groupby(map(_kind, word))])


def _index(kind: str, value: str) -> int:
    return zlib.crc32(value.encode("utf-8", "surrogatepass"), zlib.crc32(kind.encode())) % DIMENSIONS


#: Feature of a token that repeats the one before it.
REPEAT = _index("r", "")


#: Checksums of the kinds: that of a kind and a value goes on from there.
_WORD, _SHAPE, _END = (zlib.crc32(kind) for kind in (b"w", b"s", b"e"))


def word_features(word: str) -> tuple[int, int, int]:
    low, crc = word.lower(), zlib.crc32
    data = low.encode("utf-8", "surrogatepass")
    end = data[-4:] if low.isascii() else low[-4:].encode("utf-8", "surrogatepass")
    return crc(data, _WORD) % DIMENSIONS, crc(shape(word).encode("utf-8", "surrogatepass"), _SHAPE) % DIMENSIONS, crc(end, _END) % DIMENSIONS


def presence(word: str) -> tuple[int, ...]:
    """Features of a word's being in a text: the bare lower-cased word and its beginnings of four to six letters."""
    return tuple([NUMBERS[i % DIMENSIONS] for i in toxicity.word_features(word)])


def word_parts(word: str) -> tuple[tuple[int, int, int], tuple[int, ...]]:
    return word_features(word), presence(word)


def features(text: str | None, cache=word_parts) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of a whole text and their values: shares of its tokens, then 1 / sqrt(n) for each of its n distinct
    features of presence; nothing for null, empty or blank texts."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    parts = [cache(w) for w in words]
    flat = np.fromiter((i for p, _ in parts for i in p), np.int64, 3 * len(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    index, count = np.unique(np.concatenate((flat, np.full(repeats, REPEAT))), return_counts=True)
    seen = sorted(set().union(*{s for _, s in parts}))
    values = np.concatenate((count / len(words), np.full(len(seen), 1 / max(1, len(seen)) ** 0.5)))
    return np.concatenate((index, np.array(seen, np.int64))).astype(np.int32), values.astype(np.float32)


@dataclass
class OrdinalModel:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def scoring(self) -> Callable[[str], tuple[float, tuple[int, ...]]]:
        """A function from a word to its weight as a token and its features of presence."""
        w = self.weights.tolist()

        def word(word: str) -> tuple[float, tuple[int, ...]]:
            a, b, c = word_features(word)
            return w[a] + w[b] + w[c], presence(word)

        return word

    def latent(self, texts, cache=None) -> np.ndarray:
        """Latent score of each text; minus infinity, below any threshold, where there are no tokens."""
        w, out = self.weights, np.full(len(texts), -np.inf)
        cache = cache or WordCache(self.scoring(), CACHED_WORDS)
        for k, text in enumerate(texts):
            words = (text or "").split()
            if words:
                repeats = sum(map(operator.eq, words, words[1:]))
                distinct = list(set(words))
                weights, present = zip(*cache.many(distinct))
                total = sum(map(dict(zip(distinct, weights)).__getitem__, words))
                seen = set().union(*present)
                told = w[np.fromiter(seen, np.int64, len(seen))].sum(dtype=np.float64)
                out[k] = (total + repeats * float(w[REPEAT])) / len(words) + told / max(1, len(seen)) ** 0.5
        return out

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, one column each."""
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds[None, :], -500, 500)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def _blocks(indices: list, shares: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(indices, values, number of each row's) of rows together, about BLOCK values a block."""
    counts = np.array([len(x) for x in indices])
    block = np.cumsum(counts) // BLOCK
    for rows in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(block)) + 1):
        lo, hi = rows[0], rows[-1] + 1
        yield np.concatenate(indices[lo:hi]).astype(np.int32, copy=False), np.concatenate(shares[lo:hi]).astype(np.float32, copy=False), counts[lo:hi]


def fit_ordinal(indices: list, shares: list, grade: np.ndarray, weight: np.ndarray, grades: list[float], rounds: int = 150, l2: float = 1e-5, l1: float = 0.0) -> OrdinalModel:
    """Weighted maximum likelihood by full-batch Adam, with a soft threshold of l1 after each step. grade: positions in `grades`. One grade: every tail is near 1 or 0 grades."""
    k = len(grades)
    if k < 2:
        return OrdinalModel(grades or [0.0], np.zeros(DIMENSIONS), np.empty(0))
    blocks = list(_blocks(indices, shares))
    ends = np.cumsum([len(c) for _, _, c in blocks])[:-1]
    above = np.array([max(1e-6, weight[grade >= j].sum() / weight.sum()) for j in range(1, k)])
    start = -np.log(above / np.maximum(1e-6, 1 - above))
    free = np.concatenate(([start[0]], np.log(np.maximum(1e-2, np.diff(start)))))
    w = np.zeros(DIMENSIONS)
    param, m, v = np.concatenate((w, free)), 0.0, 0.0
    total = weight.sum()
    for step in range(1, rounds + 1):
        w, free = param[:DIMENSIONS], param[DIMENSIONS:]
        cuts = np.cumsum(np.concatenate(([free[0]], np.exp(free[1:]))))
        s = np.concatenate([np.bincount(np.repeat(np.arange(len(c)), c), weights=w[i] * v, minlength=len(c)) for i, v, c in blocks])
        edges = np.concatenate(([-np.inf], cuts, [np.inf]))
        with np.errstate(over="ignore"):
            cdf = 1 / (1 + np.exp(np.clip(-(edges[None, :] - s[:, None]), -500, 500)))  # P(latent noise below the cut)
        cdf[:, 0], cdf[:, -1] = 0, 1
        r = np.arange(len(s))
        lo, hi = cdf[r, grade], cdf[r, grade + 1]
        p = np.maximum(hi - lo, 1e-9)
        d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
        scale = weight / total
        g_s = scale * (d_hi - d_lo) / p  # of the negative log likelihood
        g_cut = np.zeros(k + 1)
        np.add.at(g_cut, grade + 1, -scale * d_hi / p)
        np.add.at(g_cut, grade, scale * d_lo / p)
        g_cut = g_cut[1:k]
        g_free = np.cumsum(g_cut[::-1])[::-1] * np.concatenate(([1.0], np.exp(free[1:])))
        g_w = l2 * w
        for (i, x, c), part in zip(blocks, np.split(g_s, ends)):
            g_w += np.bincount(i, weights=x * np.repeat(part, c), minlength=DIMENSIONS)
        g = np.concatenate((g_w, g_free))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.15 / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        param = param - rate * (m / (1 - 0.9**step))
        moved = param[:DIMENSIONS]
        param[:DIMENSIONS] = np.sign(moved) * np.maximum(np.abs(moved) - l1 * rate[:DIMENSIONS], 0)
    free = param[DIMENSIONS:]
    return OrdinalModel(grades, param[:DIMENSIONS].astype(np.float32), np.cumsum(np.concatenate(([free[0]], np.exp(free[1:])))))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = per_worker(("quality features",), lambda: WordCache(word_parts, CACHED_WORDS))
    for batch in batches:
        got = [features(t.as_py(), cache) for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.list_(pa.int32())), pa.array([s for _, s in got], pa.list_(pa.float32())), batch.column(1)], ["index", "share", "grade"])


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", rating_col: str = "rating", max_rows: int = MAX_FIT_ROWS, max_bytes: int = MAX_FIT_BYTES) -> OrdinalModel:
    """Fit on at most max_rows rated rows, an equal number of each grade by order of a hash of the id, none of them held out.

    All grades weigh the same, so that a rare one between two frequent ones keeps its place on the scale. Ratings that are
    null, or whose id is null or has no document, are left out; of several ratings of one id the largest counts. At most
    max_bytes of text of each grade are read. Raises if there are more than 16 grades.
    """
    rated = ratings.filter(F.col(rating_col).isNotNull() & ~is_held_out(F.col(id_col), HOLD_OUT)).groupBy(F.col(id_col).alias("rated_id")).agg(F.max(F.col(rating_col).cast("double")).alias("grade"))
    shares = {r["grade"]: r["count"] for r in rated.groupBy("grade").count().orderBy("grade").limit(MAX_GRADES + 1).collect()}
    if len(shares) > MAX_GRADES:
        raise ValueError(f"more than {MAX_GRADES} grades")
    grades = sorted(shares)
    if not grades:
        return OrdinalModel([0.0], np.zeros(DIMENSIONS), np.empty(0))
    each = max(1, max_rows // len(grades))
    sample = None
    for g in grades:
        part = rated.filter(F.col("grade") == g).orderBy(F.xxhash64("rated_id"), "rated_id").limit(each)
        sample = part if sample is None else sample.unionByName(part)
    texts = fit_texts(docs, sample.withColumnRenamed("rated_id", "id"), "grade", id_col, text_col, max_bytes)
    got = texts.mapInArrow(_featurize, "index array<int>, share array<float>, grade double").toArrow()
    if not got.num_rows:
        return OrdinalModel([0.0], np.zeros(DIMENSIONS), np.empty(0))
    grade = np.searchsorted(grades, got.column("grade").to_numpy())
    per = 1 / np.maximum(np.bincount(grade, minlength=len(grades)), 1)
    lists = lambda name: [x.values.to_numpy()[a:b] for x in got.column(name).chunks for a, b in zip(x.offsets.to_numpy()[:-1], x.offsets.to_numpy()[1:])]
    return fit_ordinal(lists("index"), lists("share"), grade, per[grade], grades, l1=SPARSITY)


def scorer(spark: SparkSession, model: OrdinalModel, text: Column) -> Column:
    """Column of struct<expected, tails>: expected grade and P(grade >= k) for each grade above the lowest."""
    held, tag = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf("expected double, tails array<double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        own = held.value
        cache = per_worker(("ordinal", tag), lambda: WordCache(own.scoring(), CACHED_WORDS))
        tails = own.tails(own.latent(texts.tolist(), cache))
        return pd.DataFrame({"expected": own.expected(tails), "tails": list(tails)})

    return score(text)


def grade_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", min_grade: int = 1, min_tail: float = 0.5) -> DataFrame:
    """docs -> (doc_id, held_out, expected_grade, tail, selected), one row per row of docs.

    tail is P(grade >= min_grade), min_grade being a position among the grades; selected is tail >= min_tail. Texts
    without tokens (null, empty, blank) have the lowest grade and a tail of 0 or next to it. With a single grade there is nothing to choose: tail is 1. Other columns
    are ignored; repeated rows get the same values.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col), HOLD_OUT).alias("held_out"), scorer(spark, model, F.col(text_col)).alias("s"))
    tail = F.get("s.tails", F.lit(min_grade - 1)) if len(model.thresholds) >= min_grade else F.lit(1.0)
    return rows.select("doc_id", "held_out", F.col("s.expected").alias("expected_grade"), tail.alias("tail")).withColumn("selected", F.col("tail") >= min_tail)


def select_documents(docs: DataFrame, model: OrdinalModel, text_col: str = "text", min_grade: int = 1, min_tail: float = 0.5) -> DataFrame:
    """The rows of docs that `grade_documents` selects, with all their columns."""
    if len(model.thresholds) < min_grade:
        return docs
    name = f"tails_{uuid.uuid4().hex}"
    scored = docs.withColumn(name, scorer(docs.sparkSession, model, F.col(text_col))["tails"])
    return scored.filter(F.get(F.col(name), F.lit(min_grade - 1)) >= min_tail).drop(name)


def usability(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) -> (doc_id, rating): 0 junk, 1 sound but abusive prose, 2 sound prose; null quality: not rated."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("rating"))
