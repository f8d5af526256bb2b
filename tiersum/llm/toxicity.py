"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence has probability p = sigmoid(b + sum of the weights of its hashed features); the document's is the noisy-or
1 - prod(1 - p). Only documents are labelled: the likelihood's gradient reaches a sentence in proportion to its share
in the document's score, so that the fit finds the offending sentences by itself and `locate` can report them.
"""

from __future__ import annotations

import re
import string
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersum.llm.common import WordCache, fit_texts, is_held_out, per_worker

DIMENSIONS = 1 << 18
#: At most so many labelled rows of each class are fitted.
MAX_FIT_ROWS = 2_500
#: Bytes of text of each class that are fitted at most.
MAX_FIT_BYTES = 16 << 20
#: Longer sentences are cut into runs of so many words, so that a sentence's score doesn't grow with missing punctuation.
SENTENCE_WORDS = 40
THRESHOLD = 0.3
#: How strongly weights are drawn to zero; chosen on folds of the labelled rows that aren't held out.
SPARSITY = 2e-3
HOLD_OUT = 4
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_WORD = re.compile(r"\S+")
#: Stripped from both ends of a word.
MARKS = string.punctuation + "¡¿«»“”„’‘…–—"


def word_features(word: str) -> list[int]:
    """Hashed lower-cased word and its beginnings of four to six letters; a word of bare punctuation has none."""
    bare = word.lower().strip(MARKS)
    if not bare:
        return []
    crc = zlib.crc32
    if bare.isascii():
        data = bare.encode()
        heads = [data[:4], data[:5], data[:6]]
    else:
        data = bare.encode("utf-8", "surrogatepass")
        heads = [bare[:n].encode("utf-8", "surrogatepass") for n in (4, 5, 6)]
    out = [crc(data, 1) % DIMENSIONS]
    if len(bare) >= 4:
        out += [crc(h, len(h) + 2) % DIMENSIONS for h in heads[: len(bare) - 3]]
    return out


def sentences(text: str | None) -> Iterator[tuple[int, int]]:
    """(start, end) of each sentence with a word in it: runs without . ! ? or line end, with the marks that follow."""
    for m in _SENTENCE.finditer(text or ""):
        words = m.group().split()
        if len(words) > SENTENCE_WORDS:
            spans = [w.span() for w in _WORD.finditer(m.group())]
            for k in range(0, len(spans), SENTENCE_WORDS):
                part = spans[k : k + SENTENCE_WORDS]
                yield m.start() + part[0][0], m.start() + part[-1][1]
        elif words:
            yield m.span()


def sentence_words(text: str | None) -> list[list[str]]:
    """The words of each of `sentences`."""
    found = [words for s in _SENTENCE.findall(text or "") if (words := s.split())]
    if max(map(len, found), default=0) > SENTENCE_WORDS:
        found = [words[k : k + SENTENCE_WORDS] for words in found for k in range(0, len(words), SENTENCE_WORDS)]
    return found


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class NoisyOrModel:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, text: str | None, cache: WordCache) -> np.ndarray:
        found = sentence_words(text)
        if not found:
            return np.empty(0)
        values = np.array(cache.many([w for words in found for w in words]))
        ends = np.cumsum([len(words) for words in found])
        return self.bias + np.add.reduceat(values, np.concatenate(([0], ends[:-1])))

    def word(self, word: str) -> float:
        w = self.weights
        return float(sum([w[i] for i in word_features(word)]))


def fit_noisy_or(index: list[np.ndarray], sentence: list[np.ndarray], label: np.ndarray, weight: np.ndarray, epochs: int = 6, l1: float = SPARSITY, seed: int = 7) -> NoisyOrModel:
    """AdaGrad over batches of documents. index: features of each document's words; sentence: number of the sentence each lies in."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-4)
    n_sent = np.array([int(s[-1]) + 1 if len(s) else 0 for s in sentence])
    bias, bias2 = -np.log(20 * max(1.0, float(np.average(n_sent)))) if len(n_sent) else -8.0, 1.0
    weight = weight / weight.mean() if len(weight) else weight
    for epoch in range(epochs):
        order = rng.permutation(len(index))
        for lo in range(0, len(order), 128):
            rows = order[lo : lo + 128]
            base = np.concatenate(([0], np.cumsum(n_sent[rows])))
            if not base[-1]:
                continue
            flat = np.concatenate([index[r] for r in rows]).astype(np.int64)
            where = np.concatenate([sentence[r] + b for r, b in zip(rows, base)]).astype(np.int64)
            doc = np.repeat(np.arange(len(rows)), n_sent[rows])
            z = bias + np.bincount(where, weights=w[flat], minlength=base[-1])
            s = np.bincount(doc, weights=softplus(z), minlength=len(rows))
            y = label[rows]
            factor = weight[rows] * np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(s, 50)), 1e-6), 1.0)
            dz = np.clip(factor[doc] / (1 + np.exp(-np.clip(z, -500, 500))), -5, 5)
            g = np.bincount(flat, weights=dz[where], minlength=DIMENSIONS) / len(rows)
            at = np.nonzero(g)[0]
            g2[at] += g[at] ** 2
            step = 0.5 / np.sqrt(g2[at])
            moved = w[at] - step * g[at]
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - step * l1 / 10, 0)  # shrink by soft threshold
            gb = dz.sum() / len(rows)
            bias2 += gb * gb
            bias -= 0.3 / np.sqrt(bias2) * gb
    return NoisyOrModel(w.astype(np.float32), float(bias))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = per_worker(("toxicity features",), lambda: WordCache(word_features))
    for batch in batches:
        index, sentence = [], []
        for t in batch.column(0):
            own, number = [], []
            for words in sentence_words(t.as_py()):
                got = [i for w in words for i in cache(w)]
                own += got
                number.append(len(got))
            index.append(np.array(own, np.int32))
            sentence.append(np.array(number, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.list_(pa.int32())), pa.array(sentence, pa.list_(pa.int32())), batch.column(1)], ["index", "sentence", "label"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_FIT_ROWS, max_bytes: int = MAX_FIT_BYTES) -> NoisyOrModel:
    """Fit on at most max_rows labelled documents of each class, by order of a hash of the id, none of them held out, and on at most
    max_bytes of text of each class.

    Null labels and ids, and labels without a document, are left out; of several labels of one id the largest counts.
    Rows are weighted back to the classes' shares. Without any labels the model scores all texts near zero.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & ~is_held_out(F.col(id_col), HOLD_OUT)).groupBy(F.col(id_col).alias("labelled_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = None
    for y in (0, 1):
        part = known.filter(F.col("label") == y).orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(max_rows)
        sample = part if sample is None else sample.unionByName(part)
    texts = fit_texts(docs, sample.withColumnRenamed("labelled_id", "id"), "label", id_col, text_col, max_bytes)
    got = texts.mapInArrow(_featurize, "index array<int>, sentence array<int>, label int").toArrow()
    label = got.column("label").to_numpy() if got.num_rows else np.empty(0, int)
    have = np.maximum(np.bincount(label, minlength=2), 1)
    weight = np.array([shares.get(0, 0), shares.get(1, 0)])[label] / have[label]
    lists = lambda name: [x.values.to_numpy()[a:b] for x in got.column(name).chunks for a, b in zip(x.offsets.to_numpy()[:-1], x.offsets.to_numpy()[1:])]
    return fit_noisy_or(lists("index"), [np.repeat(np.arange(len(n)), n) for n in lists("sentence")], label, weight)


RATED = "score double, worst_start long, worst_end long, worst_score double"


def scorer(spark: SparkSession, model: NoisyOrModel, text: Column, threshold: float = THRESHOLD) -> Column:
    """Column of struct<score, worst_start, worst_end, worst_score>: the noisy-or probability of a text, 0 where it has no sentence; from the threshold on, the
    place of the sentence that is likeliest to offend (the first of equal ones) and its own probability."""
    held, tag = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    @F.pandas_udf(RATED)
    def score(texts: pd.Series) -> pd.DataFrame:
        own = held.value
        word = per_worker(("noisy-or", tag), lambda: WordCache(own.word))
        rows = []
        for t in texts:
            logits = own.sentence_logits(t, word) if t else []
            total = float(-np.expm1(-softplus(logits).sum())) if len(logits) else 0.0
            start = end = worst = None
            if len(logits) and total >= threshold:
                k = int(np.argmax(logits))
                start, end = next(islice(sentences(t), k, None))
                worst = float(1 / (1 + np.exp(-np.clip(logits[k], -500, 500))))
            rows.append((total, start, end, worst))
        out = pd.DataFrame(rows, columns=["score", "worst_start", "worst_end", "worst_score"])
        return out.astype({"worst_start": "Int64", "worst_end": "Int64", "worst_score": "Float64"})

    return score(text)


def score_documents(docs: DataFrame, model: NoisyOrModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs -> (doc_id, held_out, score, predicted, worst_start, worst_end, worst_score), one row per row of docs.

    The last three locate the worst sentence of a predicted document, in code points, end exclusive, and are null for others. Null, empty and wordless texts score 0.
    A null id counts as held out. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col), HOLD_OUT).alias("held_out"), scorer(docs.sparkSession, model, F.col(text_col), threshold).alias("s"))
    return rows.select("doc_id", "held_out", "s.score", (F.col("s.score") >= threshold).cast("int").alias("predicted"), "s.worst_start", "s.worst_end", "s.worst_score")


def select_documents(docs: DataFrame, model: NoisyOrModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with a score below the threshold, with all their columns."""
    name = f"toxic_{uuid.uuid4().hex}"
    return docs.withColumn(name, scorer(docs.sparkSession, model, F.col(text_col), threshold)["score"]).filter(F.col(name) < threshold).drop(name)


def locate(docs: DataFrame, model: NoisyOrModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs -> (doc_id, start, end, sentence, score): the sentences whose own probability is at least the threshold."""
    held, tag = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        word = per_worker(("noisy-or", tag), lambda: WordCache(own.word))
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p = 1 / (1 + np.exp(-np.clip(own.sentence_logits(t, word), -500, 500)))
                rows += [(i, a, b, t[a:b], float(q)) for (a, b), q in zip(sentences(t), p) if q >= threshold]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    names = ["doc_id", "start", "end", "sentence", "score"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, "doc_id long, start long, end long, sentence string, score double")
