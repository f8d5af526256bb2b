"""Language identification by n-gram filters with one bit for each language.

One Bloom filter for each language, all with the same hash functions, are stored bit-sliced: a cell holds a mask with a bit for each
language. The AND of an n-gram's cells tells all languages that contain it. A text's popcount N_l of
language l over its n n-grams is corrected for the false positives to expect: with the filter's share of set cells
raised to the number of hashes, f_l, the estimate is (N_l - f_l n) / (1 - f_l). The largest estimate decides.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.llm.common import WordCache, is_held_out, materialize, per_worker

SIZES = (2, 3, 4)
WIDE = max(SIZES)
#: Cells of a filter table: the model's size whatever the corpus, 8 bytes a cell for every 64 languages.
CELLS = 1 << 21
HASHES = 3
#: Languages of one table's masks; more languages take more tables, up to MAX_LANGUAGES (256 MB).
PLANE = 64
MAX_LANGUAGES = 1024
#: A language contains an n-gram seen so often in its texts, at no less than this share of the highest rate of any language.
MIN_COUNT, MIN_RATIO = 3, 0.2
HOLD_OUT = 4
UNDETERMINED = "und"
_LETTERS, _ASCII = regex.compile(r"\p{L}+"), re.compile("[a-z]+")
#: A Counter goes to the shuffle at so many entries.
FLUSH = 400_000
FIELD = 40


def windows(chunk: str) -> list[str]:
    """From each letter on, the longest n-gram or what is left of the word, for each run of letters in a chunk, lower-cased, with _ at both ends.

    A window's beginnings are all n-grams from its place on, so that one lookup stands for several.
    """
    out = []
    low = chunk.lower()
    plain = low.isascii()
    for word in (low,) if plain and low.isalpha() else (_ASCII if plain else _LETTERS).findall(low):
        padded = f"_{word}_"
        out += [padded[i : i + WIDE] for i in range(len(padded) - 1)]
    return out


def beginnings(window: str) -> list[str]:
    return [window[:n] for n in SIZES if n <= len(window)]


def grams(chunk: str) -> list[str]:
    """N-grams of a chunk."""
    return [g for w in windows(chunk) for g in beginnings(w)]


def cells(gram: str) -> list[int]:
    data = gram.encode("utf-8", "surrogatepass")
    first, step = zlib.crc32(data), zlib.crc32(b"~" + data) | 1
    return [(first + i * step) % CELLS for i in range(HASHES)]


@dataclass
class LanguageFilters:
    """languages in order of bit; table: masks of each cell, a row for every 64 languages; prior: the language of most texts."""

    languages: list[str]
    table: np.ndarray
    prior: int

    def __post_init__(self):
        self.table = np.atleast_2d(self.table)
        share = [float((self.table[b // PLANE] >> np.uint64(b % PLANE) & np.uint64(1)).mean()) for b in range(len(self.languages))]
        self.false = np.minimum(np.array(share) ** HASHES, 0.999)

    def mask(self, gram: str) -> int:
        at, out = cells(gram), 0
        for k, plane in enumerate(self.table):
            got = (1 << PLANE) - 1
            for c in at:
                got &= int(plane[c])
            out |= got << PLANE * k
        return out

    def gram_fields(self, gram: str) -> int:
        """One n-gram's popcounts in fields of FIELD bits: one per language, then 1."""
        mask, langs = self.mask(gram), len(self.languages)
        return sum(1 << FIELD * b for b in range(langs) if mask >> b & 1) + (1 << FIELD * langs)

    def fields(self, window: str) -> int:
        """The sum of the fields of a window's n-grams."""
        return sum(map(self.gram_fields, beginnings(window)))

    def counts(self, chunk: str, fields: WordCache) -> int:
        """The sum of the fields of a chunk's n-grams; fields: of windows."""
        return sum(fields.many(windows(chunk)))

    def decide(self, own: np.ndarray, n: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Popcounts (texts x languages) and numbers of n-grams -> language and score of each text."""
        if not len(self.languages):
            return [UNDETERMINED] * len(n), np.zeros(len(n))
        estimate = np.maximum(0, (own - self.false * n[:, None]) / (1 - self.false))
        best, most = estimate.argmax(axis=1), estimate.max(axis=1)
        best = np.where(most > 0, best, self.prior)
        names = [self.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), n.tolist())]
        return names, np.where(n > 0, np.minimum(1.0, estimate[np.arange(len(n)), best] / np.maximum(n, 1)), 0.0)

    def predict(self, text: str | None, counts: WordCache) -> tuple[str, float]:
        """One text, by a cache of chunks' counts."""
        langs = len(self.languages)
        total = sum(counts.many((text or "").split()))
        own = np.array([[total >> FIELD * b & (1 << FIELD) - 1 for b in range(langs)]], float)
        names, scores = self.decide(own.reshape(1, langs), np.array([total >> FIELD * langs]))
        return names[0], float(scores[0])


_LETTER: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For each code point below 65,536, whether it is a letter."""
    if not _LETTER:
        table = np.zeros(1 << 16, bool)
        every = [*range(0xD800), *range(0xE000, 1 << 16)]
        table[every] = [m is not None for m in map(regex.compile(r"\p{L}").match, map(chr, every))]
        _LETTER.append(table)
    return _LETTER[0]


def window_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(codes, word of each, odd words): the windows of many chunks as numbers of four times 16 bits, code points in order, 0 where a window is shorter.

    Chunks with code points beyond 16 bits are odd: they have no codes here. No chunk holds a line feed.
    """
    points = np.frombuffer("\n".join(words).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    word = np.cumsum(points == 10)
    wide = np.flatnonzero(points > 0xFFFF)
    odd = np.unique(word[wide])
    letter = is_letter()[np.minimum(points, 0xFFFF)]
    if len(odd):
        letter &= ~np.isin(word, odd)
    at = np.flatnonzero(letter)
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int64), odd.tolist()
    first = np.append(True, np.diff(at) > 1)
    run = np.cumsum(first) - 1
    lengths = np.bincount(run)
    padded = np.full(len(at) + 2 * len(lengths) + WIDE, ord("_"), np.uint64)
    padded[np.arange(len(at)) + 2 * run + 1] = points[at]
    ends = np.cumsum(lengths + 2) - 1
    end_of = np.repeat(ends, lengths + 2)
    place = np.arange(len(end_of))
    starts = place[place < end_of]
    code = np.zeros(len(starts), np.uint64)
    for k in range(WIDE):
        own = np.where(starts + k <= end_of[starts], padded[starts + k], 0).astype(np.uint64)
        code = code << np.uint64(16) | own
    return code, np.repeat(word[at[first]], lengths + 1), odd.tolist()


def window_of(code: int) -> str:
    return "".join(chr(c) for k in (48, 32, 16, 0) if (c := code >> k & 0xFFFF))


#: Words that are counted at a time, over the number of languages; windows whose rows a worker keeps.
SLICE, KEPT_WINDOWS = 1 << 22, 1 << 20


class Popcounts:
    """Popcounts of many texts at once; the rows of windows seen before are kept."""

    def __init__(self, filters: LanguageFilters):
        self.filters, self.codes, self.rows = filters, np.empty(0, np.uint64), np.empty((0, len(filters.languages) + 1), np.int32)

    def _row(self, window: str) -> list[int]:
        total = self.filters.fields(window)
        return [total >> FIELD * b & (1 << FIELD) - 1 for b in range(len(self.filters.languages) + 1)]

    def of_windows(self, codes: np.ndarray) -> np.ndarray:
        """Row numbers of the codes."""
        own = np.unique(codes)
        new = own[~np.isin(own, self.codes, assume_unique=True)] if len(self.codes) else own
        if len(self.codes) + len(new) > KEPT_WINDOWS // (len(self.filters.languages) + 1) * 4 and len(self.codes):
            self.codes, self.rows, new = self.codes[:0], self.rows[:0], own
        if len(new):
            rows = np.array([self._row(window_of(int(c))) for c in new], np.int32)
            at = np.searchsorted(self.codes, new)
            self.codes, self.rows = np.insert(self.codes, at, new), np.insert(self.rows, at, rows, axis=0)
        return np.searchsorted(self.codes, codes)

    def of_words(self, words: list[str]) -> np.ndarray:
        """(words x languages and n-grams)."""
        codes, word, odd = window_codes(words)
        row = self.of_windows(codes)
        out = np.stack([np.bincount(word, weights=self.rows[row, b], minlength=len(words)) for b in range(self.rows.shape[1])], axis=1) if len(codes) else np.zeros((len(words), self.rows.shape[1]))
        for k in odd:
            for w in windows(words[k]):
                out[k] += self._row(w)
        return out

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.rows.shape[1]))
        step = SLICE // self.rows.shape[1]
        pending, of, size = [], [], 0

        def add() -> None:
            number: dict[str, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for part in pending for w in part), np.int64)
            table, text = self.of_words(list(number)), np.repeat(of, [len(p) for p in pending])
            low = of[0]
            for b in range(out.shape[1]):
                got = np.bincount(text - low, weights=table[ids, b])
                out[low : low + len(got), b] += got

        for k, text in enumerate(texts):
            words = (text or "").split()
            for lo in range(0, len(words), step):
                part = words[lo : lo + step]
                if size + len(part) > step:
                    add()
                    pending, of, size = [], [], 0
                pending.append(part)
                of.append(k)
                size += len(part)
        if pending:
            add()
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def flush():
        for lang, words in held.items():
            codes, word, odd = window_codes(list(words))
            own, at = np.unique(codes, return_inverse=True)
            counted = np.bincount(at, weights=np.fromiter(words.values(), np.int64)[word], minlength=len(own)) if len(own) else []
            seen = {window_of(int(c)): int(n) for c, n in zip(own, counted)}
            for w in map(list(words).__getitem__, odd):
                for x in windows(w):
                    seen[x] = seen.get(x, 0) + words[w]
            out: dict[str, int] = {}
            for x, n in seen.items():
                for g in beginnings(x):
                    out[g] = out.get(g, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, Counter()).update((text.as_py() or "").split())
        if sum(map(len, held.values())) > FLUSH:
            yield from flush()
    yield from flush()


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageFilters:
    """Fill the filters from all texts with a language that aren't held out. Raises for more than 1,024 languages."""
    spark = docs.sparkSession
    known = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), is_held_out(F.col(id_col), HOLD_OUT).alias("held")).filter("lang is not null and not held")
    texts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(texts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(texts)
    table = np.zeros((max(1, -(-len(languages) // PLANE)), CELLS), np.uint64)
    if not languages:
        return LanguageFilters([], table, 0)
    counts = known.select("lang", "text").mapInArrow(_count, "lang string, gram string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    bits = F.broadcast(spark.createDataFrame([(lang, b) for b, lang in enumerate(languages)], "lang string, bit int"))
    per_gram = counts.join(bits, "lang").groupBy("gram").agg(F.collect_list(F.struct("bit", "n")).alias("seen"))  # an entry for each language at most
    per_gram = materialize(per_gram, "grams")
    totals = {r["bit"]: r["n"] for r in per_gram.select(F.explode("seen").alias("s")).groupBy("s.bit").agg(F.sum("s.n").alias("n")).collect()}
    per_bit = F.array(*(F.lit(float(totals.get(b, 0) or 1)) for b in range(len(languages))))
    rated = per_gram.select("gram", F.transform("seen", lambda s: F.struct(s["bit"].alias("bit"), s["n"].alias("n"), (s["n"] / F.get(per_bit, s["bit"])).alias("rate"))).alias("seen"))
    top = F.array_max(F.transform("seen", lambda s: s["rate"]))
    kept = F.filter("seen", lambda s: (s["n"] >= MIN_COUNT) & (s["rate"] >= MIN_RATIO * F.col("top")))
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), s["bit"] % PLANE)
    planes = [F.struct(F.lit(k).alias("plane"), F.aggregate(F.filter(F.col("kept"), lambda s: F.floor(s["bit"] / PLANE) == k), F.lit(0).cast("long"), lambda a, s: a.bitwiseOR(bit(s))).alias("mask")) for k in range(len(table))]
    masks = rated.withColumn("top", top).select("gram", kept.alias("kept")).select("gram", F.explode(F.array(*planes)).alias("p")).select("gram", "p.plane", "p.mask").filter("mask <> 0")
    first, step = F.crc32(F.col("gram").cast("binary")), F.crc32(F.concat(F.lit("~"), "gram").cast("binary")).bitwiseOR(F.lit(1).cast("long"))
    at = F.explode(F.array(*((first + i * step) % CELLS for i in range(HASHES))))
    filled = masks.select(at.alias("cell"), "plane", "mask").groupBy("cell", "plane").agg(F.bit_or("mask").alias("mask")).toArrow()
    table[filled.column("plane").to_numpy(), filled.column("cell").to_numpy()] = filled.column("mask").to_numpy().view(np.uint64)
    return LanguageFilters(languages, table, languages.index(max(languages, key=lambda x: texts[x])))


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, held_out, lang_pred, score), one row per row of docs.

    score is the corrected share of the text's n-grams that the language contains. Null texts and texts without a
    letter, and all texts if nothing was learned, are `und` with score 0; texts of unknown n-grams only get the
    language of most training texts with score 0; of equal estimates the first language by name wins. A null id counts as held out. Other columns are ignored.
    """
    held, tag = docs.sparkSession.sparkContext.broadcast(filters), uuid.uuid4().hex

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        own = held.value

        counts = per_worker(("language", tag), lambda: Popcounts(own)).of_texts(texts.tolist())
        names, scores = own.decide(counts[:, :-1], counts[:, -1])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.select(F.col(id_col).alias("doc_id"), is_held_out(F.col(id_col), HOLD_OUT).alias("held_out"), predict(F.col(text_col)).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score")
