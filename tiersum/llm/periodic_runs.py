"""Periodic runs of words by partition refinement.

Positions of a text are split into classes of equal factors, the factors growing by a word a level. A class is refined only
by the parts of its successors' class that aren't the largest of their parent (smaller half), so that a text of n words
takes O(n log n) moves whatever it repeats. At level q, two neighbouring members of a class that are q apart are a square
with a root of q words; squares at consecutive positions are one run.

Many texts are refined together, in numpy; classes never hold positions of two texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersum.llm.common import forget

WORD = r"[^\x20\x09-\x0D]+"
#: A run has at least so many words, and so many times its period.
LEAST, RATIO = 6, 4
#: Words that are refined together; a longer text is alone.
BATCH_WORDS = 400_000


class Classes:
    """Classes of equal factors of one length, over several texts that each end with a mark of their own."""

    def __init__(self, codes: np.ndarray, limit: np.ndarray):
        """codes: dense, of no two texts the same; limit: the largest period sought at each position."""
        n = len(codes)
        self.limit, self.of, self.level = limit, codes.copy(), 1
        self.members = np.argsort(codes, kind="stable")  # by class
        count = np.bincount(codes)
        self.size, self.start = np.zeros(2 * n + len(count) + 1, np.int64), np.zeros(2 * n + len(count) + 1, np.int64)
        self.size[: len(count)], self.start[: len(count)] = count, np.cumsum(count) - count
        self.used = len(count)
        self.place = np.empty(n, np.int64)
        self.place[self.members] = np.arange(n)
        self.next, self.before = np.full(n, -1), np.full(n, -1)  # neighbours in the class
        self.marked = np.zeros(n, bool)
        self.close: dict[int, list[np.ndarray]] = {}  # by distance, left members of pairs that were neighbours once
        self._link(self.members, codes[self.members])
        self.small = np.arange(n)  # members of the classes that refine others, in order

    def _link(self, members: np.ndarray, group: np.ndarray) -> None:
        same = group[1:] == group[:-1]
        self.next[members] = np.append(np.where(same, members[1:], -1), -1)
        self.before[members] = np.append(-1, np.where(same, members[:-1], -1))
        self._note(members[:-1][same], 1)

    def _note(self, left: np.ndarray, ahead: int) -> None:
        """Remember pairs whose distance is a level yet to come."""
        d = self.next[left] - left
        kept = (d >= self.level + ahead - 1) & (d <= self.limit[left])
        left, d = left[kept], d[kept]
        if len(d):
            order = np.argsort(d, kind="stable")
            left, d = left[order], d[order]
            cuts = np.flatnonzero(np.diff(d)) + 1
            for k, part in zip(d[np.append(0, cuts)].tolist(), np.split(left, cuts)):
                self.close.setdefault(k, []).append(part)

    def squares(self) -> np.ndarray:
        """Positions at which a square with a root of `level` words starts, the root not being a power itself."""
        noted = self.close.pop(self.level, None)
        if noted is None:
            return np.empty(0, np.int64)
        left = np.unique(np.concatenate(noted))
        return left[self.next[left] - left == self.level]

    def refine(self) -> None:
        """Go from factors of `level` words to one word more."""
        right = self.small[self.limit[self.small] > self.level]
        right = right[right > 0]
        right = right[self.size[self.of[right - 1]] > 1]
        own, by = self.of[right - 1], self.of[right]
        order = np.argsort(own * (self.used + 1) + by, kind="stable")
        moved, own, by = right[order] - 1, own[order], by[order]
        self.small = np.empty(0, np.int64)
        if len(moved):
            new_class = np.append(True, own[1:] != own[:-1])
            new_part = new_class | np.append(True, by[1:] != by[:-1])
            first = np.flatnonzero(new_class)
            taken = np.diff(np.append(first, len(own)))
            parts = np.add.reduceat(new_part, first)
            split = (parts > 1) | (taken < self.size[own[first]])  # else all members go together
            if not split.all():
                kept = np.repeat(split, taken)
                moved, own, new_class, new_part = moved[kept], own[kept], new_class[kept], new_part[kept]
            if len(moved):
                self._split(moved, own, new_class, new_part)
        self.level += 1

    def _split(self, moved: np.ndarray, own: np.ndarray, new_class: np.ndarray, new_part: np.ndarray) -> None:
        """Take moved positions, in order of class, part and position, out of their classes, each part to a class of its own."""
        first, heads = np.flatnonzero(new_class), np.flatnonzero(new_part)
        taken, sizes = np.diff(np.append(first, len(own))), np.diff(np.append(heads, len(own)))
        classes = own[first]
        self.marked[moved] = True
        # what stays closes its ranks over every chain of moved neighbours
        stays = np.repeat(self.size[classes] > taken, taken)
        some, of = moved[stays], own[stays]
        back, ahead = self.before[some], self.next[some]
        opens, closes = (back < 0) | ~self.marked[back], (ahead < 0) | ~self.marked[ahead]
        n = len(self.of)
        back = back[opens][np.argsort(of[opens] * n + some[opens])]
        ahead = ahead[closes][np.argsort(of[closes] * n + some[closes])]
        self.next[back[back >= 0]] = ahead[back >= 0]
        self.before[ahead[ahead >= 0]] = back[ahead >= 0]
        joined = back[(back >= 0) & (ahead >= 0)]
        # moved members go to the end of their class's stretch, which is then cut off
        tail = self.start[classes] + self.size[classes] - taken
        slots = np.repeat(tail - first, taken) + np.arange(len(moved))
        there = self.members[slots]
        there = there[~self.marked[there]]
        inside = moved[self.place[moved] < np.repeat(tail, taken)]
        holes = self.place[inside]
        self.members[holes], self.place[there] = there, holes
        self.members[slots], self.place[moved] = moved, slots
        self.marked[moved] = False
        self.size[classes] -= taken
        new = self.used + np.arange(len(heads))
        self.used += len(heads)
        self.start[new], self.size[new] = slots[heads], sizes
        self.of[moved] = np.repeat(new, sizes)
        # the largest part of each class refines nothing
        part_class = np.cumsum(new_class[heads]) - 1
        first_part = np.flatnonzero(new_class[heads])
        most = np.maximum.reduceat(sizes, first_part)
        rest = self.size[classes]
        at_most = np.flatnonzero((sizes == most[part_class]) & (rest < most)[part_class])
        largest = at_most[np.append(True, part_class[at_most][1:] != part_class[at_most][:-1])] if len(at_most) else at_most
        is_small = np.ones(len(heads), bool)
        is_small[largest] = False
        small = [moved[np.repeat(is_small, sizes)]]
        left = (rest > 0) & (rest < most)
        if left.any():
            n_left = rest[left]
            small.append(self.members[np.repeat(self.start[classes[left]] - (np.cumsum(n_left) - n_left), n_left) + np.arange(n_left.sum())])
        self.small = np.sort(np.concatenate(small))
        self._note(joined, 2)
        same = np.repeat(new, sizes)
        within = same[1:] == same[:-1]
        self.next[moved] = np.append(np.where(within, moved[1:], -1), -1)
        self.before[moved] = np.append(-1, np.where(within, moved[:-1], -1))
        self._note(moved[:-1][within], 2)


def find_runs(texts: list[np.ndarray], ratio: int = RATIO, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text, an array of word numbers: its runs (start, length, period) in order of start, then period.

    A run is a stretch with smallest period q and a length of at least max(least, ratio * q) that neither neighbour extends.
    Periods above a ratio-th of a text can't have one and aren't refined for. `ratio` is 2 or more.
    """
    if ratio < 2:
        raise ValueError("a run repeats its period at least twice")
    lengths = np.array([len(t) for t in texts], np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(texts) or not lengths.sum():
        return out
    begin = np.cumsum(lengths + 1) - lengths - 1
    codes, limit, used = np.empty(int(lengths.sum()) + len(texts), np.int64), np.repeat(lengths // ratio, lengths + 1), 0
    for t, at, n in zip(texts, begin.tolist(), lengths.tolist()):
        codes[at : at + n] = t
        codes[at : at + n] += used
        used += int(t.max()) + 1 if n else 0
        codes[at + n] = used
        used += 1
    classes, top, found = Classes(np.unique(codes, return_inverse=True)[1], limit), int(limit.max()), []
    while classes.level <= top:
        at = classes.squares()
        if len(at):
            found.append((at, classes.level))
        if not len(classes.small):
            break  # all classes have one member
        classes.refine()
    for at, q in found:
        cuts = np.flatnonzero(np.diff(at) > 1)
        first, last = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
        length = last - first + 2 * q
        good = length >= max(least, ratio * q)
        first, length = first[good], length[good]
        of = np.searchsorted(begin, first, "right") - 1
        for k, a, n in zip(of.tolist(), (first - begin[of]).tolist(), length.tolist()):
            out[k].append((a, n, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for each of n words but those that a run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        step[start + q] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


RUNS = "doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, least: int = LEAST) -> DataFrame:
    """docs -> (doc_id, n_words, runs, collapsed), one row per row of docs.

    runs: every run of the whole text's words, in order of start, then period; collapsed: the words that aren't a repetition in any
    run, joined by one space. Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows don't depend on each other: repeated
    rows get the same values, a null id stays null, other columns are ignored, an empty table gives none. A text is one task's work,
    however long: about 200 bytes of memory a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            at, total = 0, 0
            words: list[list[bytes]] = []
            for k, text in enumerate(batch.column(1)):
                own = (text.as_py() or b"").split()  # bytes are split at ASCII white space only
                if words and total + len(own) > BATCH_WORDS:
                    yield finish(batch.slice(at, len(words)), words)
                    at, total, words = k, 0, []
                words.append(own)
                total += len(own)
            if words:
                yield finish(batch.slice(at, len(words)), words)

    def finish(batch: pa.RecordBatch, words: list[list[bytes]]) -> pa.RecordBatch:
        texts = []
        for own in words:
            number: dict[bytes, int] = {}
            texts.append(np.fromiter((number.setdefault(w, len(number)) for w in own), np.int64, len(own)))
        found = find_runs(texts, ratio, least)
        collapsed = [b" ".join(compress(own, kept_words(len(own), runs).tolist())) if runs else b" ".join(own) for own, runs in zip(words, found)]
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        offsets = np.cumsum([0] + [len(runs) for runs in found])
        struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        columns = [batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct), pa.array(collapsed, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, RUNS.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def with_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, text), one text in ten ending in a periodic tail, by the crc32 h of its id as text.

    Where h % 10 is 0 and the text has n > 0 words, word i >= a becomes word a + (i - a) % p, with g = h // 10, a = g % n and
    p = 1 + (n - a) // (3 + g % 8), and words are joined by one space. Texts without an id stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), h.alias("h"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    chosen = rows.filter("h % 10 = 0").select("doc_id", "text", words.alias("words"), F.floor(F.col("h") / 10).cast("long").alias("g"))
    # columns of their own, so that words are found once
    n = F.size("words").cast("long")
    sized = chosen.withColumn("n", n).withColumn("a", F.when(n > 0, F.col("g") % n))
    sized = sized.withColumn("rest", F.col("n") - F.col("a")).withColumn("p", 1 + F.floor(F.col("rest") / (3 + F.col("g") % 8)).cast("long"))
    copies = F.ceil(F.col("rest") / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int")), copies)), F.lit(1), F.col("rest").cast("int"))
    text = F.concat_ws(" ", F.slice("words", F.lit(1), F.col("a").cast("int")), tail)
    return sized.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text")).union(rows.filter("h is null or h % 10 <> 0").select("doc_id", "text"))


def digest_runs(found: DataFrame) -> DataFrame:
    """collapse_runs -> (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256).

    start, length, period: of the longest run (ties: smallest start, then period); four nulls where there is none.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(F.concat_ws("", F.transform("runs", line))).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    milli: Column = F.floor(1000 * length / period).cast("long")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
