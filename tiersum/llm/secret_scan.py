"""Secrets in texts: fixed patterns, and values in a credential's place that are hard to guess.

The guess cost of a value is the base-10 logarithm of the guesses that a cracker needs who tries segments of known kinds: words by
rank, dates, repeats, keyboard walks, brute force. The cheapest segmentation is found by dynamic programming
over the value, in time linear in its length. Ranks are those of a public tokenizer's vocabulary, whose tokens are in order of use.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersum.llm.bpe import default_vocabulary
from tiersum.llm.common import WordCache, per_worker

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of hex digits has at least 32 from its first one on, or none has
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
KINDS = ["assign", "access", "hex", "guess"]

#: A credential's name, a sign or verb of assignment, and a value; after a verb, one that isn't letters alone.
CONTEXT = re.compile(
    r"""(?ai)(?<![A-Z0-9])(?:pass(?:word|phrase|code|wd)?|pwd|pin|secret|token|credentials?|(?:api|access|private|auth|encryption|signing|secret)[ _-]?key|auth|bearer)["']?"""
    r"""(?:[ \t]*(?:=>|->|:=|[:=])[ \t]*|[ ](?:is|was)[ ](?=\S*[^\sA-Z]))["'`]?([^\s"'`<>,;]{4,})"""
)
#: Values that take 10^8 guesses or more are spans of their own.
MIN_LOG10_GUESSES = 8.0

#: The kind of the next segment is one of five.
OPEN = math.log10(5)
LONGEST_WORD, LONGEST_ROOT, LEAST_WALK = 24, 8, 4
LEET = str.maketrans("@4301!$57", "aaeoiisst")
DATE = re.compile(r"(?a:(?:19|20)\d\d([-/._]?)(?:1[0-2]|0?[1-9])\1(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])([-/._]?)(?:1[0-2]|0?[1-9])\2(?:19|20)?\d\d)")
YEAR = re.compile(r"(?a:(?:19|20)\d\d)")
DATE_COST, YEAR_COST = math.log10(365 * 100), 2.0
KEY_ROWS = ["`1234567890-=", " qwertyuiop[]", " asdfghjkl;'", " zxcvbnm,./"]


def _keys() -> dict[tuple[str, str], tuple[int, int]]:
    """The direction from a key to each key that touches it; each row is half a key to the right of the one above."""
    at = {c: (r, k) for r, row in enumerate(KEY_ROWS) for k, c in enumerate(row) if c != " "}
    touching = [(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)]
    by_place = {v: c for c, v in at.items()}
    return {(c, by_place[r + y, k + x]): (y, x) for c, (r, k) in at.items() for y, x in touching if (r + y, k + x) in by_place}


TOUCHING = _keys()
WALK_COST = math.log10(47)  # any key may be the first


def direction(a: str, b: str):
    """Where a walk goes from a to b: to a neighbouring key, or to the next or previous letter; None if nowhere."""
    step = TOUCHING.get((a, b))
    if step is None and a.isascii() and b.isascii() and a.isalpha() and b.isalpha() and abs(ord(a) - ord(b)) == 1:
        step = ord(b) - ord(a)
    return step


@cache
def character_cost(c: str) -> float:
    if not c.isascii():
        return 3.0
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() else 33)


def vocabulary_ranks(path: str) -> dict[str, int]:
    """word -> rank from 1 on of the tokens of three or more letters of a vocabulary with word ends."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ranks: dict[str, int] = {}
    for token in sorted(vocabulary, key=vocabulary.get):
        word = token.removesuffix("</w>")
        if len(word) >= 3 and word.isascii() and word.isalpha():
            ranks.setdefault(word.lower(), len(ranks) + 1)
    return ranks


class GuessCost:
    def __init__(self, ranks: dict[str, int]):
        self.ranks = ranks
        self.starts = {w[:k] for w in ranks for k in range(1, len(w) + 1)}

    def word(self, own: str) -> float | None:
        """Cost of a word in this spelling, None if it isn't one."""
        low = own.lower()
        rank, more = self.ranks.get(low), 0.0
        if rank is None:
            plain = low.translate(LEET)
            rank = self.ranks.get(plain) if plain != low else None
            if rank is None:
                return None
            more = math.log10(2) * sum(a != b for a, b in zip(low, plain))
        upper = sum(c.isupper() for c in own)
        if upper:
            more += math.log10(2) * (1 if own[0].isupper() and upper == 1 or upper == len(own) else 1 + min(upper, len(own) - upper))
        return math.log10(rank) + more

    def ahead(self, value: str) -> Iterator[list[tuple[int, str, float]]]:
        """For each position, the (end, kind, cost) of words, dates, repeats and walks that start there."""
        n, low = len(value), "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        plain = low.translate(LEET)
        force = [0.0, *accumulate(map(character_cost, value))]
        same = []  # for each root length, how many characters from a position on equal the one a root further
        for p in range(1, LONGEST_ROOT + 1):
            run = [0] * (n + 1)
            for i in range(n - p - 1, -1, -1):
                run[i] = run[i + 1] + 1 if value[i] == value[i + p] else 0
            same.append(run)
        reach, turns, way = [1] * n, [0] * n, [None] * n
        for i in range(n - 2, -1, -1):
            way[i] = direction(low[i], low[i + 1])
            if way[i] is not None:
                reach[i] = reach[i + 1] + 1
                turns[i] = turns[i + 1] + (way[i + 1] is not None and way[i + 1] != way[i])
        for i in range(n):
            found = []
            for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
                if low[i:j] not in self.starts and plain[i:j] not in self.starts:
                    break
                cost = self.word(value[i:j])
                if cost is not None:
                    found.append((j, "word", cost))
            if value[i].isdigit():
                m = DATE.match(value, i)
                if m:
                    found.append((m.end(), "date", DATE_COST + (math.log10(4) if m.group(1) or m.group(2) else 0.0)))
                if YEAR.match(value, i):
                    found.append((i + 4, "date", YEAR_COST))
            for p, run in enumerate(same, 1):
                times = 1 + run[i] // p
                if times >= (3 if p == 1 else 2):
                    word = self.word(value[i : i + p]) if p >= 3 and plain[i : i + p] in self.ranks else None
                    cost = force[i + p] - force[i] if word is None else min(word, force[i + p] - force[i])
                    found.append((i + p * times, "repeat", cost + math.log10(times)))
            if reach[i] >= LEAST_WALK:
                found.append((i + reach[i], "walk", WALK_COST + math.log10(reach[i]) + turns[i] * math.log10(6)))
            yield found

    def segments(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """(log10 of guesses, segments (start, end, kind)) of the cheapest segmentation; of equal ones, the first found."""
        n = len(value)
        best = [0.0] + [math.inf] * n  # of each prefix
        force = [math.inf] * (n + 1)  # of each prefix that ends in brute force
        last: list = [None] * (n + 1)
        opened = [0] * (n + 1)  # where the brute-force span that ends here began
        for i, found in enumerate(self.ahead(value)):
            for j, kind, cost in found:
                if best[i] + OPEN + cost < best[j]:
                    best[j], last[j] = best[i] + OPEN + cost, (i, kind)
            c = character_cost(value[i])
            longer = force[i] <= best[i] + OPEN
            force[i + 1], opened[i + 1] = (force[i] + c, opened[i]) if longer else (best[i] + OPEN + c, i)
            if force[i + 1] < best[i + 1]:
                best[i + 1], last[i + 1] = force[i + 1], (opened[i + 1], "force")
        out, at = [], n
        while at > 0:
            start, kind = last[at]
            out.append((start, at, kind))
            at = start
        return best[n], out[::-1]

    def __call__(self, value: str) -> float:
        return self.segments(value)[0]


def scan(text: str, cost, least: float = MIN_LOG10_GUESSES) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 of guesses) of a text's secrets by start, then kind; ends are exclusive, in code points.

    Base matches are whole and don't overlap within a kind; `assign` is rated by its value. `guess` is a value in a credential's place of
    10^least guesses or more that no base match contains.
    """
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= ASSIGN_VALUE:
            found.append((m.start(), 0, m.end(), cost(m.group(2))))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    found.sort(key=lambda s: s[:2])
    guessed, base, end_of_base = [], 0, 0
    for m in CONTEXT.finditer(text):
        value = m.group(1).rstrip(".!?)]}:")
        start, end = m.start(1), m.start(1) + len(value)
        while base < len(found) and found[base][0] <= start:
            end_of_base = max(end_of_base, found[base][2])
            base += 1
        if len(value) >= 4 and end_of_base < end:
            guesses = cost(value)
            if guesses >= least:
                guessed.append((start, 3, end, guesses))
    return [(KINDS[kind], start, end, guesses) for start, kind, end, guesses in sorted(found + guessed, key=lambda s: s[:2])]


SPANS = "doc_id {kind}, spans array<struct<kind:string,start:long,end:long,log10_guesses:double>>"


def scan_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = MIN_LOG10_GUESSES) -> DataFrame:
    """docs -> (doc_id, spans), one row per row of docs, whole texts, in one pass without a shuffle.

    Null and empty texts have no spans. Rows don't depend on each other: repeated rows get the same spans, a null id stays null, other columns are
    ignored, an empty table gives none. path: a vocabulary with word ends, by default the public one.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = per_worker(("guess costs", path), lambda: WordCache(GuessCost(vocabulary_ranks(path)), 50_000))
        for batch in batches:
            found = [scan(t.as_py() or "", cost, least) for t in batch.column(1)]
            flat = [s for spans in found for s in spans]
            offsets = [0]
            for spans in found:
                offsets.append(offsets[-1] + len(spans))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
            struct = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], kind) for k, kind in enumerate(kinds)], ["kind", "start", "end", "log10_guesses"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SPANS.format(kind=rows.schema["doc_id"].dataType.simpleString()))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch of overlapping spans replaced by the mark."""
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]  # else it continues the last mark
        kept = F.when(fresh, F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(a["out"])
        return F.struct(kept.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    return F.aggregate(spans, state, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def digest_spans(found: DataFrame) -> DataFrame:
    """scan_documents -> (doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans)."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = told(F.filter("spans", lambda s: s["kind"] != "guess"))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(base.cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
