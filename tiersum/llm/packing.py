"""Packing of tokenized documents into fixed windows by minimum bin slack.

Whole windows are cut from a document's front; what remains is shorter than a window. Remainders are packed by length alone:
Spark counts them by length (fewer rows than a window has tokens, whatever the corpus), the planner fills one window
after the other from that multiset, and Spark gives each document its place by its rank among those of equal length.

A window takes the longest remainder left and the multiset of others that comes closest to its capacity: a subset-sum
dynamic program over a bitset of reachable sums, with binary-split multiplicities and backtracked counts. The same filling is repeated
while stocks last. A window that can't be filled is closed by cutting another remainder, whose rest goes back to
stock, so that padding is left in the last window only.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersum.llm.bpe import default_vocabulary
from tiersum.llm.common import forget, materialize
from tiersum.llm.token_ids import id_encoder

CAPACITY = 4096
SEPARATOR = 2
#: A worker keeps the ids of at most twice so many runs without white space.
CACHED_RUNS = 600_000
#: Documents of one length are ranked in groups of about so many.
RANK_GROUP = 4096
#: So many cut pieces are sent to the tokens at most.
BROADCAST_PIECES = 100_000
PLAN_COLUMNS = ("length", "start", "lo", "hi", "piece", "sequence", "first", "per", "offset")


def tokenize(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = SEPARATOR, cache_size: int = CACHED_RUNS) -> DataFrame:
    """docs -> (row_id, doc_id, n, ids, first_sequence, window_crcs, rest_crc), with end_id after each document's ids.

    ids are little-endian, of 16 bits where the vocabulary allows it, else 32; the checksums are of 32-bit ids:
    window_crcs of the whole windows from the document's start, rest_crc of what remains. first_sequence numbers the
    document's first whole window: the task's number above 40 bits, then a count.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = id_encoder(path, cache_size)
        kind, end = "<u2" if max(own.largest, end_id) < 1 << 16 else "<u4", end_id.to_bytes(4, "little")
        window, task = 4 * capacity, TaskContext.get().partitionId()
        row, sequence = task << 33, (task + 1) << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                n, ids, first, crcs, rest = [], [], [], [], []
                for data in own.encode_many(part.column(1).to_pylist()):
                    data += end
                    n.append(len(data) // 4)
                    ids.append(np.frombuffer(data, "<u4").astype(kind).tobytes())
                    full = len(data) // window
                    first.append(sequence)
                    sequence += full
                    crcs.append([zlib.crc32(data[i * window : (i + 1) * window]) for i in range(full)])
                    rest.append(zlib.crc32(data[full * window :]))
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows, part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(first, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.int64())],
                    ["row_id", "doc_id", "n", "ids", "first_sequence", "window_crcs", "rest_crc"],
                )

    schema = "row_id long, doc_id long, n long, ids binary, first_sequence long, window_crcs array<long>, rest_crc long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def fill(stock: dict[int, int], lengths: list[int], target: int) -> dict[int, int]:
    """The counts by length whose sum is nearest to target from below. lengths: those in stock, longest first."""
    mask, sums, steps = (1 << (target + 1)) - 1, 1, []
    for length in lengths:
        if length > target:
            continue
        left, part = min(stock[length], target // length), 1
        while left > 0:
            part = min(part, left)
            steps.append((length, part, sums))
            sums |= sums << (length * part) & mask
            left -= part
            part *= 2
            if sums >> target & 1:
                break
        if sums >> target & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + part
            at -= length * part
    return used


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows of PLAN_COLUMNS that place every remainder. histogram: number of remainders by length, 1..capacity.

    Remainders of `length` with rank in [lo, hi) have, from token `start`, a piece of `piece` tokens in window
    sequence + (first + rank - lo) // per at offset + (first + rank - lo) % per * piece.
    """
    stock: dict[int, int] = {r: c for r, c in histogram.items() if c > 0}
    held = {r: deque([[r, 0, 0, c]]) for r, c in stock.items()}
    order = sorted(stock, reverse=True)
    rows: list[tuple[int, ...]] = []
    sequence = 0

    def take(remaining: int, many: int):
        stock[remaining] -= many
        queue = held[remaining]
        while many:
            length, start, lo, hi = queue[0]
            n = min(many, hi - lo)
            yield length, start, lo, lo + n
            many -= n
            if lo + n == hi:
                queue.popleft()
            else:
                queue[0][2] = lo + n

    def place(remaining: int, piece: int, per: int, times: int, offset: int) -> list[tuple[int, ...]]:
        first, taken = 0, []
        for length, start, lo, hi in take(remaining, per * times):
            rows.append((length, start, lo, hi, piece, sequence, first, per, offset))
            first += hi - lo
            taken.append((length, start + piece, lo, hi))
        return taken

    while True:
        order = [r for r in order if stock[r] > 0]
        if not order:
            break
        largest = order[0]
        stock[largest] -= 1
        used = fill(stock, order if stock[largest] else order[1:], capacity - largest)
        stock[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        total = sum(r * k for r, k in used.items())
        times = min(stock[r] // k for r, k in used.items())
        slack, donor = capacity - total, 0
        if slack:  # any remainder outside the filling is longer than the slack
            donor = next((r for r in order if stock[r] - used.get(r, 0) > 0), 0)
            if donor:
                times = min(stock[r] // (used.get(r, 0) + (r == donor)) for r in {*used, donor})
        offset = 0
        for r, k in sorted(used.items(), reverse=True):
            place(r, r, k, times, offset)
            offset += r * k
        if donor:
            for length, start, lo, hi in place(donor, slack, 1, times, offset):
                rest = donor - slack
                if rest not in stock or rest not in held:
                    stock[rest], held[rest] = 0, deque()
                stock[rest] += hi - lo
                held[rest].append([length, start, lo, hi])
            order = sorted({*order, donor - slack}, reverse=True)
        sequence += times
    return np.array(rows, np.int64).reshape(-1, len(PLAN_COLUMNS))


def locate(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, start, piece, sequence, offset) arrays for each round of pieces of the given remainders."""
    plan = plan[np.lexsort((plan[:, 2], plan[:, 1], plan[:, 0]))]
    cls = plan[:, 0] << 20 | plan[:, 1]
    names, group = np.unique(cls, return_inverse=True)
    keys = (group.astype(np.int64) << 44) | plan[:, 2]
    at, start = np.arange(len(length)), np.zeros(len(length), np.int64)
    while len(at):
        g = np.searchsorted(names, length[at] << 20 | start)
        p = plan[np.searchsorted(keys, (g.astype(np.int64) << 44) | rank[at], side="right") - 1]
        j = p[:, 6] + rank[at] - p[:, 2]
        yield at, start, p[:, 4], p[:, 5] + j // p[:, 7], p[:, 8] + j % p[:, 7] * p[:, 4]
        start = start + p[:, 4]
        more = start < length[at]
        at, start = at[more], start[more]


def rank_equal_lengths(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """rows(row_id, rest, ...) -> with `rank`, 0.. among rows of equal rest. Frequent lengths are ranked in salted groups."""
    spark = rows.sparkSession
    groups = spark.createDataFrame([(r, -(-c // RANK_GROUP)) for r, c in histogram.items()], "rest long, groups long")
    salted = rows.join(F.broadcast(groups), "rest").withColumn("salt", F.pmod(F.xxhash64("row_id"), F.col("groups")))
    sizes = salted.groupBy("rest", "salt").count()
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("rest").alias("b_rest"), F.col("salt").alias("b_salt"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("rest", "salt").orderBy("row_id")
    numbered = salted.withColumn("number", F.row_number().over(own) - 1)
    ranked = numbered.join(base, (F.col("rest") == F.col("b_rest")) & (F.col("salt") == F.col("b_salt")))
    return ranked.withColumn("rank", (F.col("base") + F.col("number")).cast("long")).drop("groups", "salt", "number", "base", "b_rest", "b_salt")


PIECES = "row_id long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_tokens(tokens: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """tokens of `tokenize` (a stored table) -> one row per piece, PIECES; ids_crc32 is of 32-bit ids.

    Every token lies in exactly one piece; a window's pieces are gapless from offset 0, and all windows but the last are full.
    """
    spark = tokens.sparkSession
    rows = tokens.drop("ids").withColumn("rest", F.col("n") % capacity)
    histogram = {r["rest"]: r["count"] for r in rows.filter("rest > 0").groupBy("rest").count().collect()}
    if max(histogram.values(), default=0) >= 1 << 44:
        raise ValueError("too many remainders of one length")
    plan = spark.sparkContext.broadcast(plan_windows(histogram, capacity))
    ranked = rank_equal_lengths(rows.filter("rest > 0"), histogram)
    whole = rows.filter("rest = 0").withColumn("rank", F.lit(-1).cast("long"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            row, doc, n, first, rest_crc, rest, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_id", "doc_id", "n", "first_sequence", "rest_crc", "rest", "rank"))
            full = n // capacity
            crcs = batch.column("window_crcs").flatten().to_numpy()
            of = np.repeat(np.arange(len(n)), full)
            i = np.arange(len(of)) - np.repeat(np.cumsum(full) - full, full)
            out = [(of, i * capacity, np.full(len(of), capacity), crcs, first[of] + i, np.zeros(len(of), np.int64), np.ones(len(of), bool))]
            at = np.nonzero(rest > 0)[0]
            for k, start, piece, sequence, offset in locate(plan.value, rest[at], rank[at]) if len(at) else ():
                own = at[k]
                whole_piece = piece == rest[own]
                out.append((own, full[own] * capacity + start, piece, np.where(whole_piece, rest_crc[own], 0), sequence, offset, whole_piece))
            of, start, piece, crc, sequence, offset, known = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[of]), batch.column("doc_id").take(pa.array(of)), pa.array(start), pa.array(piece), pa.array(crc.astype(np.int64), mask=~known), pa.array(n[of]), pa.array(sequence), pa.array(offset)],
                PIECE_NAMES,
            )

    columns = ["row_id", "doc_id", "n", "first_sequence", "window_crcs", "rest_crc", "rest", "rank"]
    pieces = materialize(ranked.select(columns).union(whole.select(columns)).mapInArrow(place, PIECES), "pieces")

    def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for data, n, start, length in zip(batch.column("ids"), batch.column("doc_tokens").to_pylist(), batch.column("start").to_pylist(), batch.column("length").to_pylist()):
                data = data.as_py()
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")
                crc.append(zlib.crc32(ids[start : start + length].astype("<u4").tobytes()))
            cols = [pa.array(crc, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in PIECE_NAMES]
            yield pa.RecordBatch.from_arrays(cols, PIECE_NAMES)

    cut = pieces.filter("ids_crc32 is null")
    few = cut.count() <= BROADCAST_PIECES  # windows are seldom closed by a cut; else both sides are shuffled
    cut = tokens.select("row_id", "ids").join(F.broadcast(cut) if few else cut, "row_id").mapInArrow(checksum, PIECES)
    return pieces.filter("ids_crc32 is not null").union(cut)


PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, cache_size: int = CACHED_RUNS) -> DataFrame:
    """docs -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    Null and empty texts are the end id alone. Repeated rows are packed once each; a null id stays null. An empty
    table gives none. Other columns are ignored. cache_size bounds a worker's memory and changes no result.
    """
    tokens = materialize(tokenize(docs, path, id_col, text_col, capacity, cache_size=cache_size), "tokens")
    return pack_tokens(tokens, capacity).drop("row_id")
