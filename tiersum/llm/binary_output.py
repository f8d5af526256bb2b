"""Token-id output: best-fit-decreasing packing into matrices of fixed width, written as binary rows.

Documents are tokenized and packed block by block as a task reads them, so that no row is shuffled and memory is bounded
by a block. Within a block, documents longer than a row are split into whole rows and a rest, without loss; pieces go longest first into
the open row with the least room that is enough. A segment tree over room sizes finds it in logarithmic time: rows
of equal room are interchangeable, so that the tree has as many leaves as a row has tokens, however many rows are open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.llm.bpe import default_vocabulary
from tiersum.llm.common import materialize
from tiersum.llm.token_ids import id_encoder

WIDTH = 2048
END_ID = 2
#: A block closes at so many tokens. A longer document is a block of its own.
BLOCK_TOKENS = 2_000_000


class RoomTree:
    """Segment tree over room sizes 0..width; a node tells whether any row below it is open."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        node = room + self.leaves
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def least(self, need: int) -> int:
        """The least room of an open row that is at least need; -1 if there is none."""
        node, tree = need + self.leaves, self.any
        if tree[node]:
            return need
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1

    def pop(self, room: int) -> int:
        row = self.rows[room].pop()
        if not self.rows[room]:
            node = room + self.leaves
            self.any[node] = 0
            node >>= 1
            while node and not (self.any[2 * node] or self.any[2 * node + 1]):
                self.any[node] = 0
                node >>= 1
        return row


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """Rows as lists of positions in lengths (each 1..width); ties go in the given order."""
    tree, rows = RoomTree(width), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        room = tree.least(lengths[i])
        if room < 0:
            row, room = len(rows), width
            rows.append([])
        else:
            row = tree.pop(room)
        rows[row].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], row)
    return rows


SCHEMA = "row_id long, ids binary, id_bytes int, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, piece_starts array<long>"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = END_ID, pad_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs -> one row per matrix row, SCHEMA.

    ids: `width` little-endian ids of id_bytes bytes, n_tokens of them tokens, then pad_id. cu_seqlens: 0 and the end
    of each segment; position_resets: the offsets at which positions start from zero, one per segment; doc_ids and piece_starts:
    the segment's document and its first token there. Null and empty texts are the end id alone; repeated rows are
    packed once each; a null id stays null; no documents, no rows. Other columns are ignored.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = id_encoder(path)
        kind = np.dtype("<u2" if max(own.largest, pad_id, end_id) < 1 << 16 else "<u4")
        row_id, block, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for i, data in zip(part.column(0).to_pylist(), own.encode_many(part.column(1).to_pylist())):
                    ids = np.append(np.frombuffer(data, "<u4"), end_id).astype(kind)
                    if block and size + len(ids) > block_tokens:
                        yield from pack(block, row_id, kind)
                        row_id, block, size = row_id + (1 << 20), [], 0
                    block.append((i, ids))
                    size += len(ids)
        if block:
            yield from pack(block, row_id, kind)

    def pack(block, row_id, kind) -> Iterator[pa.RecordBatch]:
        pieces = [(d, s, min(width, len(ids) - s)) for d, (_, ids) in enumerate(block) for s in range(0, len(ids), width)]
        out = []
        for k, row in enumerate(best_fit_decreasing([p[2] for p in pieces], width)):
            matrix, ends = np.full(width, pad_id, kind), [0]
            for p in row:
                d, s, n = pieces[p]
                matrix[ends[-1] : ends[-1] + n] = block[d][1][s : s + n]
                ends.append(ends[-1] + n)
            out.append((row_id + k, matrix.tobytes(), kind.itemsize, ends[-1], ends, ends[:-1], [block[pieces[p][0]][0] for p in row], [pieces[p][1] for p in row]))
        for lo in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(zip(*out[lo : lo + 4096]), TYPES)], NAMES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]


def write_ids(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the packed rows as Parquet to the shared folder and read them back."""
    return materialize(pack_ids(docs, path, **options), "token-ids")


def digest_rows(rows: DataFrame) -> DataFrame:
    """Stored rows -> the same with `ids` replaced by ids_crc32, the checksum of the stored bytes."""
    return rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
