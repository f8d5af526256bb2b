"""Near-duplicate embeddings found by a pivot-permutation index.

Each vector is described by the ordered list of its NEAREST reference points (pivots, a bounded sample of the vectors by
hash). Two vectors are candidates if they share at least MIN_SHARED of these and two of their FIRST nearest; candidates are
verified by cosine in double precision. Equal vectors are one node with a count.

Inverted lists have a label and two pivots as key, so that they stay short while the number of pivots grows with the
square root of the number of vectors. A pair of vectors is counted in one list only, that of the two smallest pivots which both have among their FIRST.
The lists are searched twice. At first they hold the distinct pivot sets, without vectors: sets that have a candidate in a list stay
in it. Then the vectors of these sets come to their lists. A long list is cut into blocks by a hash; pairs of
blocks are compared by tasks of their own, which return link counts by vector and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.llm.common import few, join_hot, materialize
from tiersum.llm.components import connected_components

THRESHOLD = 0.98
NEAREST = 8
FIRST = 5
MIN_SHARED = 3
#: The number of pivots is the square root of the number of vectors, within these bounds.
MIN_PIVOTS, MAX_PIVOTS = 64, 16_384
#: Pivots are picked from a sample of so many times their number, none with a cosine above APART to another.
SAMPLE_TIMES, APART = 4, 0.8
#: Vectors of a block, and rows compared at a time.
BLOCK, TILE = 4096, 512
#: Lists of more pivot sets keep them all until the vectors are compared.
LONG_LIST = 16_384
KEYS = ["label", "size", "p", "q"]


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def describe(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Positions of each vector's nearest pivots, nearest first; ties go to the earlier pivot."""
    k = min(nearest, len(pivots))
    out, step = np.empty((len(x), k), np.int32), max(1, 4_000_000 // len(pivots))
    for lo in range(0, len(x), step):
        far = -(x[lo : lo + step] @ pivots.T)
        edge = np.partition(far, k - 1, axis=1)[:, k - 1 : k]
        for row, near in enumerate(far <= edge):
            at = np.nonzero(near)[0]
            out[lo + row] = at[np.argsort(far[row, at], kind="stable")][:k]
    return out


def signature(lists: np.ndarray) -> np.ndarray:
    """The FIRST nearest in ascending order, then the others in ascending order."""
    return np.concatenate((np.sort(lists[:, :FIRST], axis=1), np.sort(lists[:, FIRST:], axis=1)), axis=1)


def spread_out(x: np.ndarray, wanted: int) -> np.ndarray:
    """The first `wanted` rows that are no closer than APART to one kept before, so that a crowded group gets one pivot."""
    kept, n = np.empty((min(wanted, len(x)), x.shape[1])), 0
    for lo in range(0, len(x), 256):
        block, before = x[lo : lo + 256], n
        for v in block[~(block @ kept[:n].T > APART).any(axis=1)]:
            if n == len(kept):
                return kept
            if not (kept[before:n] @ v > APART).any():
                kept[n] = v
                n += 1
    return kept[:n]


class Bitsets:
    """The pivots of one list's signatures as bits: `all` of them, and the `first` ones."""

    def __init__(self, sig: np.ndarray, p: int, q: int):
        names, at = np.unique(sig, return_inverse=True)
        at = at.reshape(sig.shape)
        words = -(-len(names) // 64)
        self.all, self.first = np.zeros((len(sig), words), np.uint64), np.zeros((len(sig), words), np.uint64)
        rows = np.arange(len(sig))
        for j in range(sig.shape[1]):
            bit = np.uint64(1) << (at[:, j] % 64).astype(np.uint64)
            self.all[rows, at[:, j] // 64] |= bit
            if j < FIRST:
                self.first[rows, at[:, j] // 64] |= bit
        smaller = (names < q) & (names != p)  # a pair that shares one of these belongs to another list
        self.other = np.zeros(words, np.uint64)
        for k in np.nonzero(smaller)[0].tolist():
            self.other[k // 64] |= np.uint64(1 << k % 64)

    def candidates(self, a: np.ndarray, b: np.ndarray, shared: int) -> np.ndarray:
        """Matrix of the pairs of rows a and b that share enough pivots and belong to this list."""
        count, away = np.zeros((len(a), len(b)), np.uint8), np.zeros((len(a), len(b)), bool)
        for w in range(self.all.shape[1]):
            count += np.bitwise_count(self.all[a, w, None] & self.all[None, b, w])
            if self.other[w]:
                away |= (self.first[a, w, None] & self.first[None, b, w] & self.other[w]) != 0
        return (count >= shared) & ~away


def verify(ok: np.ndarray, xa: np.ndarray, xb: np.ndarray, threshold: float) -> np.ndarray:
    """The candidates whose cosine is at least the threshold."""
    if ok.mean() > 0.05:
        return ok & (xa @ xb.T >= threshold)
    i, j = np.nonzero(ok)
    ok[i, j] = np.einsum("ij,ij->i", xa[i], xb[j]) >= threshold
    return ok


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the components of a symmetric link matrix, without the roots."""
    root = np.arange(len(links))
    while True:
        low = np.minimum(root, np.where(links, root[None, :], len(links)).min(axis=1))
        low = low[low]
        if (low == root).all():
            at = np.nonzero(root != np.arange(len(root)))[0]
            return at, root[at]
        root = low


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    new = np.ones(batch.num_rows, bool)
    columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.nonzero(new)[0]


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], wanted: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """All rows of each key, one batch a key. Rows come sorted by key. wanted: rows whose key is worth it even alone."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        if held and any(held[-1].column(c)[held[-1].num_rows - 1] != batch.column(c)[0] for c in keys):
            yield whole()
            held = []
        sizes = np.diff(starts)
        take = sizes > 1
        if wanted is not None:
            take |= np.maximum.reduceat(wanted(batch), starts)[:-1] if len(sizes) else False
        if held and len(sizes):
            held.append(batch.slice(0, int(starts[1])))
            yield whole()
            held, take[0] = [], False
        for k in np.nonzero(take)[0]:
            yield batch.slice(int(starts[k]), int(sizes[k]))
        held.append(batch.slice(int(starts[-1])))
    if held:
        yield whole()


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<i4").reshape(batch.num_rows, -1)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each two of a signature's first pivots."""
    for batch in batches:
        width = pa.compute.binary_length(batch.column("sig")).to_numpy()
        for n in np.unique(width):
            part = batch.filter(pa.array(width == n))
            sig = _signatures(part)
            k = min(FIRST, sig.shape[1])
            for i, j in [(i, j) for i in range(k) for j in range(i + 1, k)] or [(0, 0)]:
                yield pa.RecordBatch.from_arrays([part.column("label"), part.column("size"), pa.array(sig[:, i]), pa.array(sig[:, j]), part.column("sig"), part.column("members")], [*KEYS, "sig", "members"])


def _own(batch: pa.RecordBatch) -> np.ndarray:
    """Signatures of several vectors in the list to which pairs of these belong."""
    head = np.frombuffer(b"".join([s[:8] if len(s) >= 8 else s * 2 for s in batch.column("sig").to_pylist()]), "<i4").reshape(-1, 2)
    return (batch.column("members").to_numpy() > 1) & (head[:, 0] == batch.column("p").to_numpy()) & (head[:, 1] == batch.column("q").to_numpy())


def _tiles(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    for k in range(0, len(a), TILE):
        for m in range(k if same else 0, len(b), TILE):
            yield a[k : k + TILE], b[m : m + TILE], same and k == m


def _searched(shared: int):
    """Lists of signatures -> the rows that have a candidate in their list, with the number of vectors of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in groups(batches, KEYS, _own):
            sig, members, keep = _signatures(got), got.column("members").to_numpy(), _own(got).copy()
            if len(sig) > 1:
                bits, every = Bitsets(sig, got.column("p")[0].as_py(), got.column("q")[0].as_py()), np.arange(len(sig))
                for a, b, same in _tiles(every, every, True):
                    ok = bits.candidates(a, b, min(shared, sig.shape[1]))
                    if same:
                        np.fill_diagonal(ok, False)
                    keep[a] |= ok.any(axis=1)
                    keep[b] |= ok.any(axis=0)
            if keep.any():
                part = got.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in [*KEYS, "sig", "members"]), pa.array(np.full(part.num_rows, members[keep].sum()))], [*KEYS, "sig", "members", "total"])

    return run


def _linked(shared: int, threshold: float):
    """Pairs of blocks of vectors -> (rep, links, other): link counts by vector, and links of a spanning forest."""
    keys = [*KEYS, "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in groups(batches, keys):
            p, q, lo, hi = (got.column(c)[0].as_py() for c in keys[2:])
            if got.num_rows < 2:
                continue
            x, rep, copies, block, sig = _matrix(got.column("x")), got.column("rep").to_numpy(), got.column("copies").to_numpy(), got.column("block").to_numpy(), _signatures(got)
            bits, count, edges = Bitsets(sig, p, q), np.zeros(len(rep), np.int64), []
            for a, b, same in _tiles(np.nonzero(block == lo)[0], np.nonzero(block == hi)[0], lo == hi):
                ok = bits.candidates(a, b, min(shared, sig.shape[1]))
                if same:
                    ok = np.triu(ok, 1)
                if not ok.any() or not (ok := verify(ok, x[a], x[b], threshold)).any():
                    continue
                count[a] += ok @ copies[b]
                count[b] += ok.T @ copies[a]
                both = np.concatenate((a, b))
                full = np.zeros((len(both),) * 2, bool)
                full[: len(a), len(a) :] = ok
                if same:
                    both, full = a, ok
                i, j = forest(full | full.T)
                edges.append((rep[both[i]], rep[both[j]]))
            at = np.nonzero(count)[0]
            if len(at):
                i, j = (np.concatenate(e) for e in zip(*edges))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((rep[at], i))), pa.array(np.concatenate((count[at], np.zeros(len(i), np.int64)))), pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(j)])], ["rep", "links", "other"])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, nearest: int = NEAREST, min_shared: int = MIN_SHARED) -> DataFrame:
    """vectors -> (vec_id, n_links, component_id, kept), one row per row of vectors.

    Vectors link if their labels, of any type, are equal and their cosine is at least the threshold. n_links counts the other rows
    linked directly, equal vectors included; component_id is the smallest vec_id reachable by links, itself included;
    kept is vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label or
    id, link with nothing; so do vectors of different lengths. A null id keeps a null component and is kept.
    Repeated rows are vectors of their own with one id. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False))
    nodes = materialize(rows.filter(good).groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "vectors")
    wanted = min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(nodes.count())))
    sample = nodes.orderBy(F.xxhash64("rep"), "rep").select("x").limit(SAMPLE_TIMES * wanted).toArrow().column("x").combine_chunks()
    sizes = sample.value_lengths().to_numpy(zero_copy_only=False)
    pivots = spark.sparkContext.broadcast({int(n): spread_out(_matrix(sample.filter(pa.array(sizes == n))), wanted) for n in np.unique(sizes)})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                part = batch.filter(pa.array(lengths == n))
                own = pivots.value.get(int(n), np.ones((1, int(n))))  # a length without pivots has one list
                sig = signature(describe(_matrix(part.column("x")), own, nearest))
                packed = pa.array([s.tobytes() for s in sig], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(np.full(len(sig), n, np.int32)), packed, *(part.column(c) for c in ("rep", "copies", "x"))], ["label", "size", "sig", "rep", "copies", "x"])

    described = materialize(nodes.mapInArrow(index, f"label string, size int, sig binary, rep long, copies long, x {kind}"), "described")
    sets = described.groupBy("label", "size", "sig").agg(F.count("*").alias("members"))
    lists = sets.mapInArrow(_lists, "label string, size int, p int, q int, sig binary, members long")
    # a long list is never brought together: all its rows go on to the blocks
    long = lists.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.sum("members").alias("total")).filter(F.col("rows") > LONG_LIST).select(*KEYS, "total")
    long = few(materialize(long, "long"))
    short = lists.join(long, KEYS, "left_anti").select(*lists.columns)
    searched = short.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_searched(min_shared), "label string, size int, p int, q int, sig binary, members long, total long")
    places = searched.unionByName(lists.join(long, KEYS))
    dealt = join_hot(described, materialize(places, "places"), ["label", "size", "sig"], "members")
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    keys = [*KEYS, "lo", "hi"]
    found = dealt.select(*keys, "block", "rep", "copies", "sig", "x").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_linked(min_shared, threshold), "rep long, links long, other long")
    found = materialize(found, "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found.filter("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = nodes.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", F.xxhash64("x").alias("hash"), F.col("x").alias("k_x"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"), "copies")
    keyed = rows.withColumn("hash", F.when(good, F.xxhash64("x")))
    # rows that link with nothing get no key: they stay beside the join
    alone = keyed.filter("hash is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    placed = join_hot(keyed.filter("hash is not null"), materialize(known, "known"), ["label", "hash"]).filter("x = k_x")
    out = placed.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
