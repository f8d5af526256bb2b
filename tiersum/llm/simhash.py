"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into three segments of 22, 21 and 21 bits. Two fingerprints at two or fewer differing
bits agree in at least one segment altogether (pigeonhole) and differ by two bits at most in every other one. The
perfect binary Golay code (23 bits, 12 of them data, radius 3) turns a segment into the indices of the codewords to
which it or a neighbour at one bit decodes: one index if the nearest codeword is within two bits, else six. Segments
at two or fewer bits have a common neighbour, hence a common index. A key is an exact segment and one Golay index of
the following segment; pairs that share a key are verified.

Rows of a key that many fingerprints have aren't brought together: each of these fingerprints goes to its 65 midpoints, the words
at one or no bit from it. Fingerprints at two or fewer bits share a midpoint, and no midpoint has more than 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.llm.common import BROADCAST_ROWS, join_hot, materialize
from tiersum.llm.components import connected_components

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
#: (shift, width) of the segments of a fingerprint
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
GOLAY_POLYNOMIAL = 0b101011100011
#: Larger key groups are compared through midpoints instead of shifts.
SHIFT_GROUP = 48
#: Keys of more fingerprints than one task links in half a minute are split by midpoints, in groups of their own.
HOT_KEY = 100_000


def fingerprint(text: str | None) -> int:
    """The majority of XXH64 bits over word shingles; zero without words."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    words = data.split()
    if not words:
        return 0
    n = len(words) - SHINGLE_WORDS + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(b" ".join(words), HASH_SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = np.zeros(64, np.int64)
    for lo in range(0, n, 65_536):
        hi = min(n, lo + 65_536)
        hashes = np.array([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[lo:hi].tolist(), ends[lo + 2 : hi + 2].tolist())], ">u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, fp long): the 64 fingerprint bits as a signed long, one row per row of docs. Null or wordless text: 0."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def golay_syndromes() -> np.ndarray:
    """For each of the 2048 remainders modulo the polynomial, the error pattern of three or fewer bits that has it."""
    one = []
    for bit in range(23):
        r = 1 << bit
        for top in range(22, 10, -1):
            if r >> top & 1:
                r ^= GOLAY_POLYNOMIAL << (top - 11)
        one.append(r)
    table = np.zeros(2048, np.int64)
    for i in range(23):
        table[one[i]] = 1 << i
        for j in range(i):
            table[one[i] ^ one[j]] = 1 << i | 1 << j
            for k in range(j):
                table[one[i] ^ one[j] ^ one[k]] = 1 << i | 1 << j | 1 << k
    return table


_SYNDROMES: list[np.ndarray] = []


def golay_decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 data bits) of the one codeword within three bits of each 23-bit word."""
    if not _SYNDROMES:
        _SYNDROMES.append(golay_syndromes())
    r = words.copy()
    for top in range(22, 10, -1):
        r ^= (r >> top & 1) * (GOLAY_POLYNOMIAL << (top - 11))
    return (words ^ _SYNDROMES[0][r]) >> 11


def golay_indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for each distinct codeword index to which a word or a neighbour at one of its `width` bits decodes."""
    near = np.concatenate([golay_decode(words)[:, None], *(golay_decode(words ^ (1 << b))[:, None] for b in range(width))], axis=1)
    near.sort(axis=1)
    new = np.ones(near.shape, bool)
    new[:, 1:] = near[:, 1:] != near[:, :-1]
    row, col = np.nonzero(new)
    return row, near[row, col]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, reps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        bits = fps.view(np.uint64)
        seg = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
        for k in range(3):
            row, index = golay_indices(seg[(k + 1) % 3], SEGMENTS[(k + 1) % 3][1])
            key = (np.int64(k) << np.int64(34)) | (seg[k][row] << np.int64(12)) | index
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row]), pa.array(reps[row])], ["key", "fp", "rep"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that join two trees when taken in order: at most one fewer than the nodes."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _by_midpoints(bits: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large group: fingerprints at two or fewer bits share a word at one or no bit from each."""
    flips = np.concatenate(([0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)))).astype(np.uint64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    parts = min(256, 1 << max(0, (len(bits) // 60_000)).bit_length())  # midpoints by their low bits bound the memory
    for part in range(parts):
        mid, who = [], []
        for f in flips:
            m = bits ^ f
            at = np.nonzero((m & np.uint64(parts - 1)) == part)[0]
            mid.append(m[at])
            who.append(at)
        mid, who = np.concatenate(mid), np.concatenate(who)
        order = np.argsort(mid, kind="stable")
        mid, who = mid[order], who[order]
        same = mid[1:] == mid[:-1]
        found.append((reps[who[:-1][same]], reps[who[1:][same]]))
    a, b = (np.concatenate(x) for x in zip(*found))
    return _forest(a, b)


def link_sorted(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (rep, rep) that span the same components as all pairs of one key at two or fewer bits. Rows are sorted by key."""
    starts = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1))
    sizes = np.diff(np.concatenate((starts, [len(key)])))
    bits, found = fp.view(np.uint64), []
    for s, n in zip(starts[sizes > SHIFT_GROUP], sizes[sizes > SHIFT_GROUP]):
        found.append(_by_midpoints(bits[s : s + n], rep[s : s + n]))
    keep = np.repeat((sizes <= SHIFT_GROUP) & (sizes > 1), sizes)
    key, bits, rep = key[keep], bits[keep], rep[keep]
    for shift in range(1, min(SHIFT_GROUP, len(key))):
        at = np.nonzero(key[shift:] == key[:-shift])[0]
        if not len(at):
            break
        at = at[np.bitwise_count(bits[at] ^ bits[at + shift]) <= MAX_BITS]
        found.append((rep[at], rep[at + shift]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return _forest(*(np.concatenate(x) for x in zip(*found)))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []

    def out(parts):
        a, b = link_sorted(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        cols = tuple(c.to_numpy() for c in batch.columns)
        if not len(cols[0]):
            continue
        last = np.searchsorted(cols[0], cols[0][-1])  # rows of the last key wait for the next batch
        if last:
            yield out([*held, tuple(c[:last] for c in cols)])
            held = []
        elif held and held[0][0][0] != cols[0][0]:
            yield out(held)
            held = []
        held.append(tuple(c[last:] for c in cols))
    if held:
        yield out(held)


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mid, rep) for each fingerprint and word at one or no bit from it."""
    flips = np.concatenate(([0], np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64)))).astype(np.uint64)
    for batch in batches:
        bits, rep = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array((bits[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(rep, len(flips)))], ["mid", "rep"])


def links(nodes: DataFrame) -> DataFrame:
    """nodes(fp, rep), stored, distinct fingerprints -> (a, b): links that span the components of all pairs at two or fewer bits."""
    keys = materialize(nodes.select("fp", "rep").mapInArrow(_keys, "key long, fp long, rep long"), "keys")
    hot = materialize(keys.groupBy("key").count().filter(F.col("count") > HOT_KEY).select("key"), "hot")
    many = hot.count()
    if not many:
        return keys.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
    hot = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
    usual = keys.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long")
    mids = keys.join(hot, "key", "left_semi").select("fp", "rep").distinct().mapInArrow(_midpoints, "mid long, rep long")
    near = mids.groupBy("mid").agg(F.collect_list("rep").alias("reps"))  # 65 at most
    split = near.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).filter("a <> b").distinct()
    return usual.union(split)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, fingerprint, component_id): component_id is the smallest doc_id reachable by links of two or fewer bits.

    One row per row of docs. Null, empty and wordless texts have fingerprint zero and link like any other. Equal
    fingerprints are one node, so that copies, however many, are never compared with one another; a repeated row gets
    the same values; rows with a null id take part as id null and get the component of their fingerprint. Other columns are ignored.
    """
    fps = materialize(simhash(docs, id_col, text_col), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    nodes = materialize(nodes, "nodes")
    comps = connected_components(links(nodes.filter("rep is not null")))
    named = nodes.join(comps, nodes.rep == comps.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"), "copies")
    placed = join_hot(fps, materialize(named, "named"), ["fp"])
    return placed.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
