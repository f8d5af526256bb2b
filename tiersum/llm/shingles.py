"""SimHash near-duplicates at a Jaccard similarity of word shingles: Golay keys propose pairs, minima the rest, exact similarity decides.

Texts are near copies if their sets of five-word shingles have a similarity of 0.8 or more. Fingerprints of these shingles go through
the Golay keys of `simhash`, which find pairs at two or fewer bits. But pairs at 0.8 differ in ten bits on average, beyond what
the keys of two segments can index, so that the other candidates come from 32 bands of four minima: a pair
at 0.8 shares no band with probability 5e-8. Of a pair's 128 minima at least 80 must agree (at 0.8, 102 are expected, with
a deviation of 4.5), then the sets themselves are compared. Within a band's bucket a strongest spanning forest is proposed first.
What it leaves in several components is searched once more, by sketches without sets: texts that have a candidate of another
component stay in the bucket. The sets of these come to the bucket and are compared there, in blocks of bounded bytes, each pair in the
first bucket that it shares; a task returns links that span components, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.functions.scratch import drop
from tiersum.llm.common import few, forget, join_hot, materialize
from tiersum.llm.components import connected_components
from tiersum.llm.simhash import links

SHINGLE_WORDS = 5
#: Least similarity, as a fraction.
SIMILARITY = (4, 5)
BANDS, BAND_ROWS = 32, 4
MINIMA = BANDS * BAND_ROWS
#: Pairs with fewer equal minima aren't compared.
LEAST_EQUAL = 80
#: The first so many texts of a bucket make its forest; the others hang on the most similar of these.
HEADS = 256
#: Sets of a bucket are compared in blocks of about so many bytes.
BLOCK_BYTES = 8 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def shingle_set(text: str | None) -> tuple[int, np.ndarray]:
    """Hash of the words and the sorted distinct hashes of their shingles; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    content = xxhash.xxh3_64_intdigest(b" ".join(words))
    if not words:
        return content, np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + n]) * _MIX[k]
        out ^= out >> np.uint64(29)
    return content, np.unique(out)


def majority(shingles: np.ndarray) -> int:
    """SimHash of a set of shingles: the bits that over half of them have, as a signed number."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(shingles), 65_536):
        total += np.unpackbits(shingles[lo : lo + 65_536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(shingles)).tobytes(), "little", signed=True)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the hash functions."""
    if len(shingles) < 1000:
        return (shingles * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1)
    return np.array([(shingles * a + b).min() for a, b in zip(_FACTORS, _OFFSETS)], np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[4]
    for k in range(BAND_ROWS):
        key = (key ^ least.reshape(BANDS, BAND_ROWS)[:, k]) * _MIX[k]
        key ^= key >> np.uint64(31)
    return key


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        content, size, prints, sketch, bands = [], [], [], [], []
        for text in batch.column(1):
            c, s = shingle_set(text.as_py())
            content.append(c)
            size.append(len(s))
            prints.append(majority(s))
            least = minima(s) if len(s) else None
            sketch.append(least.astype(np.uint8).tobytes() if len(s) else b"")
            bands.append(band_keys(least).tobytes() if len(s) else b"")
        columns = [batch.column(0), pa.array(np.array(content, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(prints, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bands, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", "size", "fp", "sketch", "bands"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "content"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their keys. Rows come sorted by key, the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # rows of the last key wait for the next batch
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and held[0].column(0)[0].as_py() != key[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _ranges(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.nonzero(key[1:] != key[:-1])[0] + 1))
    return starts, np.diff(np.concatenate((starts, [len(key)])))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose key another row has as well."""
    for got in _whole_groups(batches):
        _, sizes = _ranges(got.column(0).to_numpy())
        yield from got.filter(pa.array(np.repeat(sizes > 1, sizes))).to_batches()


def _equal(sketch: np.ndarray, size: np.ndarray, i: int, m: int) -> np.ndarray:
    """Equal minima of text i and each of the first m, -1 where the sizes of the sets rule similarity out."""
    p, q = SIMILARITY
    n = size[:m]
    got = (sketch[:m] == sketch[i]).sum(axis=1)
    return np.where((np.minimum(n, size[i]) * q >= np.maximum(n, size[i]) * p), got, -1)


def forest(sketch: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of one bucket, at most one fewer than its texts: the strongest spanning forest of the heads, the others' best heads."""
    m = min(len(size), HEADS)
    best, near, left, at, out = np.full(m, -2), np.zeros(m, np.int64), np.ones(m, bool), 0, []
    for _ in range(m - 1):
        left[at] = False
        got = _equal(sketch, size, at, m)
        near[got > best] = at
        best = np.maximum(best, got)
        at = int(np.where(left, best, -3).argmax())
        if best[at] >= LEAST_EQUAL:
            out.append((at, int(near[at])))
    for i in range(m, len(size)):
        got = _equal(sketch, size, i, m)
        if got[j := int(got.argmax())] >= LEAST_EQUAL:
            out.append((i, j))
    return out


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of each bucket's forest."""
    for got in _whole_groups(batches):
        content, size, sketch = got.column(1).to_numpy(), got.column(2).to_numpy().astype(np.int64), _rows_of(got.column(3), np.uint8, MINIMA)
        found = set()
        for s, n in zip(*(x.tolist() for x in _ranges(got.column(0).to_numpy()))):
            names = content[s : s + n].tolist()
            found.update((min(names[i], names[j]), max(names[i], names[j])) for i, j in forest(sketch[s : s + n], size[s : s + n]))
        a, b = (list(x) for x in zip(*found)) if found else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def apart(sketch: np.ndarray, size: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Which texts of one bucket have a candidate of another component."""
    names, count = np.unique(component, return_counts=True)
    keep = np.zeros(len(size), bool)
    for i in np.nonzero(component != names[count.argmax()])[0].tolist():
        near = (_equal(sketch, size, i, len(size)) >= LEAST_EQUAL) & (component != component[i])
        keep |= near
        keep[i] |= near.any()
    return keep


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in _whole_groups(batches):
        size, component, sketch = got.column(2).to_numpy().astype(np.int64), got.column(4).to_numpy(), _rows_of(got.column(3), np.uint8, MINIMA)
        parts = [slice(s, s + n) for s, n in zip(*(x.tolist() for x in _ranges(got.column(0).to_numpy())))]
        keep = np.concatenate([apart(sketch[x], size[x], component[x]) for x in parts])
        yield from got.select(["key", "content", "size", "component"]).filter(pa.array(keep)).to_batches()


def _rows_of(column: pa.ChunkedArray, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def links_apart(key: np.ndarray, content: np.ndarray, component: np.ndarray, aside: np.ndarray, members: int, sketch: np.ndarray, bands: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that span the components of all links between a block's texts outside the main component and its members.

    The first `members` rows are the members, the others the texts outside. A pair is compared in the first bucket that it
    shares; of two texts outside (`aside`) the one with the smaller content counts as outside.
    """
    p, q = SIMILARITY
    size = np.array([len(x) for x in sets], np.int64)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for i in range(members, len(sets)):
        band = int((bands[i] == key[i]).argmax())
        first = (bands[:members] == bands[i]).argmax(axis=1)
        ok = (_equal(sketch, size, i, members) >= LEAST_EQUAL) & (first == band) & (bands[:members, band] == key[i])
        ok &= ~(aside[:members] & (content[:members] <= content[i]))
        own = top(int(component[i]))
        at = [j for j in np.nonzero(ok)[0].tolist() if top(int(component[j])) != own]
        if not at:
            continue
        every, ends = np.concatenate([sets[j] for j in at]), np.cumsum(size[at])
        place = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
        common = np.add.reduceat(sets[i][place] == every, np.concatenate(([0], ends[:-1])), dtype=np.int64)
        for j in np.array(at)[common * (p + q) >= p * (size[i] + size[at])].tolist():
            x, y = top(int(component[i])), top(int(component[j]))
            if x != y:
                root[x] = y
                out.append((i, j))
    return out


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted by block and role -> (a, b): links between contents of different components."""
    for got in _whole_groups(batches):
        outside, key, content, component, aside = (got.column(k).to_numpy() for k in (1, 2, 3, 4, 5))
        sketch, bands = _rows_of(got.column(6), np.uint8, MINIMA), _rows_of(got.column(7), np.int64, BANDS)
        sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in got.column(8)]
        a, b = [], []
        for s, n in zip(*(x.tolist() for x in _ranges(got.column(0).to_numpy()))):
            x = slice(s, s + n)
            for i, j in links_apart(key[x], content[x], component[x], aside[x], int((~outside[x]).sum()), sketch[x], bands[x], sets[x]):
                a.append(content[s + i])
                b.append(content[s + j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [shingle_set(t.as_py()) for t in batch.column(0)]
        columns = [pa.array(np.array([c for c, _ in got], np.uint64).view(np.int64)), pa.array([s.tobytes() for _, s in got], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["content", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets are similar enough, by the sets themselves."""
    p, q = SIMILARITY
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common * (p + q) >= p * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def golay_pairs(nodes: DataFrame) -> DataFrame:
    """nodes(content, size, fp, rep) -> (a, b): pairs of contents that join all fingerprints at two or fewer bits."""
    own = materialize(nodes.filter("size > 0").groupBy("fp").agg(F.min("rep").alias("rep")), "fingerprints")
    same = nodes.filter("size > 0").join(own.toDF("fp", "a"), "fp").filter("rep <> a").select("a", F.col("rep").alias("b"))
    names = nodes.select("rep", "content")
    pairs = links(own).union(same).join(names.toDF("a", "x"), "a").join(names.toDF("b", "y"), "b").filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _blocks(rest: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """rest(key, content, size, component), stored -> rows of blocks, in tasks by block, sorted by block and role.

    Every text is a member of its bucket; those of other components than the bucket's main one meet all members. Both are cut into
    blocks by bytes. Counts by bucket and component are added up before they are shuffled.
    """
    cost = F.sum(F.col("size").cast("long") * 8 + 512)
    kinds = rest.groupBy("key", "component").agg(F.count("*").alias("n"), cost.alias("bytes"))
    sums = kinds.groupBy("key").agg(F.max_by(F.struct("component", "bytes"), F.struct("n", "component")).alias("main"), F.sum("bytes").alias("bytes"))
    count = lambda size: F.ceil(size / BLOCK_BYTES).cast("int")
    sums = sums.select("key", F.col("main.component").alias("main"), count(F.col("bytes")).alias("mine"), count(F.col("bytes") - F.col("main.bytes")).alias("theirs"))
    rows = rest.join(sums, "key").withColumn("aside", F.col("component") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("content"), F.col(n)).cast("int")
    role = lambda m, o, outside: F.struct(m.alias("m"), o.alias("o"), F.lit(outside).alias("outside"))
    member = F.transform(F.sequence(F.lit(0), F.col("theirs") - 1), lambda o: role(place("mine"), o, False))
    outside = F.transform(F.sequence(F.lit(0), F.col("mine") - 1), lambda m: role(m, place("theirs"), True))
    rows = rows.withColumn("at", F.explode(F.when(F.col("aside"), F.concat(member, outside)).otherwise(member)))
    rows = rows.select(F.xxhash64("key", "at.m", "at.o").alias("block"), "at.outside", "key", "content", "component", "aside")
    rows = rows.join(members.select("content", "sketch", "bands"), "content").join(sets, "content")
    rows = rows.select("block", "outside", "key", "content", "component", "aside", "sketch", "bands", "shingles")
    return rows.repartition("block").sortWithinPartitions("block", "outside")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, component_id): component_id is the smallest doc_id reachable by links of similarity 0.8 or more.

    One row per row of docs. Texts of equal words are one node, so that copies, however many, are never compared with one
    another; null, empty and wordless texts are one such node. Rows with a null id get the component of their text, and
    null if no row with an id has it. Rows grow with the number of texts; a text outside its bucket's largest
    component is compared with all that have 80 equal minima, inside the tasks.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = materialize(source.mapInArrow(_sketches, "doc_id long, content long, size int, fp long, sketch binary, bands binary"), "sketches")
    every = base.groupBy("content", "size", "fp", "sketch", "bands").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    every, named_texts = materialize(every, "texts"), materialize(base.select("doc_id", "content"), "contents")
    drop(base)
    nodes = every.filter("rep is not null")
    keys = nodes.filter("size > 0").select("content", "bands").mapInArrow(_keys, "key long, content long")
    shared = materialize(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, content long"), "shared")
    members = nodes.join(shared.select("content").distinct(), "content", "left_semi").select("content", "size", "sketch", "bands", "rep")
    members = materialize(members, "members")
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = source.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(_sets, "content long, shingles binary")
    sets = materialize(sets.groupBy("content").agg(F.first("shingles").alias("shingles")), "shingles")
    buckets = materialize(shared.join(members.select("content", "rep"), "content"), "buckets")
    drop(shared)
    names = nodes.select("content", "rep")

    def verified(pairs: DataFrame) -> DataFrame:
        with_sets = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
        return materialize(with_sets.mapInArrow(_similar, "a long, b long"), "similar")

    def components(found: DataFrame) -> DataFrame:
        edges = found.join(names.toDF("a", "rep_a"), "a").join(names.toDF("b", "rep_b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
        return materialize(connected_components(edges), "components")

    def by_key(rows: DataFrame) -> DataFrame:
        rows = rows.join(members.select("content", "size", "sketch"), "content").select("key", "content", "size", "sketch", *rows.columns[2:])
        return rows.repartition("key").sortWithinPartitions("key", "content")

    tried = materialize(golay_pairs(nodes), "proposed")
    proposed = materialize(by_key(buckets.select("key", "content")).mapInArrow(_proposed, "a long, b long").distinct(), "proposed")
    found = verified(tried).union(verified(proposed.join(tried, ["a", "b"], "left_anti")))
    comps = components(found)
    rows = buckets.join(comps, buckets.rep == comps.node, "left").select("key", "content", F.coalesce("component", "rep").alias("component"))
    split = rows.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("key")
    rows = rows.join(few(materialize(split, "split")), "key", "left_semi")  # sketches go to buckets of several components only
    rest = materialize(by_key(rows).mapInArrow(_apart, "key long, content long, size int, component long"), "apart")
    found = found.union(materialize(_blocks(rest, members, sets).mapInArrow(_linked, "a long, b long"), "similar"))
    comps = components(found)
    named = every.join(comps, every.rep == comps.node, "left").select("content", F.coalesce("component", "rep").alias("component_id"), "copies")
    return join_hot(named_texts, materialize(named, "named"), ["content"]).select("doc_id", "component_id")


def select_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those of a group that aren't its smallest doc_id, with all their columns.

    Rows of one doc_id are one document: they stay or go together. Rows with a null id stay.
    """
    gone = near_duplicates(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(f"gone_{id_col}_of_group")).distinct()
    gone = few(materialize(gone, "gone"))  # texts are shuffled only if the ids are too many to broadcast
    return docs.join(gone, docs[id_col] == gone[f"gone_{id_col}_of_group"], "left_anti")
