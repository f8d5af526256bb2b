import numpy as np
import xxhash

from tiersum.llm import common, simhash
from tiersum.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, key long"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    comp = {i: i for i in ids}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = top(i), top(j)
                comp[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_golay_is_perfect_and_neighbours_share_an_index():
    words = np.arange(1 << 23)
    data = simhash.golay_decode(words)
    assert (np.bincount(data) == 2048).all()
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 22, 500)
    b = a ^ (1 << rng.integers(0, 22, 500)) ^ (1 << rng.integers(0, 22, 500))
    keys = [dict.fromkeys(range(500)) for _ in range(2)]
    for got, w in zip(keys, (a, b)):
        row, index = simhash.golay_indices(w, 22)
        for r, i in zip(row.tolist(), index.tolist()):
            got[r] = (got[r] or set()) | {i}
    assert all(keys[0][r] & keys[1][r] for r in range(500))
    assert {len(x) for x in keys[0].values()} <= {1, 2, 3, 4, 5, 6}


def test_large_groups_give_the_same_links():
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 60) ^ (1 << rng.integers(0, 30, (400, 6))).sum(axis=1))
    a, b = simhash._by_midpoints(fp.view(np.uint64), fp)
    want = brute_components(fp.tolist(), fp.tolist())
    got = brute_links(fp.tolist(), a.tolist(), b.tolist())
    assert got == want


def brute_links(ids, a, b):
    comp = {i: i for i in ids}

    def top(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for x, y in zip(a, b):
        x, y = top(x), top(y)
        comp[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    base = "the quick brown fox jumps over a lazy dog and then rests below the old oak tree near a river"
    texts = [base, base.upper(), base + " today", None, "", " \t\n", "one", "one two", base, "ü Ü ß", "x " * 5000]
    rng = np.random.default_rng(3)
    long = rng.integers(0, 5000, 600)
    for _ in range(60):  # near copies
        words = long.copy()
        words[rng.integers(0, 600, 2)] = rng.integers(0, 5000, 2)
        texts.append(" ".join(map(str, words)))
    rows = [(i * 3 + 1, t, "clash", 7) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows + rows[:2], SCHEMA)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    ids = [r[0] for r in rows]
    assert [got[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert {i: got[i].component_id for i in ids} == brute_components(ids, fps)


def test_empty_table_and_null_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d", "", 1), (4, "a b c d", "", 1), (None, "alone", "", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 4), (4, 4), (None, None)}


def test_components_of_chains_stars_and_repeats(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 6), (7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def test_hot_keys_and_hot_fingerprints_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 20)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common.join_hot, "__defaults__", ("copies", 5))
    rng = np.random.default_rng(8)
    center = int(rng.integers(0, 1 << 62))
    fps = {center ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))} | set(rng.integers(0, 1 << 62, 200).tolist())
    fps = sorted(fps)
    nodes = common.materialize(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long"), "nodes")
    links = [(r.a, r.b) for r in simhash.links(nodes).collect()]
    want = brute_components(list(range(len(fps))), fps)
    assert brute_links(list(range(len(fps))), *zip(*links)) == want
    rows = [(i, ["same words here now", "", None, f"own text number {i} of many"][min(3, i % 7)], "", 0) for i in range(90)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [brute_fingerprint(r[1]) for r in rows]
    assert {i: r.component_id for i, r in got.items()} == brute_components([r[0] for r in rows], prints)
