import math

import numpy as np
import pyarrow as pa

from tiersum.llm import common, embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, component_id string, rep int"


def brute(rows):
    """Links, counts and components by comparing every pair."""
    unit = {}
    for k, (i, x, label, *_) in enumerate(rows):
        if i is not None and label is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x):
            v = np.array(x, np.float32).astype(float)
            unit[k] = v / np.linalg.norm(v)
    links = [(a, b) for a in unit for b in unit if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98]
    comp = {k: k for k in range(len(rows))}

    def top(k):
        while comp[k] != k:
            k = comp[k]
        return k

    for a, b in links:
        a, b = sorted((top(a), top(b)), key=lambda k: (rows[k][0], k))
        comp[b] = a
    counts = np.zeros(len(rows), int)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    return counts, [rows[top(k)][0] for k in range(len(rows))], len(links)


def planted(n=700, dim=32, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=dim)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.choice([1, 1, 1, 2, 5, 40]))):
            noise = rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.08, 0.1])
            rows.append((len(rows) * 3, (base + noise).astype(np.float32).tolist(), label, "clash", 1))
    return rows


def test_recall_and_no_wrong_links(spark):
    rows = planted()
    counts, components, total = brute(rows)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    mine = np.array([got[r[0]].n_links for r in rows])
    assert (mine <= counts).all() and mine.sum() / 2 >= 0.98 * total
    assert np.mean([got[r[0]].component_id == c for r, c in zip(rows, components)]) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_large_group_is_cut_into_blocks_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.001).astype(np.float32).tolist(), 1, "", 0) for i in range(150)]
    rows += [(200 + i, rows[0][1], 1, "", 0) for i in range(40)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(189, 0)}


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, "", 0), (2, [2.0, 0.0], 1, "", 0), (3, [1.0, 0.0], 2, "", 0), (4, [1.0, 0.0], None, "", 0), (5, [1.0, 0.0], None, "", 0),
        (6, None, 1, "", 0), (7, [], 1, "", 0), (8, [0.0, 0.0], 1, "", 0), (9, [0.0, 0.0], 1, "", 0), (10, [nan, 1.0], 1, "", 0), (11, [inf, 1.0], 1, "", 0),
        (12, [None, 1.0], 1, "", 0), (13, [1.0, 0.0, 0.0], 1, "", 0), (None, [1.0, 0.0], 1, "", 0), (2, [2.0, 0.0], 1, "", 0), (15, [1e30, 1e20], 1, "", 0), (16, [1e-30, 0.0], 1, "", 0),
    ]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    linked = sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.n_links)
    assert linked == [(1, 4, 1), (2, 4, 1), (2, 4, 1), (15, 4, 1), (16, 4, 1)]
    assert all(r.kept and r.component_id == r.vec_id for r in got if not r.n_links)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def exact_links(x, label, threshold=0.98):
    """Link counts by brute force, one label at a time."""
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    count = np.zeros(len(x), np.int64)
    for c in np.unique(label):
        at = np.nonzero(label == c)[0]
        for lo in range(0, len(at), 2000):
            part = at[lo : lo + 2000]
            count[part] = (unit[part] @ unit[at].T >= threshold).sum(axis=1) - 1
    return count


def crowded(n, dim=64, seed=3):
    """A third of the vectors in one crowd, a third in small groups, the rest alone; all else equal to the supplied table's form."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    third = n // 3
    x[:third] = rng.normal(size=dim) + 0.09 * rng.normal(size=(third, dim))
    group = rng.integers(0, third // 3, third)
    x[third : 2 * third] = rng.normal(size=(third // 3, dim))[group] + rng.choice([0.02, 0.08, 0.1], (third, 1)) * rng.normal(size=(third, dim))
    return x.astype(np.float32), rng.integers(0, 3, n)


def test_recall_on_crowded_vectors(spark):
    x, label = crowded(6000)
    want = exact_links(x, label)
    docs = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": label.astype(str)}))
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(docs).collect()}
    mine = np.array([got[i] for i in range(len(x))])
    assert (mine <= want).all() and want.sum() > 500_000
    for part in (slice(0, 2000), slice(2000, 6000)):
        assert mine[part].sum() >= 0.98 * want[part].sum()


def test_hot_sets_and_long_lists_give_the_same_links(spark, monkeypatch):
    x, label = crowded(900, 24)
    docs = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": label}))
    want = sorted(embedding_dedup.near_duplicates(docs).collect())
    monkeypatch.setattr(embedding_dedup, "LONG_LIST", 3)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "TILE", 16)
    monkeypatch.setattr(common.join_hot, "__defaults__", ("copies", 4))
    assert sorted(embedding_dedup.near_duplicates(docs).collect()) == want
