import numpy as np
import pytest

from tests.llm.test_simhash import brute_links
from tiersum.llm import shingles

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(ids, texts):
    sets = [brute_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return brute_links(ids, [ids[i] for i, _ in pairs], [ids[j] for _, j in pairs]), pairs


def changed(rng, words, n):
    out = words.copy()
    out[rng.choice(len(words), n, replace=False)] = rng.integers(10_000, 20_000, n)
    return out


def test_stage_matches_brute_force_jaccard(spark):
    rng = np.random.default_rng(4)
    rows = []
    for n in (30, 60, 100, 100, 150, 300, 300, 800):  # originals, one to several words changed
        base = rng.integers(0, 10_000, n)
        rows += [base, *(changed(rng, base, k) for k in (1, 1, 2, 4, 8))]
    hub = rng.integers(0, 10_000, 150)  # one large group, bound to its middle and to one another
    for _ in range(350):
        rows.append(changed(rng, hub, int(rng.integers(0, 7))))
    texts = [" ".join(map(str, w)) for w in rows] + ["", None, " \n", "One two", "one TWO", "one two three"]
    ids = [3 * i + 1 for i in range(len(texts))]
    want, pairs = brute_groups(ids, texts)
    docs = spark.createDataFrame([(i, t, "en") for i, t in zip(ids, texts)], SCHEMA)
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    assert len(pairs) > 1000 and got == want
    kept = pipeline.keep_one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in ids if want[i] == i)


def test_texts_apart_from_the_main_component():
    sketch = np.zeros((40, shingles.MINIMA), np.uint8)
    sketch[38, :100] = 1  # alone
    sketch[39, :30] = 1
    size, component = np.full(40, 100), np.array([0] * 38 + [1, 2])
    assert np.nonzero(shingles.apart(sketch, size, component))[0].tolist() == [*range(38), 39]


def test_buckets_alone_find_all_links():
    rng = np.random.default_rng(11)
    bases = [rng.integers(0, 10_000, n) for n in (60, 200)]
    texts = [" ".join(map(str, changed(rng, bases[i % 2], int(k)))) for i, k in enumerate(rng.integers(0, 8, 120))]
    want, pairs = brute_groups(list(range(120)), texts)
    sets = [shingles.shingle_set(t)[1] for t in texts]
    least = [shingles.minima(s) for s in sets]
    sketch, bands = np.array([x.astype(np.uint8) for x in least]), np.array([shingles.band_keys(x) for x in least]).view(np.int64)
    a, b = [], []
    for band in range(shingles.BANDS):
        for key in np.unique(bands[:, band]):
            members = np.nonzero(bands[:, band] == key)[0]
            outside = members[1:]  # each text is a component, the first one is the main one
            at, m = np.concatenate((members, outside)), len(members)
            aside = at != members[0]
            for i, j in shingles.links_apart(np.full(len(at), key), at, at, aside, m, sketch[at], bands[at], [sets[k] for k in at]):
                a.append(int(at[i]))
                b.append(int(at[j]))
    assert len(pairs) > 300 and brute_links(list(range(120)), a, b) == want


def test_small_blocks_find_the_same_links(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 10_000, 120)
    texts = [" ".join(map(str, changed(rng, base, int(k)))) for k in rng.integers(0, 9, 160)]
    want, _ = brute_groups(list(range(160)), texts)
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 4096)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()} == want


def test_empty_table_and_null_ids(spark):
    assert shingles.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d", ""), (4, "a b c d", ""), (None, "alone", "")]
    got = shingles.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3
    assert {(r.doc_id, r.component_id) for r in got} == {(None, 4), (4, 4), (None, None)}
