import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np

from tiersum.llm import hmm

SCHEMA = "doc_id long, text string, score string, held_out string"


def corpus(n=150, seed=6):
    rng = random.Random(seed)
    topics = ["red blue green black white grey".split(), "uno dos tres cuatro cinco seis".split()]
    out = []
    for i in range(n):
        words = [rng.choice(topics[i % 2]) if rng.random() < 0.9 else f"name{rng.randint(0, 60)}" for _ in range(rng.randint(1, 700))]
        out.append((i, " ".join(words), "clash", "clash"))
    return out


def tiny(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    draw = lambda *s: (x := rng.random(s) + 0.05) / x.sum(axis=-1, keepdims=True)
    return hmm.HiddenMarkov({b"a": 0, b"b": 1}, np.array([3, 2, 1]), draw(states), draw(states), draw(states, states), draw(states, symbols).T)


def test_likelihood_is_the_sum_over_all_paths():
    m = tiny()
    docs = [np.array(x, np.int32) for x in ([0], [1, 2], [3, 0, 1, 4, 2])]
    for got, s in zip(m.log10_likelihood(docs), docs):
        total = 0.0
        for path in product(range(3), repeat=len(s)):
            p = m.start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
        assert abs(got - math.log10(total)) < 1e-9


def test_chunked_product_equals_the_plain_recursion():
    m, rng = tiny(), np.random.default_rng(3)
    docs = [rng.integers(0, 5, n).astype(np.int32) for n in (1, 255, 256, 257, 2000)]
    for got, s in zip(m.log10_likelihood(docs), docs):
        belief, want = m.start, 0.0
        for x in s:
            w = belief * m.emit[x]
            want += math.log10(w.sum())
            belief = w / w.sum() @ m.move
        assert abs(got - want) < 1e-7


def test_expected_counts_against_enumeration():
    m, s = tiny(), np.array([3, 0, 1, 4], np.int32)
    for first, start in ((True, m.start), (False, m.onward)):
        emissions, moves, total = np.zeros((5, 3)), np.zeros((3, 3)), 0.0
        for path in product(range(3), repeat=4):
            p = start[path[0]] * m.emit[s[0], path[0]]
            for t in range(1, 4):
                p *= m.move[path[t - 1], path[t]] * m.emit[s[t], path[t]]
            total += p
            for t in range(4):
                emissions[s[t], path[t]] += p
                if t:
                    moves[path[t - 1], path[t]] += p
        got = m.expected_counts([(s, 0, 4, first), (s[:1], 0, 1, first)])
        alone = m.expected_counts([(s[:1], 0, 1, first)])
        np.testing.assert_allclose(got[0] - alone[0], emissions / total, rtol=1e-4, atol=1e-5)
        np.testing.assert_allclose(got[1], moves / total, rtol=1e-4)
        assert abs(got[2].sum() - 2 * first) < 1e-5
        assert abs(got[3] - alone[3] - math.log10(total)) < 1e-5


def test_cuts_lose_no_token_and_no_move(monkeypatch):
    """Chunks with as much context as there is give the counts of the whole document; a little context nearly does."""
    m, rng = tiny(), np.random.default_rng(9)
    s = rng.integers(0, 5, 1000).astype(np.int32)
    whole = m.expected_counts([(s, 0, len(s), True)])
    for context, tolerance in ((1000, 1e-4), (hmm.CONTEXT, 1e-3), (0, None)):
        monkeypatch.setattr(hmm, "CONTEXT", context)
        got = m.expected_counts(hmm.segments_of(s))
        assert abs(got[0].sum() - 1000) < 0.1
        assert tolerance is None or abs(got[1].sum() - 999) < 0.1
        for a, b in zip(got[:3], whole[:3]):
            assert tolerance is None or np.abs(a - b).max() < tolerance * 1000
    assert abs(m.log10_likelihood([s])[0] - whole[3]) < 0.01


def check_contract(rows, got):
    train = [hmm.words_of(t) for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for d in train for w in d)
    counts["end"] = len(train)
    n, v = sum(counts.values()), sum(c > 0 for c in counts.values())
    for i, t, *_ in rows:
        tokens = [*hmm.words_of(t), "end"]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 7 == 2)


def test_contract_and_better_than_the_base(spark):
    rows = corpus() + [(900, None, "", ""), (901, "", "", ""), (902, " \t\n", "", ""), (903, "Unseen WORDS Äh", "", ""), (904, "red " * 20000, "", ""), (None, "red blue", "", "")]
    docs = spark.createDataFrame(rows + rows[:1], SCHEMA)
    got = hmm.score_documents(docs, states=4, core=20).collect()
    assert len(got) == len(rows) + 1
    by = {r.doc_id: r for r in got}
    rows_twice = rows + rows[:1]
    check_contract_rows = {i: t for i, t, *_ in rows}
    train_rows = [(i, t) for i, t, *_ in rows_twice]
    assert len(check_contract_rows) == len(rows)
    counted = [(i, t, "", "") for i, t in train_rows]
    check_contract(counted, by)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.score for r in held) > 0.8 * sum(r.base_score for r in held)


def test_probabilities_add_up(spark):
    """Over all one-word texts: the known words and one unknown word of each class."""
    docs = spark.createDataFrame(corpus(40), SCHEMA)
    c = hmm.count_corpus(docs, core=10)
    m = hmm.train(docs, c, states=2)
    np.testing.assert_allclose(m.emit.sum(axis=0), 1)
    np.testing.assert_allclose(m.move.sum(axis=1), 1)
    known = {r.word: r.c for r in c.words.collect()}
    core = {w.decode() for w, _ in c.core}
    for k in range(hmm.CLASSES):
        own = [n for w, n in known.items() if w not in core and hmm.word_class(w.encode()) == k]
        assert (sum(own), len(own)) == (c.class_tokens[k], c.class_types[k])


def test_likelihood_grows_until_it_settles(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    c, log = hmm.count_corpus(docs, core=20), []
    hmm.train(docs, c, states=4, full_rounds=12, log=log)
    full = log[len(hmm.FIRST_ROUNDS) :]
    assert all(b > a - 1e-4 for a, b in zip(full, full[1:])) and full[-1] > log[0]
    assert len(full) < 12 and full[-1] - full[-2] < hmm.SETTLED


def test_nothing_to_learn(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held, "some words", "", "")], SCHEMA)
    (r,) = hmm.score_documents(docs).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score <= 0
    assert hmm.score_documents(docs.limit(0)).count() == 0


def test_words_outside_the_core_come_with_their_classes():
    core = {b"the": 0, b"river": 1}
    even = np.full(2, 0.5)
    model = hmm.HiddenMarkov(core, np.ones(3), even, even, np.full((2, 2), 0.5), np.ones((3 + hmm.CLASSES, 2)))
    words = [b"far", b"the", b"gr\xc3\xbcn", b"far", b"x" * 90, b"river", b"far"]
    rare, classes = model.rare(words, model.symbols(words))
    assert list(rare.items()) == [(b"far", 3), (b"gr\xc3\xbcn", 1), (b"x" * 90, 1)] and classes == [hmm.word_class(w) for w in rare]
    assert model.rare([], model.symbols([])) == ({}, [])
