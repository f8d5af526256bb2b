import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tiersum.llm import periodic_runs

SCHEMA = "doc_id long, text string, runs string, words string, n string, h string"


def brute_runs(w, ratio=4, least=6):
    n, out = len(w), []
    for q in range(1, n // ratio + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, ratio * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = best[1] * 1000 // best[2] if runs else None
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), sha(b" ".join(kept)))


@pytest.mark.parametrize("ratio", [2, 3, 4])
def test_runs_equal_brute_force(ratio):
    rng = random.Random(ratio)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(0, 7)):
            n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
            w = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(2, 11)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        got = periodic_runs.find_runs([np.array(w, np.int64) for w in texts], ratio)
        assert got == [brute_runs(w, ratio) for w in texts]


def test_long_texts():
    period = np.random.default_rng(3).permutation(500)
    text = np.concatenate((np.arange(500, 700), np.tile(period, 7), period[:123]))
    assert periodic_runs.find_runs([text, np.zeros(3_000, np.int64)]) == [[(200, 3_623, 500)], [(0, 3_000, 1)]]
    with pytest.raises(ValueError):
        periodic_runs.find_runs([text], ratio=1)


def test_query_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", 500)
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(rng.choice([2, 30]))}" for _ in range(rng.randint(0, 120))), "", "", "", "") for i in range(300)]
    rows += [(900, None, "", "", "", ""), (None, "a " * 9, "", "", "", ""), (901, "", "", "", "", ""), (902, " \t\n\x0b ", "", "", "", ""), (903, "x\x1cy z " * 5, "", "", "", ""), rows[7], (-5, "é " * 40, "", "", "", ""), (904, "word " * 2_000 + "b" * 100_000, "", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = periodic_runs.digest_runs(periodic_runs.collapse_runs(periodic_runs.with_tails(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = [brute_row(r[0], r[1]) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(r[1] for r in want) > 20
    assert periodic_runs.digest_runs(periodic_runs.collapse_runs(periodic_runs.with_tails(docs.limit(0)))).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so  it is no no no no no no no\tmore", "", "", "", "")], SCHEMA)
    row = periodic_runs.collapse_runs(docs).first()
    assert row.collapsed == "so it is no more" and [tuple(r) for r in row.runs] == [(3, 7, 1)] and row.n_words == 11
