import hashlib
import itertools
import math
import random
import re

import pytest

from tiersum.llm import secret_scan
from tiersum.llm.bpe import default_vocabulary

SCHEMA = "doc_id long, text string, spans string, kind string, n_hex string"
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@pytest.fixture(scope="module")
def cost():
    return secret_scan.GuessCost(secret_scan.vocabulary_ranks(default_vocabulary()))


def brute_base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32])


def brute_cost(cost, value):
    """Over every segmentation."""
    ahead, best = list(cost.ahead(value)), math.inf
    n = len(value)
    for cuts in itertools.product((0, 1), repeat=n - 1):
        bounds = [0, *(i for i, c in enumerate(cuts, 1) if c), n]
        total = 0.0
        for a, b in zip(bounds, bounds[1:]):
            options = [c for j, _, c in ahead[a] if j == b] + [sum(map(secret_scan.character_cost, value[a:b]))]
            total += secret_scan.OPEN + min(options)
        best = min(best, total)
    return best


def test_cheapest_segmentation_equals_enumeration(cost):
    rng = random.Random(2)
    pieces = ["the", "Day", "p4ss", "1234", "qwert", "aaaa", "abab", "1999", "12.03.87", "x", "#", "Ω", "7"]
    for _ in range(60):
        value = "".join(rng.choice(pieces) for _ in range(4))[:12]
        total, segments = cost.segments(value)
        assert total == pytest.approx(brute_cost(cost, value))
        assert "".join(value[a:b] for a, b, _ in segments) == value


@pytest.mark.parametrize("value, kind", [("sunday", "word"), ("Sund4y", "word"), ("17.03.1984", "date"), ("20240131", "date"), ("zzzzzzzzz", "repeat"), ("x9x9x9x9x9", "repeat"), ("qwertyuiop", "walk"), ("zaqwsx", "walk"), ("abcdefghij", "walk"), ("v#8Kq!2z", "force")])
def test_kinds_of_segments(cost, value, kind):
    assert [k for *_, k in cost.segments(value)[1]] == [kind]


def test_costs_in_order(cost):
    assert cost("") == 0
    easy, hard = ["password", "monday2024", "qwertyuiop12345", "aaaaaaaaaaaaaaaaaaaa"], ["v#8Kq!2zTx", "9fQ2xL7vRb1", "correct-horse-battery-staple"]
    assert max(map(cost, easy)) < secret_scan.MIN_LOG10_GUESSES < min(map(cost, hard))
    assert cost("k7#vQ" * 2_000) < cost("".join(random.Random(1).choices("abcdef0123456789", k=2_000)))


TEXTS = [
    'api_key = "abcd1234-XY" and PassWord:hunter2x\x20\x20 token=short, then secret : aaaaaaaa',
    "AKIAABCDEFGHIJKL AKIA123 xAKIAAKIAAKIAAKIA9 é😀 AKIA" + "Z" * 40,
    "0123456789abcdef0123456789abcdef 0123456789abcdef 0123456789abcdeff123456789abcdefg token: 0123456789abcdef0123456789abcdef",
    "password: token: abcdefgh token = secret=abcdefgh",
    "the password is v#8Kq!2zTx. the password is something else; pwd => Tr#ub4dor&3x, bearer: monday",
    "auth: (x9#LQ!m2$Wz) pin: 1234 passphrase := 'v#8Kq!2zTx'",
    "token = " + "x" * 100_000 + " end",
    "password" + " " * 50_000 + "x",
    "paſſword=abcdefgh1 toKen=abcdefgh1",
]


def test_base_spans_equal_brute_force(cost):
    rng = random.Random(3)
    parts = ["password", "token", "AKIA", "=", ":", " ", '"', "abcdef0123456789" * 2, "Api_Key", "x7", "\n", "é"]
    for text in TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]:
        got = secret_scan.scan(text, cost)
        assert [(s, secret_scan.KINDS.index(k), e) for k, s, e, _ in got if k != "guess"] == brute_base(text)
        assert got == sorted(got, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))


def test_guesses(cost):
    found = lambda t: [t[s:e] for k, s, e, _ in secret_scan.scan(t, cost) if k == "guess"]
    assert found(TEXTS[4]) == ["v#8Kq!2zTx", "Tr#ub4dor&3x"]
    assert found(TEXTS[5]) == ["(x9#LQ!m2$Wz", "v#8Kq!2zTx"]
    assert found("the secret is something, the token was returned; a pin is needed") == []
    assert found("password = abcdXY12zq7") == []  # a base span already
    assert found("password = abcdXY12!zq7") == ["abcdXY12!zq7"]  # of which the base has a part only


def test_query(spark, cost):
    rows = [(i, t, "x", "x", "x") for i, t in enumerate(TEXTS)] + [(50, None, "x", "x", "x"), (51, "", "x", "x", "x"), (None, TEXTS[0], "x", "x", "x"), (0, TEXTS[0], "x", "x", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = secret_scan.scan_documents(docs)
    got = {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256): r for r in secret_scan.digest_spans(found).collect()}
    for i, text, *_ in rows:
        base = brute_base(text)
        told = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        n = [sum(k == j for _, k, _ in base) for j in range(3)]
        row = got[(i, *n, hashlib.sha256(told.encode()).hexdigest())]
        assert row.spans == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in secret_scan.scan(text or "", cost))
    assert secret_scan.digest_spans(found).count() == len(rows)
    assert secret_scan.scan_documents(docs.limit(0)).count() == 0


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é token=abcdefgh and AKIAABCDEFGHIJKL!", "", "", ""), (2, "nothing", "", "", ""), (3, "secret=" + "ab12" * 9, "", "", "")], SCHEMA)
    found = secret_scan.scan_documents(docs).join(docs.select("doc_id", "text"), "doc_id")
    got = {r[0]: r[1] for r in found.select("doc_id", secret_scan.redacted(found["text"], found["spans"])).collect()}
    assert got == {1: "é [SECRET] and [SECRET]!", 2: "nothing", 3: "[SECRET]"}
