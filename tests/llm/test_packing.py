import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from tiersum.llm import bpe, packing


def check_plan(histogram, capacity):
    """Every token of every remainder in one piece, windows gapless and, but for the last, full."""
    plan = packing.plan_windows(histogram, capacity)
    filled, covered = defaultdict(list), defaultdict(list)
    for length, start, lo, hi, piece, sequence, first, per, offset in plan.tolist():
        for rank in range(lo, hi):
            j = first + rank - lo
            filled[sequence + j // per].append((offset + j % per * piece, piece))
            covered[length, rank].append((start, piece))
    assert set(covered) == {(r, i) for r, c in histogram.items() for i in range(c)}
    for (length, _), pieces in covered.items():
        at = 0
        for start, piece in sorted(pieces):
            assert start == at
            at += piece
        assert at == length
    short = 0
    for pieces in filled.values():
        at = 0
        for offset, piece in sorted(pieces):
            assert offset == at
            at += piece
        assert at <= capacity
        short += at < capacity
    assert short <= 1
    return plan


def brute_best(stock, target):
    sums = {0}
    for length, many in stock.items():
        sums = {s + length * k for s in sums for k in range(many + 1) if s + length * k <= target}
    return max(sums)


@pytest.mark.parametrize("seed", range(30))
def test_fill_is_nearest_from_below(seed):
    rng = random.Random(seed)
    stock = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(rng.randint(1, 7))}
    target = rng.randint(1, 90)
    used = packing.fill(stock, sorted(stock, reverse=True), target)
    assert all(used[r] <= stock[r] for r in used)
    assert sum(r * k for r, k in used.items()) == brute_best(stock, target)


def test_plans():
    rng = random.Random(1)
    check_plan({}, 64)
    check_plan({40: 50}, 64)  # no two fit, all but one window need cuts
    check_plan({63: 7, 62: 3}, 64)
    check_plan({1: 1000}, 64)
    for _ in range(20):
        check_plan({rng.randint(1, 63): rng.randint(1, 9) for _ in range(rng.randint(1, 30))}, 64)


SCHEMA = "doc_id long, text string, start string, n int"


def test_pieces_against_the_library(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "one", "the " * 9000, "cat dog " * 4000]
    texts += [" ".join(rng.choice(["alpha", "beta", "x", "lorem!"]) for _ in range(rng.randint(1, 3000))) for _ in range(40)]
    texts += ["same words again " * 700] * 25
    rows = [(i, t, "clash", 0) for i, t in enumerate(texts)] + [(3, "one", "", 1), (None, "nil", "", 2)]
    got = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    library, want = Tokenizer.from_file(bpe.default_vocabulary()), defaultdict(list)
    for i, t, *_ in rows:
        want[i].append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for i, texts_ids in want.items():
        if len(texts_ids) > 1:
            assert len(pieces[i]) == 2
            continue
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            ids = texts_ids[0][at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(texts_ids[0]), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
            at += r.length
        assert at == len(texts_ids[0])
    lengths = Counter()
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        lengths[at] += 1
    assert sum(c for n, c in lengths.items() if n != 4096) <= 1 and max(lengths) == 4096
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
