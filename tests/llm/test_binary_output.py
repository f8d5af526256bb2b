import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tiersum.llm import binary_output, bpe


def plain_best_fit(lengths, width):
    rows = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fitting = [r for r in rows if r[0] >= lengths[i]]
        if fitting:
            row = min(fitting, key=lambda r: r[0])
        else:
            rows.append(row := [width, []])
        row[0] -= lengths[i]
        row[1].append(i)
    return rows


@pytest.mark.parametrize("seed", range(20))
def test_same_rooms_as_a_plain_search(seed):
    rng = random.Random(seed)
    width = rng.choice([7, 8, 64, 100])
    lengths = [rng.randint(1, width) for _ in range(rng.randint(0, 200))]
    rows = binary_output.best_fit_decreasing(lengths, width)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert sorted(width - sum(lengths[i] for i in r) for r in rows) == sorted(r[0] for r in plain_best_fit(lengths, width))


SCHEMA = "doc_id long, text string, ids string, n_tokens int"


def test_round_trip(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "the " * 7000, *(" ".join(rng.choice(["red", "green", "blue-ish"]) for _ in range(rng.randint(1, 900))) for _ in range(60))]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stored = binary_output.write_ids(docs, block_tokens=6000)
    got = stored.collect()
    library, found = Tokenizer.from_file(bpe.default_vocabulary()), {}
    for r in got:
        ids = np.frombuffer(r.ids, f"<u{r.id_bytes}")
        assert len(ids) == binary_output.WIDTH and (ids[r.n_tokens :] == 0).all()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for doc, start, a, b in zip(r.doc_ids, r.piece_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert b > a
            found.setdefault(doc, []).append((start, ids[a:b].tolist()))
    assert len({r.row_id for r in got}) == len(got)
    for i, t, *_ in rows:
        assert sum((ids for _, ids in sorted(found.pop(i))), []) == [*library.encode(t or "", add_special_tokens=False).ids, 2]
    assert not found
    digests = {r.row_id: r.ids_crc32 for r in binary_output.digest_rows(stored).collect()}
    assert digests == {r.row_id: zlib.crc32(r.ids) for r in got}


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(None, "x", "", 1), (1, "y", "", 1), (1, "y", "", 1)], SCHEMA).coalesce(1)
    (row,) = binary_output.pack_ids(docs).collect()
    assert sorted(row.doc_ids, key=str) == [1, 1, None]
    assert binary_output.pack_ids(docs.limit(0)).count() == 0
