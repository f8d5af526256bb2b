import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tiersum.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.default_vocabulary())
OWN = bpe.Encoder(bpe.default_vocabulary())
TEXTS = [None, "", " \n", "Hello, World's best!!", "tttt aaaa ééttttßdñ", "a<|endoftext|>B <|startoftext|>", "x\x1cy\x85z\x01\x7f", "ΑΣ Σ İı ﬁ Å Å", "中文字 😀😀 ١٢٣ a1b22", "the" * 4000, "the cat " * 20000]


def expected(text):
    got = LIBRARY.encode(text or "", add_special_tokens=False)
    return got.ids, LIBRARY.decode(got.ids, skip_special_tokens=False)


def unpack(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_decoding_as_the_library(text):
    ids = OWN.encode(text)
    assert (unpack(ids), OWN.decode(ids).decode()) == expected(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=40))
def test_any_text(text):
    assert unpack(OWN.encode(text)) == expected(text)[0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x52F, blacklist_categories=("Cs",)), max_size=40))
def test_any_alphabetic_text(text):
    assert unpack(OWN.encode(text)) == expected(text)[0]


def test_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x40000 or c % 97 == 0 or 0xE0000 <= c < 0xE0200)]
    for lo in range(0, len(points), 2000):
        texts = [f"{chr(c)} a{chr(c)}B1{chr(c)}" for c in points[lo : lo + 2000]]
        want = LIBRARY.encode_batch(texts, add_special_tokens=False)
        wrong = [t for t, w in zip(texts, want) if OWN.encode(t) != struct.pack(f"<{len(w.ids)}I", *w.ids)]
        assert not wrong, wrong[:5]


def test_repeated_letters_and_joined_words():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aetthinos's") for _ in range(rng.randint(1, 30)))
        assert unpack(OWN.encode(text)) == expected(text)[0]


def test_automaton_accepts_only_its_own_path():
    ids = unpack(OWN.encode("international")) or []
    assert OWN.automaton.read(ids)
    small = bpe.MergeAutomaton.compile(5, [(0, 1, 3), (3, 2, 4)])  # a b c, ab, abc
    assert small.read([4, 0]) and small.read([3, 0]) and small.read([1, 2])
    assert not small.read([0, 1]) and not small.read([3, 2]) and not small.read([0, 1, 2])


def test_query_columns(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y", 2), (None, "a", "", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    got = bpe.digest_documents(docs).collect()
    assert len(got) == len(rows)
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        ids, decoded = expected(t)
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0)).count() == 0
    assert bpe.encode_documents(docs.filter("doc_id = 3")).first().decoded == expected(TEXTS[3])[1]
