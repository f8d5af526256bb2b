import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tiersum.llm import common
from tiersum.llm.bpe import default_vocabulary
from tiersum.llm.token_ids import IdEncoder

LIBRARY = Tokenizer.from_file(default_vocabulary())
OWN = IdEncoder(default_vocabulary(), cache_size=300)


def same(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return OWN.encode(text) == struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert same(text)


def test_words_with_ends_specials_and_controls():
    rng = random.Random(1)
    words = ["The", "end.", "End,", "it's", "Ärger!", "x\x01y", "\x01", "a\x1cb", "<|endoftext|>", "naïve;", "99", "...", "é", "ΑΣ"]
    assert same(None) and same("") and same("  \n")
    for _ in range(800):
        assert same(" ".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 500))]) for _ in range(rng.randint(1, 25))))


def test_a_worker_forgets_what_earlier_tasks_left():
    common._PER_WORKER.clear()
    first = common.per_worker(("a", 1), dict)
    assert common.per_worker(("a", 1), dict) is first
    common._PER_WORKER["b"] = [("b", 1), {}, 7]  # left by task 7
    common.forget()
    assert set(common._PER_WORKER) == {"a"}  # of the caller's own task
    common._PER_WORKER["b"] = [("b", 1), {}, 7]
    assert common.per_worker(("a", 2), dict) is not first and set(common._PER_WORKER) == {"a"}
