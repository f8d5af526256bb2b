"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that BPE produces. It is built from the automaton
of all symbol strings (one state) by one gadget for each merge (a, b) in order of rank: all arcs labelled `a` enter one state q;
they are led to a copy q' of q without its arc `b`, and every state with an arc `a` gets an arc `ab` to the state
that q's arc `b` enters. All arcs with one label thus enter one state, so that a state is named by the label read last.
Copies are kept as differences (parent, removed label, time), and an arc is resolved once and kept in a transition
table. For encoding, the automaton is made deterministic over letters: one transition for each letter of a word, then one
for its end, give the only accepted path that spells it. Ids are decoded by emitting the labels of their arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.llm.common import WordCache, per_worker

#: Transitions kept, of letters and of arcs.
TABLE_SIZE = 400_000
#: The split pattern of the vocabulary file's pre-tokenizer, and Unicode white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """One printable character for each byte: itself where printable, else the next unused one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, spare = [""] * 256, 256
    for b in range(256):
        letters[b] = chr(b) if b in own else chr(spare)
        spare += b not in own
    return letters


@dataclass
class MergeAutomaton:
    """left, right, born: by token, -1 where it is a symbol. entered: by token, the state its arcs enter.
    parent, removed, since: by state; state 0 is the automaton of all symbol strings."""

    left: list[int]
    right: list[int]
    born: list[int]
    entered: list[int]
    parent: list[int]
    removed: list[int]
    since: list[int]
    rank: dict[int, int]
    table: dict[int, bool] = field(default_factory=dict)

    @classmethod
    def compile(cls, n_tokens: int, merges: list[tuple[int, int, int]]) -> MergeAutomaton:
        """merges: (a, b, token) by rank. A later rule for an existing pair or token changes nothing."""
        left, right, born, entered = [-1] * n_tokens, [-1] * n_tokens, [-1] * n_tokens, [0] * n_tokens
        parent, removed, since, rank = [-1], [-1], [-1], {}
        for k, (a, b, ab) in enumerate(merges):
            if a << 20 | b in rank or born[ab] >= 0:
                continue
            rank[a << 20 | b] = k
            left[ab], right[ab], born[ab], entered[ab] = a, b, k, entered[b]
            parent.append(entered[a])
            removed.append(b)
            since.append(k)
            entered[a] = len(parent) - 1
        return cls(left, right, born, entered, parent, removed, since, rank)

    def arc(self, last: int, token: int) -> bool:
        """Whether the state that `last` enters has an arc `token`; resolved once, then read from the table."""
        key = last << 20 | token
        got = self.table.get(key)
        if got is None:
            if len(self.table) >= TABLE_SIZE:
                self.table.clear()
            got = self.table[key] = self._resolve(last, token)
        return got

    def _resolve(self, x: int, y: int) -> bool:
        """Follow the copies of the state back to where the arc was made.

        The copies made for one label x differ by the arcs x's merges removed, so that rank finds the copy that
        removed y. Without one, an arc newer than x's first state came with its left half's arc; else the state that x
        entered at first, that of x's right half at the time, decides.
        """
        left, right, born, rank = self.left, self.right, self.born, self.rank
        before = len(rank) + len(born)
        while True:
            k = rank.get(x << 20 | y)
            if k is not None and k < before:
                return False
            if born[x] < 0 and born[y] < 0:
                return True
            if born[y] > born[x]:
                before = min(before, born[y] + 1)  # the copy made in the same step is without the arc as well
                y = left[y]
            else:
                before = born[x]
                x = right[x]

    def read(self, tokens: list[int]) -> bool:
        return all(self.arc(a, b) for a, b in zip(tokens, tokens[1:]))


class LetterTable:
    """The automaton as a deterministic transducer over letters (bytes): one table lookup for each letter.

    A state is the set of (last token, position in the trie of labels) that reading a prefix leaves open. A prefix has
    at most one accepted path, so that a transition emits at most one token: the one with which that path ends. States and
    transitions are compiled where a word first needs them, then read from the table.
    """

    def __init__(self, automaton: MergeAutomaton, inner: dict[bytes, int], final: dict[bytes, int], size: int = TABLE_SIZE):
        self.automaton, self.size = automaton, size
        self.trie: dict[int, int] = {}
        self.inner, self.final, self.branches = [-1], [-1], [False]
        for labels, ends in ((inner, self.inner), (final, self.final)):
            for label, token in labels.items():
                ends[self._node(label)] = token
        self.length = {t: len(label) for labels in (inner, final) for label, t in labels.items()}
        self.clear()

    def _node(self, label: bytes) -> int:
        node = 0
        for letter in label:
            child = self.trie.get(node << 8 | letter)
            if child is None:
                child = self.trie[node << 8 | letter] = len(self.inner)
                self.branches[node] = True
                self.inner.append(-1)
                self.final.append(-1)
                self.branches.append(False)
            node = child
        return node

    def clear(self) -> None:
        self.states, self.numbers = [((-1, 0),)], {((-1, 0),): 0}
        self.steps: dict[int, int] = {}
        self.ends: dict[int, int] = {}

    def _step(self, state: int, letter: int) -> int:
        """The next state above 20 bits, then the emitted token plus one."""
        open_ends, emitted = [], -1
        for last, node in self.states[state]:
            child = self.trie.get(node << 8 | letter)
            if child is None:
                continue
            if self.branches[child] or self.final[child] >= 0:
                open_ends.append((last, child))
            token = self.inner[child]
            if token >= 0 and (last < 0 or self.automaton.arc(last, token)):
                emitted = token
        if emitted >= 0:
            open_ends.append((emitted, 0))
        key = tuple(open_ends)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
        got = self.steps[state << 8 | letter] = number << 20 | emitted + 1
        return got

    def _end(self, state: int) -> int:
        """The token that ends the word."""
        for last, node in self.states[state]:
            token = self.final[node]
            if token >= 0 and (last < 0 or self.automaton.arc(last, token)):
                self.ends[state] = token
                return token
        raise ValueError("the vocabulary lacks a symbol")

    def read(self, word: bytes) -> list[int]:
        """Ids of one pre-split word."""
        if len(self.steps) > self.size:
            self.clear()
        steps, state, emitted = self.steps.get, 0, []
        for letter in word:
            got = steps(state << 8 | letter)
            if got is None:
                got = self._step(state, letter)
            state = got >> 20
            emitted.append((got & 0xFFFFF) - 1)
        token = self.ends.get(state)
        if token is None:
            token = self._end(state)
        path, at = [token], len(word) - self.length[token]
        while at > 0:
            token = emitted[at - 1]
            path.append(token)
            at -= self.length[token]
        path.reverse()
        return path


class Encoder:
    """Encodes and decodes whole texts with one vocabulary file of the kind with word ends.

    Normalization and split follow the file. Texts of Latin letters are handled here; for all others the library's own normalizer and
    pre-tokenizer give the words, since their Unicode version isn't Python's. The merges are the automaton's alone.
    """

    def __init__(self, path: str, cache_size: int = 300_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.automaton = MergeAutomaton.compile(len(vocab), merges)
        n, self.bytes = len(self.suffix), {ord(c): b for b, c in enumerate(byte_letters())}
        inner = {self.raw(s): i for s, i in vocab.items() if not s.endswith(self.suffix)}
        final = {self.raw(s[:-n]): i for s, i in vocab.items() if s.endswith(self.suffix) and len(s) > n}
        self.table = LetterTable(self.automaton, inner, final)
        self.packed = {i: i.to_bytes(4, "little") for i in self.labels}
        self.emitted = [self.labels.get(i, "").encode("utf-8") for i in range(max(self.labels) + 1)]
        self.split = regex.compile(SPLIT)
        self.spaces = regex.compile(f"[{SPACES}]+")
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.chunk = WordCache(self._chunk, cache_size)
        self.part = WordCache(self._word, cache_size)

    def raw(self, letters: str) -> bytes:
        """The bytes that byte letters stand for."""
        return letters.translate(self.bytes).encode("latin-1")

    def _word(self, word: bytes) -> bytes:
        return b"".join([self.packed[i] for i in self.table.read(word)])

    def _chunk(self, chunk: str) -> bytes:
        """Ids (little-endian, 32 bits) of a run without white space."""
        if chunk.isascii() or max(chunk) < "\u0250":
            text = chunk.lower()
            if text.isascii() and text.isalpha():
                return self.part(text.encode())
            if "\u0307" not in text:  # which a capital dotted I leaves
                return b"".join([self.part(w.encode("utf-8")) for w in self.split.findall(text)])
        words = self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(chunk))
        return b"".join([self.part(self.raw(w)) for w, _ in words])

    def _pieces(self, text: str) -> list[bytes]:
        """The ids of each of the text's runs without white space."""
        chunks = text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else [c for c in self.spaces.split(text) if c]
        return self.chunk.many(chunks)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers; null is empty."""
        if not text:
            return b""
        if self.specials is None or self.specials.search(text) is None:
            return b"".join(self._pieces(text))
        return b"".join([self.packed[self.special[p]] if p in self.special else b"".join(self._pieces(p)) for p in self.specials.split(text)])

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs that the ids read, in UTF-8, as the vocabulary's missing decoder joins them: by single spaces."""
        return b" ".join(map(self.emitted.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(path: str) -> Encoder:
    return per_worker(("bpe", path), lambda: Encoder(path))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers in a binary column.

    One row per row of docs; null and empty texts have no ids and decode to the empty text. Other columns are ignored.
    """
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [own.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([own.decode(i).decode() for i in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def digest_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_documents with both results as SHA-256 in lowercase hex: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    path = path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = encoder(path), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = own.encode(t.as_py())
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
