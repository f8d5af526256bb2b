"""Hidden Markov language model over words.

Symbols are the most frequent training words (a bounded core), the end, and classes of all other words by their last
bytes. States emit symbols; a word outside the core has the probability of its class times its add-one share of the class,
which no state changes, with one share for an unknown word. So the forward recursion needs a bounded table only, while
the counts of all other words stay in Spark and are joined.

Training is Baum-Welch: in each round every task runs forward and backward over its documents, and the expected counts are added up by
symbol in Spark. Rounds over parts of the training documents, whose counts are blended, start the model; then come rounds over all of
them, until the likelihood settles or their number is reached. Documents are cut into chunks, each read with some words of
the text around it, so that states at a cut know both sides and moves across it count. Scoring is
exact: a document's likelihood is the product of the transfer matrices of its chunks, whose scales are kept as logarithms.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersum.llm.common import LONG_WORD, is_held_out, materialize, per_worker

HOLD_OUT = 7
STATES = 8
#: Words with emission probabilities of their own, at most.
CORE = 1 << 16
CLASSES = 256
#: Training documents are dealt into so many parts; the first rounds take the next parts, later ones more of them.
PARTS = 16
FIRST_ROUNDS = ((0, 1), (1, 2), (2, 4))
#: Rounds over all training documents at most, and the gain in log10 likelihood a token below which another one isn't worth it.
FULL_ROUNDS, SETTLED = 2, 1e-3
#: Documents are cut into chunks of so many tokens: segments in training, factors of an exact product in scoring.
CHUNK = 256
#: Tokens read on both sides of a chunk in training.
CONTEXT = 24
#: Words outside the core whose symbols a worker keeps.
KNOWN_WORDS = 400_000
BATCH_TOKENS = 400_000
#: Pseudo-tokens of the corpus distribution in each state's emissions.
SMOOTHING = 500.0


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


class Symbols(dict):
    """Word to symbol: the core words', and as they come the classes of others."""

    def __init__(self, core: dict[bytes, int]):
        super().__init__(core)
        self.first, self.limit = len(core) + 1, len(core) + KNOWN_WORDS

    def __missing__(self, word: bytes) -> int:
        symbol = self.first + word_class(word)
        if len(word) <= LONG_WORD and len(self) < self.limit:
            self[word] = symbol
        return symbol


@dataclass
class HiddenMarkov:
    """core: word to symbol; after those come the end and the classes. counts: of the core words and the end.

    onward: the law of the state somewhere in a document."""

    core: dict[bytes, int]
    counts: np.ndarray
    start: np.ndarray
    onward: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @property
    def end(self) -> int:
        return len(self.core)

    @cached_property
    def known(self) -> Symbols:
        return Symbols(self.core)

    def symbols(self, words: list[bytes]) -> np.ndarray:
        got = np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))
        return np.append(got, np.int32(self.end))

    def rare(self, words: list[bytes], symbols: np.ndarray) -> tuple[Counter, list[int]]:
        """How often each word outside the core occurs, and those words' classes in the same order."""
        at = np.flatnonzero(symbols > self.end)
        own = [words[i] for i in at.tolist()]
        return Counter(own), list(dict(zip(own, (symbols[at] - self.end - 1).tolist())).values())

    def log10_likelihood(self, docs: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of symbol sequences: chunks' transfer matrices in lock-step, then their products."""
        states = len(self.start)
        chunks = [(d, s[k : k + CHUNK]) for d, s in enumerate(docs) for k in range(0, len(s), CHUNK)]
        order = sorted(range(len(chunks)), key=lambda i: -len(chunks[i][1]))
        sizes = np.array([len(chunks[i][1]) for i in order])
        padded = np.zeros((len(order), int(sizes[0])), np.int32)
        for row, i in enumerate(order):
            padded[row, : sizes[row]] = chunks[i][1]
        product, scale = np.tile(np.eye(states), (len(order), 1, 1)), np.zeros(len(order))
        for t in range(padded.shape[1]):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            part = product[:live] * self.emit[padded[:live, t]][:, None, :]
            product[:live] = (part.reshape(-1, states) @ self.move).reshape(part.shape)
            if t % 12 == 11:
                top = product[:live].max(axis=(1, 2))
                product[:live] /= top[:, None, None]
                scale[:live] += np.log10(top)
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        total, belief = np.zeros(len(docs)), None
        last = -1
        for i, (d, _) in enumerate(chunks):
            belief = self.start if d != last else belief
            last = d
            belief = belief @ product[where[i]]
            mass = belief.sum()
            total[d] += np.log10(mass) + scale[where[i]]
            belief = belief / mass
        return total

    def expected_counts(self, segments: list[tuple[np.ndarray, int, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Forward-backward over segments (symbols, lo, hi, whether a document starts there): expected counts of emissions, moves
        and first states, and the log10 likelihood. Only tokens lo to hi and the moves that reach them count, the others are context."""
        emit, move = self.emit.astype(np.float32), self.move.astype(np.float32)
        states = len(self.start)
        segments = sorted(segments, key=lambda s: -len(s[0]))
        sizes = np.array([len(s[0]) for s in segments])
        lo, hi, first = (np.array([s[k] for s in segments]) for k in (1, 2, 3))
        longest, lanes = int(sizes[0]), len(segments)
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]
        offset = np.concatenate(([0], np.cumsum(live)))
        flat, own = np.empty(offset[-1], np.int32), np.empty(offset[-1], np.float32)
        padded = np.zeros((lanes, longest), np.int32)
        for row, (s, *_) in enumerate(segments):
            padded[row, : len(s)] = s
        padded = np.ascontiguousarray(padded.T)
        alpha, emitted = np.empty((offset[-1], states), np.float32), np.empty((offset[-1], states), np.float32)
        belief = np.where(first[:, None], self.start[None, :], self.onward[None, :]).astype(np.float32)
        scale = np.empty(offset[-1], np.float32)
        for t, n in enumerate(live):
            a, b = offset[t], offset[t + 1]
            flat[a:b] = padded[t, :n]
            own[a:b] = (lo[:n] <= t) & (t < hi[:n])
            np.take(emit, flat[a:b], axis=0, out=emitted[a:b])
            w = belief[:n] * emitted[a:b]
            scale[a:b] = w.sum(axis=1)
            np.divide(w, scale[a:b, None], out=alpha[a:b])
            belief = alpha[a:b] @ move
        emitted /= scale[:, None]
        back = np.ones((lanes, states), np.float32)
        moves, back_move = np.zeros((states, states)), np.ascontiguousarray(move.T)
        for t in range(longest - 1, -1, -1):
            a, b, n = offset[t], offset[t + 1], live[t]
            if t + 1 < longest and live[t + 1]:
                m, c = live[t + 1], offset[t + 1]
                ahead = emitted[c : c + m] * back[:m]
                moves += alpha[a : a + m].T @ (ahead * own[c : c + m, None])
                back[:m] = ahead @ back_move
            alpha[a:b] *= back[:n]  # from here on the states' probabilities given the whole segment
        started = alpha[: live[0]][first].sum(axis=0, dtype=np.float64)
        alpha *= own[:, None]
        columns = np.ascontiguousarray(alpha.T)
        emissions = np.stack([np.bincount(flat, weights=columns[s], minlength=len(self.emit)) for s in range(states)], axis=1)
        return emissions, moves * self.move, started, float(np.log10(scale) @ own)


def segments_of(s: np.ndarray) -> list[tuple[np.ndarray, int, int, bool]]:
    """The chunks of a document with their context."""
    out = []
    for k in range(0, len(s), CHUNK):
        begin, end = max(0, k - CONTEXT), min(len(s), k + CHUNK)
        out.append((s[begin : end + CONTEXT], k - begin, end - begin, k == 0))
    return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush():
        words = list(held)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(map(word_class, words)), pa.int32()), pa.array(list(held.values()), pa.int64())], ["word", "class", "c"])
        held.clear()

    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            for t in batch.column(0).slice(lo, 1000):
                held.update(words_of(t.as_py()))
            if len(held) > 300_000:
                yield from flush()
    yield from flush()


@dataclass
class Corpus:
    """Counts of the training documents: the stored table words(word, class, c) and what is small about it."""

    words: DataFrame
    documents: int
    tokens: int
    types: int
    core: list[tuple[bytes, int]]
    class_tokens: np.ndarray
    class_types: np.ndarray


def count_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", core: int = CORE) -> Corpus:
    """Counts over all documents that aren't held out."""
    train = docs.filter(~is_held_out(F.col(id_col), HOLD_OUT)).select(F.col(text_col).alias("text"))
    words = materialize(train.mapInArrow(_count_words, "word string, class int, c long").groupBy("word", "class").agg(F.sum("c").alias("c")), "words")
    documents = train.count()
    top = [(r["word"].encode("utf-8"), r["c"]) for r in words.orderBy(F.desc("c"), "word").limit(core).collect()]
    tokens, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in words.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        tokens[r["class"]], types[r["class"]] = r["n"], r["v"]
    total, distinct = int(tokens.sum()), int(types.sum())
    for w, c in top:
        tokens[word_class(w)] -= c
        types[word_class(w)] -= 1
    return Corpus(words, documents, total + documents, distinct + (documents > 0), top, tokens, types)


def initial_model(corpus: Corpus, states: int = STATES, seed: int = 11) -> HiddenMarkov:
    """States that differ by noise, and stay with probability 0.9."""
    rng = np.random.default_rng(seed)
    counts = np.array([c for _, c in corpus.core] + [corpus.documents], np.int64)
    share = corpus_shares(corpus)
    emit = share[:, None] * np.exp(rng.normal(0, 0.7, (len(share), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    even = np.full(states, 1 / states)
    return HiddenMarkov({w: i for i, (w, _) in enumerate(corpus.core)}, counts, even, even, move, emit / emit.sum(axis=0))


def corpus_shares(corpus: Corpus) -> np.ndarray:
    """Distribution of the symbols in training, one added to the end and to each class."""
    n = np.concatenate(([c for _, c in corpus.core], [corpus.documents + 1], corpus.class_tokens + 1)).astype(float)
    return n / n.sum()


def train(docs: DataFrame, corpus: Corpus, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, first_rounds=FIRST_ROUNDS, full_rounds: int = FULL_ROUNDS, log: list | None = None) -> HiddenMarkov:
    """Baum-Welch in rounds over parts, then over all training documents.

    The driver gets one row of expected counts per symbol and round: at most core + classes + states + 3. log, if given, receives
    the log10 likelihood a token that each round's model had.
    """
    model = initial_model(corpus, states)
    part = F.pmod(F.xxhash64(id_col), F.lit(PARTS))
    known = docs.filter(~is_held_out(F.col(id_col), HOLD_OUT)).select(F.col(text_col).alias("text"), part.alias("part"))
    blend, before = None, None
    for number, (lo, hi) in enumerate(first_rounds):
        new, rate = _expected(known.filter((F.col("part") >= lo) & (F.col("part") < hi)), model)
        if new is None:
            continue
        step = (number + 2) ** -0.6 if blend is not None else 1.0
        blend = new if blend is None else (1 - step) * blend + step * new
        model = _improved(model, corpus, blend)
        if log is not None:
            log.append(rate)
    for _ in range(full_rounds):
        new, rate = _expected(known, model)
        if new is None:
            break
        model = _improved(model, corpus, new)
        if log is not None:
            log.append(rate)
        if before is not None and rate - before < SETTLED:
            break
        before = rate
    return model


def _expected(texts: DataFrame, model: HiddenMarkov) -> tuple[np.ndarray | None, float]:
    """Expected counts over all texts as shares of their tokens, rows by symbol, then by state, then the first states; and the log10 likelihood a token."""
    spark, states, size = texts.sparkSession, len(model.start), len(model.emit)
    held, tag = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_worker(("hmm", tag), lambda: held.value)
        total, segments, tokens = np.zeros((size + states + 2, states)), [], 0

        def add():
            e, m, f, rate = own.expected_counts(segments)
            total[:size] += e
            total[size : size + states] += m
            total[-2] += f
            total[-1, 0] += rate

        for batch in batches:
            for t in batch.column(0):
                s = own.symbols(words_of(t.as_py()))
                segments += segments_of(s)
                tokens += len(s)
                if tokens > BATCH_TOKENS:
                    add()
                    segments, tokens = [], 0
        if segments:
            add()
        at = np.nonzero(total.any(axis=1))[0]
        for lo in range(0, len(at), 8192):
            rows = at[lo : lo + 8192]
            values = pa.array(total[rows].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * states), values)], ["symbol", "n"])

    sums = [F.sum(F.col("n")[s]).alias(f"n{s}") for s in range(states)]
    got = texts.select("text").mapInArrow(expect, "symbol long, n array<double>").groupBy("symbol").agg(*sums).toArrow()
    held.destroy()
    if not got.num_rows:
        return None, 0.0
    new = np.zeros((size + states + 2, states))
    new[got.column("symbol").to_numpy()] = np.stack([got.column(f"n{s}").to_numpy() for s in range(states)], axis=1)
    tokens = new[:size].sum()
    return new[:-1] / tokens, float(new[-1, 0] / tokens)


def _improved(model: HiddenMarkov, corpus: Corpus, shares: np.ndarray) -> HiddenMarkov:
    """The model that expected counts, given as shares of the tokens, give, smoothed by the corpus distribution."""
    size, counts = len(model.emit), shares * corpus.tokens
    emissions = counts[:size] + SMOOTHING * corpus_shares(corpus)[:, None]
    moves, first, onward = counts[size:-1] + 1, counts[-1] + 0.1, counts[:size].sum(axis=0) + 0.1
    return HiddenMarkov(model.core, model.counts, first / first.sum(), onward / onward.sum(), moves / moves.sum(axis=1, keepdims=True), emissions / emissions.sum(axis=0))


SCORED = "row_id long, doc_id long, n_tokens long, known long, base double, likelihood double, rare array<string>, rare_class array<int>, rare_n array<int>"
SCORED_NAMES = [c.split()[0] for c in SCORED.split(", ")]


def score(docs: DataFrame, corpus: Corpus, model: HiddenMarkov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of docs.

    n_tokens counts the end; null, empty and blank texts are the end alone. Without training documents every known
    count is 0 and base_score is 0. Repeated rows get equal values; a null id counts as held out. Other columns are ignored.
    """
    spark = docs.sparkSession
    held, tag = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    base_total = float(np.log10(corpus.tokens + corpus.types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_worker(("hmm", tag), lambda: held.value)
        logs = np.concatenate((np.log10(own.counts + 1.0) - base_total, np.zeros(CLASSES)))
        found = np.concatenate((own.counts > 0, np.zeros(CLASSES, bool)))
        row = TaskContext.get().partitionId() << 33

        def out(ids, texts):
            nonlocal row
            words = [words_of(t) for t in texts]
            docs = [own.symbols(w) for w in words]
            rare, classes = zip(*map(own.rare, words, docs))
            lists = lambda flat: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rare]))), pa.int32()), flat)
            values = [
                pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.int64()), pa.array([len(s) for s in docs], pa.int64()),
                pa.array([int(found[s].sum()) for s in docs], pa.int64()), pa.array([float(logs[s].sum()) for s in docs]), pa.array(own.log10_likelihood(docs)),
                lists(pa.array([x for r in rare for x in r], pa.binary()).cast(pa.string())), lists(pa.array([c for k in classes for c in k], pa.int32())), lists(pa.array([n for r in rare for n in r.values()], pa.int32())),
            ]
            row += len(ids)
            return pa.RecordBatch.from_arrays(values, SCORED_NAMES)

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1] or "") + 100
                if size > 6 * BATCH_TOKENS:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield out(ids, texts)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = materialize(plain.mapInArrow(run, SCORED), "scored")
    totals = F.array(*(F.lit(float(n)) for n in np.log10(corpus.class_tokens + corpus.class_types + 1.0)))
    rare = scored.select("row_id", F.explode(F.arrays_zip("rare", "rare_class", "rare_n")).alias("x")).select("row_id", F.col("x.rare").alias("word"), F.col("x.rare_class").alias("of"), F.col("x.rare_n").alias("times"))
    joined = rare.join(corpus.words.select("word", "c"), "word", "left").withColumn("log", F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)))
    sums = joined.groupBy("row_id").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("r_known"),
        F.sum(F.col("times") * (F.col("log") - base_total)).alias("r_base"),
        F.sum(F.col("times") * (F.col("log") - F.get(totals, F.col("of")))).alias("r_score"),
    )
    rows = scored.drop("rare", "rare_class", "rare_n").join(sums, "row_id", "left")
    zero = F.lit(0.0)
    return rows.select(
        "doc_id", is_held_out(F.col("doc_id"), HOLD_OUT).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("r_known", F.lit(0))).cast("long").alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("r_base", zero)).alias("base_score"), (F.col("likelihood") + F.coalesce("r_score", zero)).alias("score"),
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, core: int = CORE) -> DataFrame:
    """Count, train and score in one go; columns as in `score`."""
    corpus = count_corpus(docs, id_col, text_col, core)
    return score(docs, corpus, train(docs, corpus, id_col, text_col, states), id_col, text_col)
