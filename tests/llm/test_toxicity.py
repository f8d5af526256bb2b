import random
import zlib

import numpy as np

from tiersum.llm import toxicity

DOCS = "doc_id long, text string, score string, sentence string"


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = "the river runs below green hills and people walk there in peace every day".split()
    bad = "vexolor grumbat skazzle".split()
    docs, labels = [], []
    for i in range(n):
        said = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 12))]
        y = int(rng.random() < 0.4)
        if y:
            k = rng.randrange(len(said))
            said[k] += f" you {rng.choice(bad)}{rng.choice(['', 's', 'en'])}"
        docs.append((i, ". ".join(said) + ".", "clash", "clash"))
        labels.append((i, y))
    return docs, labels


def test_held_out_documents_and_sentences(spark):
    docs, labels = corpus()
    table = spark.createDataFrame(docs, DOCS)
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    truth, got = dict(labels), toxicity.score_documents(table, model).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    spots = toxicity.locate(table, model).collect()
    texts = {d[0]: d[1] for d in docs}
    assert all(texts[r.doc_id][r.start : r.end] == r.sentence for r in spots)
    right = [any(b in r.sentence for b in ("vexolor", "grumbat", "skazzle")) for r in spots]
    assert len(spots) > 100 and np.mean(right) > 0.95


def test_score_is_the_noisy_or_of_sentences(spark):
    w = np.zeros(toxicity.DIMENSIONS, np.float32)
    for word, v in (("awful", 2.0), ("fine", -1.0)):
        w[list(toxicity.word_features(word))] = v / len(toxicity.word_features(word))
    model = toxicity.NoisyOrModel(w, -3.0)
    text = "An awful thing! It is fine.\nAwful, awful"
    p = [1 / (1 + np.exp(-z)) for z in (-1.0, -4.0, 1.0)]
    (row,) = toxicity.score_documents(spark.createDataFrame([(1, text, "", "")], DOCS), model).collect()
    assert abs(row.score - (1 - np.prod([1 - q for q in p]))) < 1e-6


def test_sentences_are_bounded_and_cover_all_words():
    text = "one two. three!\n" + "w " * 1000 + "\n\n ... end"
    spans = list(toxicity.sentences(text))
    assert "".join("".join(text[a:b].split()) for a, b in spans) == "".join(text.split())
    assert [text[a:b].split() for a, b in spans] == toxicity.sentence_words(text)
    assert max(len(text[a:b].split()) for a, b in spans) <= toxicity.SENTENCE_WORDS


def test_defined_cases(spark):
    docs, labels = corpus(60)
    odd = [(100, None, "", ""), (101, "", "", ""), (102, " . ! ", "", ""), (103, "calm words " * 30000, "", ""), (None, "calm", "", ""), (0, docs[0][1], "", "")]
    table = spark.createDataFrame(docs + odd, DOCS)
    model = toxicity.fit(table, spark.createDataFrame(labels + [(None, 1), (1, None), (5, 1), (777, 0)], "doc_id long, toxic int"))
    got = toxicity.score_documents(table, model).collect()
    assert len(got) == 66 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.score for r in got if r.doc_id in (100, 101)} == {0.0}
    blank = toxicity.fit(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r.score for r in toxicity.score_documents(table.filter("doc_id < 50"), blank).collect()) < 0.3
    assert toxicity.score_documents(table.limit(0), model).count() == toxicity.locate(table.limit(0), model).count() == 0


def test_scores_and_worst_sentences_equal_brute_force(spark):
    """All rows by the model's formula, one word at a time."""
    docs, labels = corpus(150)
    odd = [(500, None, "", ""), (501, " . ", "", ""), (502, "calm words. " * 4_000 + "you skazzle. " + "calm words. " * 4_000, "", "")]
    table = spark.createDataFrame(docs + odd, DOCS)
    model = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_documents(table, model).collect()}
    found = 0
    for i, text, *_ in docs + odd:
        spans = list(toxicity.sentences(text))
        p = []
        for a, b in spans:
            z = float(model.bias) + sum(float(model.weights[f]) for w in text[a:b].split() for f in toxicity.word_features(w))
            p.append(1 / (1 + np.exp(-z)))
        row, score = got[i], 1 - np.prod([1 - q for q in p])
        assert abs(row.score - score) < 1e-4 and row.predicted == int(row.score >= 0.3)
        if row.predicted:
            k = spans.index((row.worst_start, row.worst_end))
            found += 1
            assert abs(row.worst_score - max(p)) < 1e-4 and abs(p[k] - max(p)) < 1e-6
        else:
            assert (row.worst_start, row.worst_end, row.worst_score) == (None, None, None)
    assert found > 40
