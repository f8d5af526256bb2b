import os
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from tiersum.llm import common, quality, toxicity

SUPPLIED = Path(os.environ.get("TIERSUM_TESTDATA_LARGE", "/root/testdata/sf0.1"))

DOCS = "doc_id long, text string, tail string, rating string"


def corpus(n=240, seed=4):
    """Three grades: junk, mixed, sound."""
    rng = random.Random(seed)
    good, bad = "the river runs below green hills and people walk there".split(), "BUY!! $$$ click### win!!".split()
    docs, ratings = [], []
    for i in range(n):
        g = i % 3
        words = [rng.choice(good if rng.random() < (0.05, 0.6, 1.0)[g] else bad) for _ in range(60)]
        docs.append((i, " ".join(words), "clash", "clash"))
        ratings.append((i, g))
    return docs, ratings


def test_grades_are_ordered_and_held_out_rows_are_graded_right(spark):
    docs, ratings = corpus()
    model = quality.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(ratings[:180], "doc_id long, rating int"))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    rows = quality.grade_documents(spark.createDataFrame(docs, DOCS), model).collect()
    right = sum(round(r.expected_grade) == r.doc_id % 3 for r in rows if r.doc_id >= 180)
    assert right >= 57
    assert all(r.selected == (r.doc_id % 3 > 0) for r in rows if r.doc_id >= 180)


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    index = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(40)]
    share = [np.full(len(i), 1 / len(i), np.float32) for i in index]
    grade = rng.integers(0, 4, 40)
    model = quality.fit_ordinal(index, share, grade, np.ones(40), [0.0, 1.0, 2.0, 5.0], rounds=400)

    def loss(m):
        s = np.array([(m.weights[i] * v).sum() for i, v in zip(index, share)])
        t = np.column_stack((np.ones(40), m.tails(s), np.zeros(40)))
        p = t[np.arange(40), grade] - t[np.arange(40), grade + 1]
        return -np.log(p).mean()

    best = loss(model)
    for _ in range(20):  # no nearby thresholds or weights do better
        other = quality.OrdinalModel(model.grades, model.weights, model.thresholds + rng.normal(0, 0.05, 3))
        assert loss(other) > best - 2e-3


def test_fit_scores_texts_as_features_say():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Hello!!", "the", "the", "grüße", "...", "x" * 50, "12"]) for _ in range(n)) for n in (1, 2, 30, 400)] + ["...", "", None]
    model = quality.OrdinalModel([0.0, 1.0], np.random.default_rng(1).normal(size=quality.DIMENSIONS).astype(np.float32), np.zeros(1))
    for text, latent in zip(texts, model.latent(texts)):
        index, value = quality.features(text)
        assert latent == pytest.approx(float((model.weights[index] * value).sum()), abs=1e-4) if len(index) else latent == -np.inf


def test_defined_cases(spark):
    docs, ratings = corpus(60)
    odd = [(100, None, "", ""), (101, "", "", ""), (102, "the river " * 20000, "", ""), (None, "the river", "", ""), (0, docs[0][1], "", "")]
    rated = ratings + [(0, 2), (None, 1), (5, None), (999, 1)]
    table = spark.createDataFrame(docs + odd, DOCS)
    model = quality.fit(table, spark.createDataFrame(rated, "doc_id long, rating int"))
    got = quality.grade_documents(table, model).collect()
    assert len(got) == 65 and all(0 <= r.tail <= 1 for r in got)
    blank = {(r.tail, r.expected_grade) for r in got if r.doc_id in (100, 101)}
    assert len(blank) == 1
    assert all(not r.selected and r.tail < 1e-9 and r.expected_grade == pytest.approx(0) for r in got if r.doc_id in (100, 101))
    none = quality.fit(table, spark.createDataFrame([], "doc_id long, rating int"))
    assert {(r.tail, r.expected_grade, r.selected) for r in quality.grade_documents(table, none).collect()} == {(1.0, 0.0, True)}
    assert quality.grade_documents(table.limit(0), model).count() == 0


@pytest.mark.skipif(not SUPPLIED.exists(), reason="no test tables")
def test_recall_of_each_grade_on_held_out_rows(spark):
    """The supplied labels at the largest scale: junk, abusive and sound documents that the fit hasn't seen."""
    docs, labels = (spark.read.parquet(str(SUPPLIED / f"{t}.parquet")) for t in ("documents", "labels"))
    ratings = quality.usability(labels)
    got = quality.grade_documents(docs, quality.fit(docs, ratings)).filter("held_out").join(ratings, "doc_id").filter("rating is not null")
    rows = got.selectExpr("rating", "cast(round(expected_grade) as int) as grade", "selected").collect()
    recall = [np.mean([r.grade == g for r in rows if r.rating == g]) for g in range(3)]
    assert len(rows) > 500 and recall[0] > 0.9 and recall[1] > 0.8 and recall[2] > 0.9, recall
    assert np.mean([r.selected for r in rows if r.rating == 2]) > 0.99 and np.mean([r.selected for r in rows if r.rating == 0]) < 0.1


def test_repeated_ids_and_long_texts_leave_the_fit_bounded(spark):
    docs, ratings = corpus(60)
    again = [(0, docs[0][1] + " z", "", "")] * 300 + [(3, "long " * 100_000, "", "")]
    table = spark.createDataFrame(docs + again, DOCS)
    sample = spark.createDataFrame(ratings, "id long, grade int")
    got = common.fit_texts(table, sample, "grade", "doc_id", "text", 100_000).collect()
    assert len(got) == 60 and max(len(r.text) for r in got) < 1000
    assert len(common.fit_texts(table, sample, "grade", "doc_id", "text", 6_000).collect()) < 60


def test_grades_equal_brute_force(spark):
    """All rows by the model's formula, one word at a time."""
    docs, ratings = corpus(120)
    odd = [(500, None, "", ""), (501, " \t", "", ""), (502, "the the River! " * 9_000, "", ""), (-1, docs[1][1], "", "")]
    table = spark.createDataFrame(docs + odd, DOCS)
    model = quality.fit(table, spark.createDataFrame(ratings, "doc_id long, rating int"))
    got = {r.doc_id: r for r in quality.grade_documents(table, model).collect()}
    for i, text, *_ in docs + odd:
        words = (text or "").split()
        score = sum(float(model.weights[f]) for w in words for f in quality.word_features(w)) + sum(float(model.weights[quality.REPEAT]) for a, b in zip(words, words[1:]) if a == b)
        seen = {f % quality.DIMENSIONS for w in words for f in toxicity.word_features(w)}
        score = score / max(1, len(words)) + sum(float(model.weights[f]) for f in seen) / max(1, len(seen)) ** 0.5
        tails = [1 / (1 + np.exp(t - score)) if words else 0.0 for t in model.thresholds]
        expected = model.grades[0] + sum(p * (b - a) for p, a, b in zip(tails, model.grades, model.grades[1:]))
        assert got[i].tail == pytest.approx(tails[0], abs=1e-5) and got[i].expected_grade == pytest.approx(expected, abs=1e-5)
        assert got[i].selected == (got[i].tail >= 0.5)


def test_fit_holds_little_more_than_its_values():
    """Two million values: 8 bytes for each, and a block's intermediate arrays."""
    rng = np.random.default_rng(6)
    index = [rng.integers(0, quality.DIMENSIONS, 1_000).astype(np.int32) for _ in range(2_000)]
    share = [np.full(1_000, 1e-3, np.float32)] * 2_000
    tracemalloc.start()
    try:
        quality.fit_ordinal(index, share, rng.integers(0, 3, 2_000), np.ones(2_000), [0.0, 1.0, 2.0], rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 * 2_000_000


def test_words_are_looked_up_once_a_text():
    asked = []

    class Counting(common.WordCache):
        def many(self, words):
            asked.extend(words)
            return super().many(words)

    model = quality.OrdinalModel([0.0, 1.0], np.ones(quality.DIMENSIONS, np.float32), np.zeros(1))
    words = ["the", "the", "River", "the", "River", "1990"]
    cache = Counting(lambda w: (float(model.weights[list(quality.word_features(w))].sum()), quality.presence(w)))
    got = model.latent([" ".join(words)], cache)
    seen = {f for w in words for f in quality.presence(w)}
    assert sorted(asked) == ["1990", "River", "the"] and got[0] == pytest.approx((3 * 6 + 1) / 6 + len(seen) ** 0.5)


def test_shapes_of_odd_words():
    rng = random.Random(1)
    for _ in range(5_000):
        word = "".join(rng.choice("aabBcC019-_!.éßÅΩ中٣ǅ'\x1f") for _ in range(rng.randint(1, 9)))
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
        assert quality.shape(word) == "".join(k for n, k in enumerate(kinds) if n == 0 or k != kinds[n - 1])
