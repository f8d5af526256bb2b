import random
import zlib

import numpy as np

from tiersum.llm import language
from tiersum.llm.common import WordCache

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string"
WORDS = {"aa": "the and with from house water green river people".split(), "bb": "el los casa agua verde gente camino mañana señor".split()}


def rows(n=80, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(30)), lang, "clash", "clash"))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    data = rows()
    odd = [(900, None, "aa", "", ""), (901, "", "aa", "", ""), (902, "123 !! 456", None, "", ""), (903, "ქართული", None, "", ""), (904, "casa " * 30000, None, "", ""), (None, "house water", "aa", "", ""), (1, data[1][1], data[1][2], "", "")]
    docs = spark.createDataFrame(data + odd, SCHEMA)
    filters = language.learn(docs)
    assert filters.languages == ["aa", "bb"]
    got = language.identify(docs, filters).collect()
    assert len(got) == len(data) + len(odd)
    by = {r.doc_id: r for r in got}
    for i, _, lang, *_ in data:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert by[i].lang_pred == lang and 0 <= by[i].score <= 1
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred in WORDS and by[903].score < 0.5
    assert by[904].lang_pred == "bb" and by[None].lang_pred == "aa" and by[None].held_out


def test_filters_hold_every_learned_gram(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    filters = language.learn(docs)
    counts: dict = {}
    for i, text, lang, *_ in rows():
        if zlib.crc32(str(i).encode()) % 4 != 2:
            for word in text.split():
                for g in language.grams(word):
                    counts.setdefault(g, {}).setdefault(lang, 0)
                    counts[g][lang] += 1
    total = {lang: sum(c.get(lang, 0) for c in counts.values()) for lang in WORDS}
    for g, c in counts.items():
        top = max(n / total[lang] for lang, n in c.items())
        for lang, n in c.items():
            if n >= language.MIN_COUNT and n / total[lang] >= language.MIN_RATIO * top:
                assert filters.mask(g) >> filters.languages.index(lang) & 1
    assert filters.false.max() < 0.01


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(2, "some words", None, "", "")], SCHEMA)
    filters = language.learn(docs)
    assert [(r.lang_pred, r.score) for r in language.identify(docs, filters).collect()] == [("und", 0.0)]
    assert language.identify(docs.limit(0), filters).count() == 0


def test_letters_decide_what_is_undetermined(spark):
    texts = ["½ ²", "٣٤ 12", "_", "Ⅷ ①", "〇", "ª", "ß", "中", "a½"]
    docs = spark.createDataFrame(rows() + [(1000 + i, t, None, "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, language.learn(docs)).collect()}
    assert [got[1000 + i] != "und" for i in range(len(texts))] == [any(c.isalpha() for c in t) for t in texts]


def test_prediction_equals_a_plain_count():
    """The packed fields against one mask for each n-gram, and ties against the order of names."""
    rng = np.random.default_rng(2)
    table = rng.integers(0, 8, language.CELLS).astype(np.uint64)
    filters = language.LanguageFilters(["aa", "bb", "cc"], table, 1)
    cache = WordCache(lambda chunk: filters.counts(chunk, WordCache(filters.fields)))
    for text in ["green river, people!", "casa VERDE x", "mañana 12 señor-a", "q", "the " * 500]:
        grams = [g for w in text.split() for g in language.grams(w)]
        hits = np.zeros(3)
        for g in grams:
            shared = 7
            for c in language.cells(g):
                shared &= int(table[c])
            hits += [shared >> b & 1 for b in range(3)]
        estimate = np.maximum(0, (hits - filters.false * len(grams)) / (1 - filters.false))
        lang, score = filters.predict(text, cache)
        want = int(estimate.argmax()) if estimate.max() > 0 else 1
        assert lang == filters.languages[want] and abs(score - min(1, estimate[want] / len(grams))) < 1e-12
    even = language.LanguageFilters(["aa", "bb"], np.full(language.CELLS, 3, np.uint64), 1)
    even.false = np.zeros(2)
    assert even.predict("tie", WordCache(lambda chunk: even.counts(chunk, WordCache(even.fields)))) == ("aa", 1.0)


def test_more_languages_than_a_mask_has_bits(spark):
    """70 languages with words of their own take two tables."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = {f"l{k:02d}": ["".join(rng.choices(letters[k % 20 : k % 20 + 7], k=6)) for _ in range(6)] for k in range(70)}
    data = [(i, " ".join(rng.choices(words[f"l{i % 70:02d}"], k=40)), f"l{i % 70:02d}", "", "") for i in range(700)]
    docs = spark.createDataFrame(data, SCHEMA)
    filters = language.learn(docs)
    assert filters.table.shape == (2, language.CELLS) and len(filters.languages) == 70
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, filters).collect()}
    assert np.mean([got[i] == lang for i, _, lang, *_ in data]) > 0.98


def test_many_texts_at_once_equal_one_at_a_time(spark, monkeypatch):
    """Mixed scripts, letters beyond 16 bits, marks inside words, long texts, in slices of a few words."""
    filters = language.learn(spark.createDataFrame(rows(), SCHEMA))
    rng = random.Random(5)
    pieces = ["house", "CASA!", "mañana-verde", "x", "ΟΔΟΣ", "İstanbul", "𝒜𝓁𝓅𝒽𝒶", "a𐐀b", "中文字", "123", "e\u0301te", "ﬃ", "don't", "_", "日本", "\x1cq"]
    texts = [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 30))) for _ in range(200)] + [None, "", " ", "casa " * 5_000]
    cache = WordCache(lambda chunk: filters.counts(chunk, WordCache(filters.fields)))
    want = [filters.predict(t, cache) for t in texts]
    for size, kept in ((1 << 24, 1 << 20), (30, 20)):
        monkeypatch.setattr(language, "SLICE", size)
        monkeypatch.setattr(language, "KEPT_WINDOWS", kept)
        counts = language.Popcounts(filters)
        names, scores = filters.decide(*(lambda c: (c[:, :-1], c[:, -1]))(counts.of_texts(texts)))
        assert names == [w[0] for w in want] and np.allclose(scores, [w[1] for w in want], atol=1e-12)
    for word in pieces:
        codes, _, odd = language.window_codes([word])
        assert odd == [0] or [language.window_of(int(c)) for c in codes] == language.windows(word)
