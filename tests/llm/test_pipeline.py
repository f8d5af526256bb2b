import numpy as np
import pytest

from tests.llm.test_simhash import brute_components, brute_fingerprint
from tiersum.llm import quality, toxicity

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, selected string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """300 documents: sound, junk, toxic, and copies of the first ones."""
    rng = np.random.default_rng(8)
    good, docs, labels = "the river runs below green hills and people walk there in peace".split(), [], []
    for i in range(300):
        words = [str(w) for w in rng.choice(good, int(rng.integers(20, 60)))]
        kind = i % 10
        if kind == 1:
            words = [f"{w}!!" for w in rng.choice(["BUY", "WIN", "$$$"], 30)]
        elif kind == 2:
            words.insert(5, "skazzle")
        text = docs[kind - 3][1] if kind in (3, 6) and i > 150 else " ".join(words)
        docs.append((i, text, "en", "s", len(text), "clash"))
        labels.append((i, int(kind != 1), int(kind == 2)))
    docs += [(900, None, "en", "s", 0, ""), (901, "", "en", "s", 0, ""), docs[4]]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), docs


def test_stages_and_run(spark, folder):
    root, rows = folder
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == len(set(names)) == 4
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns = docs.columns
    sound = pipeline.keep_sound(spark, docs, root)
    kept = sorted(r.doc_id for r in sound.select("doc_id").collect())
    model = quality.fit(docs, quality.usability(spark.read.parquet(f"{root}/labels.parquet")))
    brute = [d[0] for d in rows if model.tails(model.latent([d[1]]))[0, 0] >= 0.5]
    assert kept == sorted(brute) and sound.columns == columns
    assert {i for i in kept if i < 300} == {i for i in range(300) if i % 10 != 1}
    civil = pipeline.keep_civil(spark, sound, root)
    still = sorted(r.doc_id for r in civil.select("doc_id").collect())
    assert {i for i in still if i < 300} == {i for i in range(300) if i % 10 not in (1, 2)} and civil.columns == columns
    unique = pipeline.keep_one_of_each_group(spark, civil, root)
    texts = {d[0]: d[1] for d in rows}
    groups = brute_components(sorted(set(still)), [brute_fingerprint(texts[i]) for i in sorted(set(still))])
    last = sorted(r.doc_id for r in unique.select("doc_id").collect())
    assert last == sorted(i for i in still if groups[i] == i) and unique.columns == columns
    pieces = pipeline.run(spark, root).collect()
    assert {r.doc_id for r in pieces} == set(last)
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}[i] for i in last)


def test_empty_tables(spark, folder):
    root, _ = folder
    docs = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, root).count() == 0
