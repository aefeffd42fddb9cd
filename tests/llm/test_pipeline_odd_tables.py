"""The pipeline's stages on null, empty, repeated and clashing input, and run() as a whole."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from helio.session import scratch_path

CLASH = "_t long, h long, key string, kept boolean, _lost long, n long, component_id long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
BENCH = "the quick brown fox jumps over the lazy dog again today"


def rows():
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(300)]
    base = " ".join(rng.choices(vocab, k=80))
    out = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n ", "en", None),
           (None, base, "en", "a"), (None, None, None, None),
           (4, base, "en", "b"), (5, base, "en", "b"), (5, base, "en", "b"),
           (6, base + " edit", "en", "b"), (7, "before " + BENCH + " after", "en", "a"),
           (8, " ".join(rng.choices(vocab, k=50_000)), "en", "c")]
    out += [(i, " ".join(rng.choices(vocab, k=40)), "de", rng.choice("abc"))
            for i in range(10, 30)]
    return [(*r, len(r[1] or ""), 1, 2, "k", True, 5, 6, 7) for r in out]


@pytest.fixture(scope="module")
def folder(spark):
    at = scratch_path(spark, "odd-pipeline")
    spark.createDataFrame(rows(), DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1 if i != 3 else None, 0) for i in range(1, 30)],
                          "doc_id long, quality int, toxic int").write.parquet(
        f"{at}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, None), (None, "")],
                          "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = kept(docs)
    quality, copies, bench, mix, tokens = (f for _, f in corpus_pipeline.STAGES)
    assert quality(spark, docs, folder).columns == docs.columns
    one = copies(spark, docs, folder)
    got = kept(one)
    base = next(t for (i, t) in every if i == 4)
    assert one.columns == docs.columns
    assert every - got == Counter({(5, base): 2, (6, base + " edit"): 1})
    clean = bench(spark, docs, folder)
    assert clean.columns == docs.columns
    assert [i for (i, _) in every - kept(clean)] == [7]
    mixed = mix(spark, docs, folder)
    assert mixed.columns == docs.columns and set(kept(mixed)) <= set(every)
    assert Counter(r.doc_id for r in tokens(spark, docs, folder).collect()) == Counter(
        r[0] for r in rows())


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == [], name


def test_run_on_odd_rows(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert ids <= {r[0] for r in rows()} and not ids & {5, 6, 7} and 8 in ids
    assert sorted(r.start for r in got)[0] == 0
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
