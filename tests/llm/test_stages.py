"""Stages of the pipeline with null ids, repeats, clashing names and empty tables."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _copy string, _id string, _row string, component_id long"


def rows():
    rnd = random.Random(8)
    base = [f"word{rnd.randint(0, 900)}" for _ in range(120)]
    near = base[:60] + ["edited"] + base[61:]
    other = [f"term{rnd.randint(0, 900)}" for _ in range(120)]
    texts = [(5, " ".join(base)), (7, " ".join(base)), (None, " ".join(near)), (9, " ".join(other)), (11, None), (12, ""), (12, "")]
    return [(d, t, "en", "s", len(t or ""), "c", "i", "r", 1) for d, t in texts]


def test_near_copies_go_whatever_their_id(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = corpus_pipeline.keep_one_of_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(kept.select("doc_id").collect()) == [(5,), (9,), (11,), (12,), (12,)]


def test_tokens_of_odd_rows(spark):
    out = corpus_pipeline.tokenize(spark, spark.createDataFrame(rows(), SCHEMA), "")
    assert out.count() == 7


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.keep_one_of_near_copies(spark, none, "").collect() == []
    assert corpus_pipeline.cut_repeated_lines(spark, none, "").collect() == []
    assert corpus_pipeline.tokenize(spark, none, "").collect() == []
