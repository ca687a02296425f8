"""Stages of the pipeline on nulls, shared doc_ids, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = ("__quality", "__text_key", "document_key", "__near", "n_hit", "words")


@pytest.fixture(scope="module")
def rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = "some words of a text that no item holds at all"
    given = [(5, item), (5, clean), (None, item), (None, clean), (7, item), (7, item), (8, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in given], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("x") for c in CLASHING}), item, clean


def test_contaminated_texts_go_whatever_their_ids(spark, rows):
    import corpus_pipeline as p

    docs, _, clean = rows
    kept = p.benchmark_decontamination(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, clean), (None, clean), (8, None), (9, ""), (9, "")], key=str)
    assert p.benchmark_decontamination(spark, docs.limit(0), SF).count() == 0


def test_stages_keep_columns_and_bear_empty_tables(spark, rows):
    import corpus_pipeline as p

    docs, item, _ = rows
    for name, stage in p.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    near = [(r.doc_id, r.text) for r in p.ngram_jaccard_join(spark, docs, SF).collect()]
    assert near.count((7, item)) + near.count((5, item)) == 1 and (None, item) in near
    counts = {(r.doc_id, r.n_tokens) for r in p.token_id_output(spark, docs, SF).collect() if r.doc_id in (8, 9)}
    assert counts == {(8, 1), (9, 1)}
