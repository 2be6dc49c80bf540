"""Every stage of the pipeline on its own input, and the whole on a small table."""

import zlib

import corpus_pipeline as pipeline
from termloom.llm import quality
from tests.llm.test_ngram_join import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = pipeline.keep_good(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id: r.text for r in good.collect()}
    held = [i for i, q in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(i in kept for i in held if labels[i] == 1) and sum(i in kept for i in held if labels[i] == 0) <= 1
    want = {c for i, _, c in brute(sorted(kept.items()), 5, 4, 5) if i == c}
    left = pipeline.keep_distinct(spark, good, SF)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.select("doc_id").collect()) == sorted(want)
    left = left.persist()
    mixed = pipeline.mix_sources(spark, left, SF)
    rows = mixed.collect()
    assert mixed.columns == docs.columns and {r.doc_id for r in rows} == want
    words = sum(len(r.text.split()) for r in rows) / sum(len(kept[i].split()) for i in want)
    assert 1.4 < words < 1.6
    last = pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in rows) and all(r.n_tokens == len(r.ids) for r in last)


def test_edges(spark, folder):
    texts = ["", None, " ", "same words here in this text", "same words here in this text", "one two three"]
    rows = [(i, t, "en", "s" if i % 2 else None, 1) for i, t in enumerate(texts)] + [(5, "one two three", "en", "s", 1), (None, "no id at all", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    left = pipeline.keep_distinct(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in left) == [(False, 0), (False, 1), (False, 2), (False, 3), (False, 5), (True, None)]
    mixed = pipeline.mix_sources(spark, docs, "").collect()
    assert {r.doc_id for r in mixed} == {r[0] for r in rows}


def test_no_rows(spark, folder):
    none = folder(documents=([], DOCS), labels=([], "doc_id long, quality int, toxic int"))
    assert pipeline.run(spark, none).count() == 0
    assert quality.THRESHOLD == 0.3
