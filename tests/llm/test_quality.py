import zlib

import numpy as np

from termloom.llm import quality

DOCS = "doc_id long, text string, quality int, score double"
LABELS = "doc_id long, quality int, toxic int"


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op9(spark, sf).collect()
    assert len(rows) == 1000 and all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 1]) > 0.98


def test_blocks_give_the_votes_of_all_neighbours():
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcde ,.!|ABC12"), size=rng.integers(30, 200))) for _ in range(120)]
    labels = (np.arange(120) % 3 > 0).astype(int)
    counts = quality.WordCounts.of(texts)
    model = quality.fit(quality.terms(texts), counts, labels)
    x = model.vector(quality.terms(texts), counts)
    for i, got in enumerate(model.score(texts, neighbours=7, block=16)):
        like = x[i] @ model.vectors.T
        near = np.argsort(-like)[:7]
        weight = np.maximum(like[near], 0) ** 4 + 1e-12
        assert abs(got - (weight * labels[near]).sum() / weight.sum()) < 1e-4


def test_edges(spark, folder):
    docs = [(i, f"some words in text {i}. And more of them", 1, 0.5) for i in range(1, 20)] + [(30, None, 0, 0.0), (31, "", 0, 0.0), (None, "no id", 0, 0.0), (33, "A!! " * 30000, 0, 0.0), (1, "again", 0, 0.0), (1, "again", 0, 0.0)]
    labels = [(i, i % 2, 0) for i in range(1, 20)] + [(1, None, 0), (None, 1, 0), (2, 1, 0), (99, 1, 0)]
    got = quality.op9(spark, folder(documents=(docs, DOCS), labels=(labels, LABELS))).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (30, 31)}) == 1


def test_no_labels_and_no_rows(spark, folder):
    sf = folder(documents=([(1, "text", 0, 0.0)], DOCS), labels=([], LABELS))
    assert [(r.score, r.predicted) for r in quality.op9(spark, sf).collect()] == [(0.5, 1)]
    assert quality.scored(spark.createDataFrame([], DOCS), quality.fit(np.zeros((0, quality.N_TERMS)), quality.WordCounts.of([]), np.zeros(0))).count() == 0


def test_words_make_a_latent_space():
    a, b = "apple pear plum fig cherry".split(), "bolt nut screw nail hammer".split()
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(x, 4)) for x in (a, b) * 30]
    counts = quality.WordCounts.of(texts)
    rarity, into = quality.word_axes(counts, 2)
    x = quality._unit(counts.times(counts.weighted(rarity), into))
    like = x @ x.T
    assert like[0, 2::2].min() > 0.9 and abs(like[0, 1::2]).max() < 0.2
    dense = np.zeros((len(texts), quality.WORD_BUCKETS), np.float32)
    dense[counts.text(), counts.bucket] = counts.weighted(rarity)
    assert np.allclose(counts.times(counts.weighted(rarity), into), dense @ into, atol=1e-5)
    assert np.allclose(abs(np.linalg.svd(dense, full_matrices=False)[2][:2] @ into), np.eye(2), atol=1e-2)


def test_ties_go_to_the_first():
    like = np.array([[1.0, 2.0, 2.0, 2.0, 0.0], [3.0, 1.0, 1.0, 1.0, 1.0]])
    assert quality.nearest(like, 2).tolist() == [[1, 2], [0, 1]]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 7.0)], "doc_id long, text string, quality_score double")
    model = quality.fit(np.zeros((0, quality.N_TERMS)), quality.WordCounts.of([]), np.zeros(0))
    assert [tuple(r) for r in quality.scored(docs, model).collect()] == [(1, "a b", 0.5)]
    assert quality.scored(docs, model, "other").columns == [*docs.columns, "other"]
