import random
import zlib
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from termloom.llm import toxicity
from termloom.llm.common import span_hashes

DOCS = "doc_id long, text string, score double, features string"
LABELS = "doc_id long, quality int, toxic int"


def words_of(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if "a" <= c <= "z" or ord(c) > 127:
            word += c
        elif word:
            out.append(word.encode())
            word = ""
    return out


def test_terms_are_words_and_their_beginnings():
    texts = ["Über-all the  Trash!", "", None, "a1b", "trashcan ÉÉ"]
    of, bucket = toxicity.terms(texts)
    assert [int((of == k).sum()) for k in range(5)] == [sum(1 + sum(len(w) > k for k in toxicity.BEGINNINGS) for w in words_of(t)) for t in texts]
    own = {k: set(bucket[of == k].tolist()) for k in range(5)}
    assert len(own[0] & own[4]) == 2  # tra and tras; trash is a word in the one and a beginning in the other
    raw = np.frombuffer(b"trash", np.uint8)
    word = span_hashes(raw, np.array([0]), np.array([5]))[0] >> np.uint64(64 - toxicity.BITS)
    assert int(word) in own[0] and int(word) not in own[4]


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    slot = np.full(1 << toxicity.BITS, -1, np.int32)
    texts = ["ab cd ef", "ab ab", "", "zz", "cd ef gh ab"]
    bucket = np.unique(toxicity.terms(["ab cd ef gh"])[1])
    slot[bucket] = np.arange(len(bucket))
    m = toxicity.Machine(slot, -0.3, rng.normal(size=len(bucket)), rng.normal(size=(len(bucket), 3)))
    for text, got in zip(texts, m.score(texts), strict=True):
        own = sorted({int(slot[b]) for b in toxicity.terms([text])[1]} - {-1})
        x = -0.3 + sum(m.weights[i] for i in own) + sum(m.latent[i] @ m.latent[j] for i, j in combinations(own, 2))
        assert abs(got - 1 / (1 + np.exp(-x))) < 1e-12


def corpus(n, seed=3):
    """Toxic is an insult with a mention of its own group, which weights of single words can't tell: either is as common without."""
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        a, b = rng.randrange(2), rng.randrange(2)
        filler = " ".join(rng.choice("lorem ipsum dolor sit amet vita nova terra luna".split()) for _ in range(rng.randrange(3, 40)))
        docs.append((i, f"{('insultone', 'insulttwo')[a]} {filler} {('groupred', 'groupblue')[b]}.", 0.5, "f"))
        labels.append((i, 1, int(a == b)))
    return docs, labels


def test_pairs_are_learnt(spark):
    docs, labels = corpus(1500)
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    machine = toxicity.learn(d.select("doc_id", "text"), y, evidence=0.0)
    truth, texts = np.array([t for *_, t in labels]), [t for _, t, *_ in docs]
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in docs])
    right = (machine.score(texts) >= 0.5) == truth
    assert right[held].mean() > 0.98
    linear = toxicity.Machine(machine.slot, machine.bias, machine.weights, machine.latent * 0)
    assert ((linear.score(texts) >= 0.5) == truth)[held].mean() < 0.8


def test_query(spark, folder):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice("der die das of the sol luna mar casa").strip() + str(rng.randrange(50)) + rng.choice(" ab cd ef gh".split()) for _ in range(rng.randrange(5, 60)))
    docs, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        docs.append((i, filler() + (f" vile{rng.choice(['on', 'ish', 'um', 'or'])} " if bad else " ") + filler(), 0.1, "x"))
        if i < 800:
            labels.append((i, None, int(bad)))
    docs += [(1000, None, 0.1, "x"), (1001, "", 0.1, "x"), (None, "a vileness", 0.1, "x"), (1, docs[1][1], 0.1, "x"), (1002, "word " * 60_000 + "vileque", 0.1, "x")]
    labels += [(None, 1, 1), (5, 1, None), (6, 1, 1), (6, 1, 0)]
    sf = folder(documents=(docs, DOCS), labels=(labels, LABELS))
    got = toxicity.op11(spark, sf).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == (i % 6 == 0) for i in range(900)) and by[1002].predicted == 1 and by[None].predicted == 1
    assert by[1000].score == by[1001].score < 0.5
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_labels_of_held_out_rows_and_other_tables_play_no_part(spark, folder, tmp_path):
    docs, labels = corpus(300, 4)
    one = folder(documents=(docs, DOCS), labels=(labels, LABELS))
    other = f"{tmp_path}/other"
    spark.read.parquet(f"{one}/documents.parquet").write.parquet(f"{other}/documents.parquet")
    swapped = F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int")
    spark.read.parquet(f"{one}/labels.parquet").withColumn("toxic", swapped).write.parquet(f"{other}/labels.parquet")
    scores = [sorted((r.doc_id, r.score) for r in toxicity.op11(spark, sf).collect()) for sf in (one, other)]
    assert scores[0] == scores[1]


def test_no_rows_and_no_labels(spark, folder, tmp_path):
    sf = folder(documents=([(1, "text", 0.1, "x")], DOCS), labels=([], LABELS))
    assert [(r.score, r.predicted) for r in toxicity.op11(spark, sf).collect()] == [(0.0, 0)]
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0)], LABELS).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert toxicity.op11(spark, f"{tmp_path}/none").count() == 0
