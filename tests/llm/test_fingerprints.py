import hashlib
import re
from collections import Counter

from termloom.llm import fingerprints

DOCS = "doc_id long, text string, sample string, _h string"


def jaccard(a, b):
    a, b = (Counter(x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x) for t in (a, b))
    both = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in both) / sum(max(a[w], b[w]) for w in both)


def test_collisions_follow_generalised_jaccard(spark):
    base = [f"w{i % 40}" for i in range(200)]
    texts = {k: " ".join(base[: 200 - k] + [f"x{i}" for i in range(k)]) for k in (0, 20, 60, 120)}
    frame = spark.createDataFrame(list(texts.items()), "k int, text string")
    got = {r.k: r["sample"] for r in fingerprints.signatures(frame, ["k"], "text", samples=256).collect()}
    for k, t in texts.items():
        rate = sum(a == b for a, b in zip(got[0], got[k], strict=True)) / 256
        assert abs(rate - jaccard(texts[0], t)) < 0.12


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = {}
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        out[doc_id] = (len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest())
    return out


def test_query_edges(spark, folder):
    rows = [(1, "The quick é\U0001f600 fox", "s", "h"), (5, None, "s", "h"), (3, "a b c d " * 3000, "s", "h"), (9, "the quick é\U0001f600 fox", "s", None), (None, "last one of them", "s", "h"), (7, " \n ", "s", "h")]
    got = {r.doc_id: r for r in fingerprints.op4(spark, folder(documents=(rows, DOCS))).collect()}
    assert {k: (r.n_chars, r.edited_sha256) for k, r in got.items()} == expected(rows)
    assert got[1].fingerprint == got[9].fingerprint and got[5].fingerprint == got[7].fingerprint
    assert got[7].near_next == 1.0 and got[9].near_next == 0.0 and 0 <= got[3].near_edited <= 1


def test_repeated_rows_and_no_rows(spark, folder, tmp_path):
    assert fingerprints.op4(spark, folder(documents=([], DOCS))).count() == 0
    (tmp_path / "more").mkdir()
    spark.createDataFrame([(1, "a b", "", ""), (1, "a b", "", "")], DOCS).write.parquet(f"{tmp_path}/more/documents.parquet")
    got = fingerprints.op4(spark, f"{tmp_path}/more").collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].near_next == 1.0


def test_likenesses_of_the_query_follow_exact_similarities(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    order = sorted(rows, reverse=True)
    got = {r.doc_id: r for r in fingerprints.op4(spark, sf).collect()}
    off = []
    for i, (doc_id, text) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(text) // 2
        if text.split() and after.split():
            for other, like in ((text[: len(text) - half] + after[:half], got[doc_id].near_edited), (after, got[doc_id].near_next)):
                off.append(like - (exact := jaccard(text, other)))
                assert like == 1.0 or exact < 1.0
    assert len(off) > 300 and abs(sum(off) / len(off)) < 0.02 and sum(x * x for x in off) / len(off) < 0.01 and max(map(abs, off)) < 0.4
