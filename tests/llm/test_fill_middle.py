import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import fill_middle
from tests.llm.conftest import same

DOCS = "doc_id long, text string, form string, n long, row long, piece string"
TEXTS = ["", "a", "ab", "<", "<P", "x<S", ">S>M>", "has <P> in it", "<M>", "é\U0001f600 日本語", "é", "a\n b\x00c", "tail <", "tail <S", None]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(doc_id, text):
    t, h = text or "", sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if t == "" or "<P>" in t or "<S>" in t or "<M>" in t or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    p, m, s = "<P>" + t[:a], "<M>" + t[a:b], "<S>" + t[b:]
    return (doc_id, n, "spm", a, b - a, sha(s + p + m), sha(t)) if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, sha(p + s + m), sha(t))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<PSM>ab", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]), st.integers(1, 5), st.integers(1, 4))
def test_parts_of_any_cut(text, a, b, form, chunk, again):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        form, a, b = "plain", len(text), len(text)
    output = "".join(x for _, x in fill_middle.pieces(text, form, a, b, chunk))
    parts, found = fill_middle.Parts(form), []
    for k in range(0, len(output), again):
        found += parts.feed(output[k : k + again])
    found += parts.end()
    assert "".join(x for *_, x in sorted(found)) == text


def rows_():
    rows = [(i * 31 % 1000, t) for i in range(40) for t in TEXTS[i % 15 : i % 15 + 1]]
    rows += [(7000 + i, "long é " * 9000 + str(i)) for i in range(4)] + [(None, "no id"), (None, "no id"), (None, None), (5, "twice"), (5, "twice"), (5, "else")]
    return rows


def test_query(spark, folder, oracle, monkeypatch):
    rows = rows_()
    sf = folder(documents=([(i, t, "psm", 1, 2, "p") for i, t in rows], DOCS))
    want = [brute(*r) for r in rows]
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    names = "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256".split()
    same(fill_middle.op12(spark, sf), names, want)
    for t in ("embeddings", "pages", "labels", "benchmark", "conversations"):
        spark.createDataFrame([(1,)], "x int").write.parquet(f"{sf}/{t}.parquet")
    same(fill_middle.op12(spark, sf), *oracle(fill_middle.ORACLE.replace("FROM documents", "FROM read_parquet('" + sf + "/documents.parquet/*.parquet')"), "/root/testdata/sf0.001"))


def test_outputs_are_whole_texts(spark, folder):
    docs = spark.createDataFrame([(i, t) for i, t in rows_()], "doc_id long, text string")
    got = fill_middle.outputs(docs).collect()
    assert sorted((r.doc_id or -1, r.n, r.form, sha(r.output)) for r in got) == sorted((w[0] or -1, w[1], w[2], w[5]) for w in (brute(*r) for r in rows_()))
    assert all(len(r.output) == r.n + 9 * (r.form != "plain") for r in got)


def test_rows_of_one_id_are_dealt_out_and_none_stay_none(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    spread = fill_middle.output_pieces(docs)
    assert "hashpartitioning(doc_id" in spread._jdf.queryExecution().toString()
    assert fill_middle.digests(fill_middle.restored_pieces(spread)).count() == 400
    assert fill_middle.digests(fill_middle.restored_pieces(fill_middle.output_pieces(docs.where("false")))).count() == 0
