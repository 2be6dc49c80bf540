"""Queries that do their whole job, held against brute force on small tables."""

import numpy as np
import pytest

from termloom.operators import dictionary, graph, nearby
from termloom.plans import registry

DOCS = "doc_id long, text string"


@pytest.fixture
def folder(spark, tmp_path):
    def make(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def words(i):
    """A word of letters alone."""
    return "term" + "".join(chr(97 + int(d)) for d in f"{i:03}")


def test_all_terms_are_matched(spark, folder):
    # 300 terms, one of them in all 60 documents: more than the short list has, and commoner than it lets in.
    texts = {d: " ".join(["commonest part", *(words(i) for i in range(300) if (i + d) % 10 == 0), *(["mona term rmaa"] if d % 2 else [])]) for d in range(60)}
    sf = folder(documents=([(d, t) for d, t in texts.items()], DOCS))
    own = {d: set(t.split()) for d, t in texts.items()}
    terms = {w for s in own.values() for w in s if len(w) >= 6 and sum(w in x for x in own.values()) >= 5}
    assert len(terms) == 301
    full = sorted((d, w) for d, s in own.items() for w in s & terms)
    part = sorted((d, w, t) for d, s in own.items() for w in s - terms if len(w) >= 4 for t in terms if w in t)
    lists = {w: ",".join(sorted(t for t in terms if w in t)) for _, w, _ in part}
    run = lambda name: registry.QUERIES[name](spark, sf)
    assert rows_of(run("term_full_match")) == full
    assert rows_of(run("term_partial_match")) == part
    assert rows_of(run("partial_lists_last").select("surface", "compounds")) == sorted(lists.items())
    assert rows_of(run("compound_edges").select("target", "source")) == sorted({(w, t) for _, w, t in part})
    assert {r.term for r in run("term_definitions").collect()} == terms


def test_terms_far_into_a_document_are_defined(spark, folder):
    # The term stands 300 words into a document, in its second chunk, or at the chunk's end: never in the first 1500 characters.
    filler = lambda n: " ".join(["filling"] * n)
    rows = [(d, f"{filler(n)}. The zephyrite of {d} is said here. {filler(40)}") for d, n in enumerate([300, 980, 1100, 1700, 2500])]
    got = {r.term: r.definition for r in registry.QUERIES["term_definitions"](spark, folder(documents=(rows, DOCS))).collect()}
    assert got["zephyrite"] == "the zephyrite of 4 is said here"
    assert "" not in got.values()


def test_an_empty_definition_does_not_replace_one(spark, monkeypatch, folder):
    from termloom.operators.models import Extractive

    whole = Extractive._one
    monkeypatch.setattr(registry, "Extractive", type("Silent", (Extractive,), {"_one": lambda self, p: '{"term": "zephyrite", "definition": ""}' if "of 4" in p and "task: define" in p else whole(self, p)}))
    rows = [(d, f"The zephyrite of {d} is here.") for d in range(5)]
    got = {r.term: r.definition for r in registry.QUERIES["term_definitions"](spark, folder(documents=(rows, DOCS))).collect()}
    assert got["zephyrite"] == "the zephyrite of 3 is here"


def test_searches_take_a_table_of_queries(spark, monkeypatch):
    monkeypatch.setattr(nearby, "BLOCK", 16)
    x = np.random.default_rng(0).normal(size=(60, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")
    got = rows_of(nearby.top_k_each(v, v.where("id % 2 = 0").withColumnRenamed("id", "query"), 3).select("query", "rank", "id"))
    assert got == [(q, k + 1, int(i)) for q in range(0, 60, 2) for k, i in enumerate(np.argsort(-(x @ x[q]))[:3])]
    d = spark.createDataFrame([(t, t.upper(), i) for i, t in enumerate(["alpha", "alpine", "beta", "bet", "gamma"])], "term string, definition string, ord int")
    q = spark.createDataFrame([(1, "Beta"), (2, "alpin"), (3, "betta")], "query_id int, query string")
    each = rows_of(dictionary.dict_lookup_each(d, q, 2).select("query_id", "exact_match", "rank", "term"))
    alone = [(i, *r) for i, t in ((1, "Beta"), (2, "alpin"), (3, "betta")) for r in rows_of(dictionary.dict_lookup(d, t, 2).select("exact_match", "rank", "term"))]
    assert each == alone and len(each) == 5


def test_full_query_joins_hits_with_their_graph(spark, folder):
    rows = [(100, "plum pie", "FRUIT", 1), (200, "fig tart", "FRUIT pie", 1), (300, "oak", "WOOD", 1), (1, "plum pi", "", 1)]
    sf = folder(part=(rows, "p_partkey long, p_name string, p_type string, p_size int"))
    got = registry.QUERIES["full_query"](spark, sf).collect()
    exact = {(r.term, r.depth) for r in got if r.query_id == 200 and r.kind == "node"}
    assert exact == {("fig tart", 0), ("fruit", 1), ("pie", 1)} and all(r.exact_match for r in got if r.query_id == 200)
    assert {r.target for r in got if r.query_id == 200 and r.kind == "edge"} == {"fruit", "pie"}
    fuzzy = {r["rank"]: r.seed for r in got if r.query_id == 100}  # "plum pi" has an empty definition
    assert fuzzy[1] == "plum pi" and fuzzy[2] == "plum pie" and len(fuzzy) == 4 and not any(r.exact_match for r in got if r.query_id == 100)


def test_co_layout_numbers_rows_within_partitions(spark):
    registry.with_checkpoints(spark)
    ids = spark.createDataFrame([(i * 7 % 101 * 3,) for i in range(101)], "vec_id long").repartition(5)
    assert rows_of(graph.numbered(ids, "vec_id", "i").select("vec_id", "i")) == [(3 * i, i) for i in range(101)]
    plan = registry.QUERIES["co_layout"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number() windowspecdefinition(_pid" in plan and "row_number() windowspecdefinition(vec_id" not in plan
