"""Readers and writers: what is written is what is read."""

import csv
import json
import os

from termloom.sources import readers, writers


def files(folder, end=""):
    return sorted(x for x in os.listdir(folder) if x.startswith("part-") and x.endswith(end))


def lines(folder):
    return [json.loads(x) for f in files(folder, ".json") for x in open(f"{folder}/{f}", encoding="utf-8")]


def put(path, text, mode="w"):
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8", "newline": ""})) as f:
        f.write(text)
    return str(path)


def test_texts_and_markdown(spark, tmp_path):
    assert [r.text for r in readers.text_file(spark, put(tmp_path / "a.txt", "é\n\nb")).collect()] == ["é\n\nb"]
    folder = tmp_path / "md"
    folder.mkdir()
    (folder / "below").mkdir()
    for name, text in (("a.md", "# Title one\nbody\n"), ("b.md", "\n"), ("empty.md", ""), ("c.md", "## only"), ("d.txt", "# not"), ("e.md", "x\r\ny"), ("below/f.md", "# below")):
        put(folder / name, text)
    put(folder / "bad.md", b"# caf\xe9\nno utf-8", "wb")
    got = {r.filename: (r.title, r.content) for r in readers.articles(spark, str(folder)).collect()}
    assert got == {"a.md": ("Title one", "body"), "b.md": ("", ""), "c.md": ("only", ""), "e.md": ("x", "y")}
    assert [tuple(r) for r in readers.unreadable_files(spark, str(folder)).collect()] == [("bad.md", 15)]


def test_maps_and_lists_of_json(spark, tmp_path):
    terms = put(tmp_path / "t.json", json.dumps({"unknown_words": [{"word": "語"}, {"word": "b"}, {"word": "b"}, {"word": None}, {"n": 1}]}, indent=1))
    assert sorted(r.word for r in readers.terms(spark, terms).collect()) == ["b", "語"]
    entries = {"a": "of a", "語": "", "c": None}
    path = put(tmp_path / "d.json", json.dumps(entries, ensure_ascii=False))
    assert {r.term: r.definition for r in readers.dictionary(spark, path).collect()} == entries
    path = put(tmp_path / "c.json", json.dumps({"a": ["one", "two"], "b": []}))
    assert sorted(map(tuple, readers.contexts(spark, path).collect())) == [("a", "one"), ("a", "two")]
    path = put(tmp_path / "e.json", json.dumps({"a": [1, 0.5], "b": [0.0, 2]}))
    assert sorted((r.term, tuple(r.embedding)) for r in readers.embeddings(spark, path).collect()) == [("a", (1.0, 0.5)), ("b", (0.0, 2.0))]


def test_graph_without_edges_and_blocks(spark, tmp_path):
    n, e = readers.graph(spark, put(tmp_path / "n.json", json.dumps({"a": {"definition": "x"}, "b": {}})))
    assert {r.term: r.definition for r in n.collect()} == {"a": "x", "b": None} and e.count() == 0
    own = [{"page": 1, "section": 2, "section_name": "s", "subsection": 0, "subsection_name": "", "content": "c"}, {"page": 3}]
    got = readers.blocks(spark, put(tmp_path / "doc.json", json.dumps(own))).collect()
    assert [(r.doc, r.block, r.page, r.content) for r in got] == [("doc.json", 0, 1, "c"), ("doc.json", 1, 3, None)]


def test_page_texts(spark):
    pages = spark.createDataFrame([("d", 1, " a\n \n\n\nb \n"), ("d", 2, None), ("d", 3, " \n"), ("d", 4, "c")], "doc string, page int, text string")
    assert sorted(map(tuple, readers.page_texts(pages).collect())) == [("d", 1, "a\n\nb"), ("d", 4, "c")]


def test_dictionary_terms_and_metadata(spark, tmp_path):
    d = spark.createDataFrame([("a", "x", 1), ("b", None, 2)], "term string, definition string, n int")
    writers.dictionary(d, str(tmp_path / "d"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "d")).collect())) == [("a", "x"), ("b", None)]
    writers.terms_json(d, str(tmp_path / "t"))
    assert sorted(r["term"] for r in lines(tmp_path / "t")) == ["a", "b"]
    writers.metadata(d, "words", d.limit(1), str(tmp_path / "m"), nodes=d, edges=d.where("false"))
    assert lines(tmp_path / "m") == [{"tokenizer": "words", "total_terms": 2, "technical_terms_loaded": 1, "total_nodes": 2, "total_edges": 0}]


def test_exports(spark, tmp_path):
    rows = [("a \"quoted\", one", "two\nlines"), ("é", "語")]
    df = spark.createDataFrame(rows, "question string, answer string").repartition(2)
    for one_file in (False, True):
        writers.qa_csv(df, folder := str(tmp_path / f"csv{one_file}"), one_file)
        parts = [open(f"{folder}/{x}", encoding="utf-8", newline="").read() for x in files(folder, ".csv")]
        assert all(p.startswith("﻿") == one_file for p in parts) and (len(parts) == 1 or not one_file)
        got = [tuple(r) for p in parts for r in list(csv.reader(p.removeprefix("﻿").splitlines(keepends=True)))[1:]]
        assert sorted(got) == sorted(rows)
    writers.blocks_json(df, str(tmp_path / "b"))
    assert sorted((r["question"], r["answer"]) for r in lines(tmp_path / "b")) == sorted(rows)
    writers.markdown(spark.createDataFrame([("d", "# x\n", 1)], "doc string, markdown string, n int"), str(tmp_path / "k"))
    assert lines(tmp_path / "k") == [{"doc": "d", "markdown": "# x\n"}]


def test_nodes_are_renewed_by_id(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, kind string")
    new = spark.createDataFrame([(2, "bb"), (3, "c")], "id int, name string")
    assert sorted(map(tuple, writers.upsert_nodes(old, new).collect())) == [(1, "a", "x"), (2, "bb", "y"), (3, "c", None)]
