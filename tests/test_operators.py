import json

import pytest
from pyspark.sql import functions as F

from termloom.operators import chunk, dictionary, graph, layout, match, models, nearby, qa
from termloom.sources import readers, writers
from termloom.streaming import incremental


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_windows(spark):
    frame = spark.createDataFrame([(i, [f"t{k}" for k in range(n)]) for i, n in enumerate((0, 1, 8, 9, 18))], "id int, tokens array<string>")
    got = rows(chunk.token_windows(frame, "tokens", 10, 2), "id", "chunk_id", "start_token", "end_token")
    assert got == [(1, 0, 0, 1), (2, 0, 0, 8), (3, 0, 0, 9), (3, 1, 8, 9), (4, 0, 0, 10), (4, 1, 8, 18), (4, 2, 16, 18)]
    capped = rows(chunk.capped_windows(frame, "tokens", 10, 0, 4), "id", "start_token", "n_tokens")
    assert [x[1:] for x in capped if x[0] == 4] == [(0, 4), (5, 4), (10, 4), (15, 3)]
    for bad in (lambda: chunk.token_windows(frame, "tokens", 5, 5), lambda: chunk.capped_windows(frame, "tokens", 5, 5, 9), lambda: chunk.char_windows(frame, "id", 1, 1)):
        with pytest.raises(ValueError):
            bad()


def test_matching(spark):
    tokens = spark.createDataFrame([(1, "送電", "名詞"), (1, "送電線", "名詞"), (1, "線", "助詞"), (2, "線", "普通名詞"), (2, "送電", "名詞")], "chunk int, surface string, pos string")
    terms = spark.createDataFrame([("送電線",), ("電線",), ("送電線",), ("",)], "word string")
    assert rows(match.full_matches(tokens, terms, ["chunk"]), "chunk", "surface") == [(1, "送電線")]
    want = [(1, "送電", "送電線"), (2, "線", "送電線"), (2, "線", "電線"), (2, "送電", "送電線")]
    assert rows(match.partial_matches(tokens, terms, ["chunk"], "pos"), "chunk", "surface", "compound") == want
    found = match.partial_matches(tokens, terms, ["chunk"], "pos")
    kept = spark.createDataFrame([(2, "線")], "chunk int, term string")
    assert len(rows(match.restrict(found, kept, ["chunk"]), "chunk", "surface")) == 2


def test_dictionary(spark):
    rows_ = spark.createDataFrame([("a", "first", 0, 0), ("a", None, 2, 0), ("a", "last", 1, 1), ("a", "early", 1, 0), ("ABC", "x", 0, 0), ("e", "", 0, 0)], "term string, definition string, chunk int, place int")
    d = dictionary.merge_last(rows_, "term", "definition", "chunk", "place")
    assert rows(d, "term", "definition") == [("ABC", "x"), ("a", "last"), ("e", "")]
    lists = spark.createDataFrame([("s", "x", 0), ("s", "y", 0), ("s", "z", 1)], "surface string, compound string, chunk int")
    assert dictionary.replace_lists(lists, "surface", "compound", "chunk").collect()[0].compounds == ["z"]
    d = d.withColumn("ord", F.length("term"))
    assert dictionary.lookup_exact(d, "ABC").count() == 0 and dictionary.lookup_exact(d, "A").count() == 1
    assert [(r.exact_match, r.term) for r in dictionary.dict_lookup(d, "a").collect()] == [(True, "a")]
    fuzzy = dictionary.dict_lookup(d, "e", 2).orderBy("rank").collect()  # an empty definition isn't an exact hit
    assert [(r.exact_match, r["rank"], r.term, r.similarity) for r in fuzzy] == [(False, 1, "e", 1.0), (False, 2, "a", 0.0)]


def test_edges(spark):
    nodes = spark.createDataFrame([("送電線", "これは電線の一種\nA系B系"), ("これは電線", ""), ("A", "holds b and B"), ("B", "a系"), ("b", "送電線系")], "term string, definition string")
    assert rows(graph.category_edges(nodes), "source", "target") == [("b", "送電線"), ("送電線", "A"), ("送電線", "B"), ("送電線", "これは電線")]
    assert rows(graph.parent_edges(nodes), "source", "target") == [("A", "b"), ("b", "送電線"), ("送電線", "b"), ("送電線", "これは電線")]
    part = spark.createDataFrame([("線", "送電線"), ("線", "none")], "surface string, compound string")
    assert rows(graph.compound_edges(part, nodes), "source", "target", "type", "weight") == [("送電線", "線", "COMPOUND_OF", 1.0)]
    pairs = nearby.similar_pairs(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "id long, embedding array<float>"), 0.75)
    assert [(a, b, round(s, 4)) for a, b, s in rows(pairs, "a", "b", "similarity")] == [(1, 2, 0.8)]
    assert len(rows(graph.similar_edges(pairs), "source", "target")) == 2
    met = graph.cooccurrence(spark.createDataFrame([("b", "An A here"), ("A", "b")], "term string, context string"), nodes.select("term"))
    assert ("A", "b") in rows(met, "a", "b")


def test_walks(spark):
    edges = spark.createDataFrame([("a", "b", "T", 1.0), ("a", "b", "T", 1.0), ("b", "c", "T", 1.0), ("c", "d", "T", 1.0), ("c", "a", "T", 1.0)], "source string, target string, type string, weight double")
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("d", "D")], "term string, definition string")
    n, e = graph.subgraph(nodes, edges, spark.createDataFrame([("a",), ("zz",)], "seed string"))
    assert rows(n, "seed", "term", "depth", "definition") == [("a", "a", 0, "A"), ("a", "b", 1, "B"), ("a", "c", 2, None)]
    assert rows(e, "source", "target") == [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    assert rows(graph.connected(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a int, b int")), "node", "component") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    got = graph.neighbours(spark.createDataFrame([("b",), ("x",)], "id string"), edges, "T", "T").orderBy("id").collect()
    assert [(r.id, r.before, r.related) for r in got] == [("b", ["a"], ["c"]), ("x", [], [])]


MD = "intro\n# not a section\n## One\n| a | b |\n| c | d |\n### Sub\ntext\n\n## Two\n### Sub\n- end\n## "


def test_layout(spark):
    items = layout.items(spark.createDataFrame([(1, MD)], "doc int, markdown string"))
    got = rows(items, "pos", "type", "level", "text", "section", "section_name", "subsection", "subsection_name")
    assert got[0][1:] == ("text", None, "intro", 0, "", 0, "") and got[1][3] == "# not a section" and got[2][1:] == ("heading", 1, "One", 1, "One", 0, "")
    assert got[5][3:] == ("Sub", 1, "One", 1, "Sub") and got[-1][1:5] == ("text", None, "##", 2)
    assert [r for r in got if r[4] == 2 and r[6] == 1][0][7] == "Sub"
    paged = items.withColumn("page", F.when(F.col("pos") < 6, 1).otherwise(2))
    blocks = layout.blocks(paged)
    content = {(r.page, r.section, r.subsection): r.content for r in blocks.collect()}
    assert content[1, 1, 0] == "# One\n\n| a | b |\n| c | d |" and content[2, 2, 1].startswith("## Sub\n\n- end")
    ordered = layout.ordered_blocks(blocks)
    simple = layout.render_simple(ordered).collect()[0].markdown
    assert simple.startswith("# Document Content\n\nPage 1\n\n---\nintro\n\n# not a section\n\n\n") and simple.count("Page ") == 2
    toc = layout.render_toc(ordered).collect()[0].markdown
    assert "- [1. One](#one) (Page 1)\n  - [1.1. Sub](#sub) (Page 1)\n- [2. Two](#two) (Page 2)\n  - [2.1. Sub](#sub) (Page 2)\n\n---\n" in toc
    assert layout.render_all(ordered).count() == 4


def test_alignment_walks_round_and_never_back(spark):
    pages = spark.createDataFrame([(1, 1, "alpha beta gamma"), (1, 2, "delta epsilon"), (1, 3, "zeta eta theta")], "doc int, page int, text string")
    texts = ["delta epsilon", "alpha beta gamma", "nowhere to be found at all", "---", "zeta eta", "delta epsilon"]
    items = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, pos int, text string")
    assert rows(layout.align(items, pages), "pos", "page") == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3), (5, 3)]
    with pytest.raises(Exception, match="no pages"):
        layout.align(items, pages.where("doc = 9")).collect()


def test_headings_of_a_list(spark):
    lines = [(1, 1, "Intro text"), (1, 2, "1. Overview"), (2, 3, "more"), (2, 4, "words"), (2, 5, " 1.1  details "), (3, 6, "last"), (3, 7, "2 Summary of all thinsg"), (3, 8, "end")]
    frame = spark.createDataFrame([(1, pos, page, t) for page, pos, t in lines], "doc int, pos int, page int, text string")
    heads = spark.createDataFrame([(1, 0, "1. overview", 1, 1, "Overview"), (1, 1, "1.1 Details", 2, 1, ""), (1, 2, "2 Summary of all things", 1, 2, "Summary")], "doc int, ord int, name string, level int, section int, section_name string")
    resolved = layout.resolve_headings(frame, heads)
    assert [(p, o) for p, o in rows(resolved, "pos", "ord") if o is not None] == [(2, 0), (5, 1), (7, 2)]
    items = layout.paragraphs(resolved)
    assert rows(items, "pos", "page", "type", "content", "section", "subsection") == [(1, 1, "text", "Intro text", 0, 0), (2, 1, "heading", "1. Overview", 1, 0), (3, 2, "text", "more words", 1, 0), (5, 2, "heading", "1.1  details", 1, 1), (6, 3, "text", "last", 1, 1), (7, 3, "heading", "2 Summary of all thinsg", 2, 0), (8, 3, "text", "end", 2, 0)]
    assert rows(layout.page_blocks(items), "page", "block", "content")[-1] == (3, 2, "2 Summary of all thinsg\n\nend")


def test_footers(spark):
    lines = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False), (1, 3, True)], "doc int, pos int, is_footer boolean")
    assert [p for _, p in rows(layout.footer_pages(lines), "pos", "page")] == [1, 2, 2, 3]
    foot = lambda *x: rows(layout.common_footer(spark.createDataFrame([(t, i) for i, t in enumerate(x)], "footer string, pos int")), "footer", "n")
    assert foot("a", "b", "", "") == [("a", 1)] and foot("b", "a", "a", "b", "c") == [] and foot("", "") == []


def test_models_and_rows(spark):
    assert models.get_tokenizer("Words")().tokenize("a b") == [("a", "名詞"), ("b", "名詞")]
    with pytest.raises(ValueError):
        models.get_tokenizer("other")
    assert models.lattice_tokens("送電\t名詞,一般\nbad\n線\t,\nEOS") == [("送電", "名詞"), ("線", "UNKNOWN")]
    replies = spark.createDataFrame([('{"terms": ["a"]}',), ("not json",), ('{"terms": ',), ('{"other": 1}',)], "r string")
    assert [r.x for r in replies.select(models.parsed_terms(F.col("r")).alias("x")).collect()] == [["a"], [], [], []]

    class Broken:
        def complete(self, prompts):
            if len(prompts) > 1 or prompts[0] == "bad":
                raise RuntimeError("no")
            return ["ok"]

    asked = models.complete(spark.createDataFrame([("good",), ("bad",)], "p string").coalesce(1), "p", "r", Broken)
    assert rows(asked, "p", "r") == [("bad", ""), ("good", "ok")]
    text = " ".join(f"w{i}" for i in range(620))
    got = qa.qa_rows(spark.createDataFrame([("t", text), ("short", "a b")], "title string, content string")).orderBy("chunk_index").collect()
    assert [(r.source_article, r.chunk_index, r.question) for r in got] == [("t", 0, "What is said about w0?"), ("t", 1, "What is said about w400?")]
    assert all(r.context.endswith("...") and r.answer.startswith("w") for r in got)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md/1.md").write_text("# 題 #\n本文　")
    (tmp_path / "md/x.txt").write_text("no")
    assert rows(readers.articles(spark, str(tmp_path / "md")), "title", "content", "filename") == [("題", "本文", "1.md")]
    put = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value)) and str(tmp_path / name)
    assert rows(readers.terms(spark, put("a.json", {"unknown_words": [{"word": "x"}, {"n": 1}, {"word": "x"}]})), "word") == [("x",)]
    n, e = readers.graph(spark, put("n.json", {"a": {"definition": "d"}}), put("e.json", {"a": [{"target": "b", "type": "T", "weight": 0.5}]}))
    assert rows(n, "term", "definition") == [("a", "d")] and rows(e, "source", "target", "type", "weight") == [("a", "b", "T", 0.5)]
    writers.graph(n, e, None, str(tmp_path / "g"))
    assert rows(spark.read.parquet(str(tmp_path / "g/edges")), "source", "type") == [("a", "T")]
    ml = '<graphml><key id="d0" for="node" attr.name="entity_type"/><key id="d1" for="node" attr.name="description"/><key id="d2" for="node" attr.name="source_id"/><key id="d3" for="node" attr.name="clusters"/><key id="d4" for="edge" attr.name="weight"/><key id="d5" for="edge" attr.name="description"/><key id="d6" for="edge" attr.name="source_id"/><key id="d7" for="edge" attr.name="order"/><graph><node id="A"><data key="d0">X</data><data key="d1">p&lt;SEP&gt;q</data><data key="d2">s</data></node><node id="B"><data key="d0">Y</data><data key="d1">p</data><data key="d2">s</data><data key="d3">[{"level": 0, "cluster": 2}]</data></node><edge source="A" target="B"><data key="d4">2.0</data><data key="d5">e</data><data key="d6">s</data><data key="d7">1</data></edge></graph></graphml>'
    nodes, edges = readers.graphml(spark, put("g.graphml", ml))
    got = {r.id: r for r in nodes.collect()}
    assert got["A"].description == ["p", "q"] and got["B"].clusters[0].cluster == 2 and edges.collect()[0].weight == 2.0
    qa_df = spark.createDataFrame([("t", 'say "x"')], "source_article string, question string")
    writers.qa_csv(qa_df, str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfsource_article")
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c")], "id int, v string")
    assert rows(writers.upsert_nodes(old, new), "id", "v") == [(1, "a"), (2, "c")]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "term string, definition string, n int"
    path = str(tmp_path / "dictionary")
    for k, batch in enumerate([[("a", "1", 0), ("b", "1", 0)], [("a", "2", 1)]]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(source)
        query = incremental.dictionary_sink(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "log"), "n")
        assert query.awaitTermination(60)
    assert rows(spark.read.parquet(f"{path}/version={k}"), "term", "definition") == [("a", "2"), ("b", "1")]
