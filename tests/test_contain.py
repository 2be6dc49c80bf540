"""Containment by words, captures and page starts, held against brute force."""

import random
import re
import time
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions.similarity import gestalt_ratio, letters_bound
from termloom.operators import contain, dictionary, graph, layout, match
from termloom.operators.contain import Automaton, containing
from termloom.plans import registry


WORDS = st.text(alphabet="ab日\U0001f600 ", min_size=1, max_size=6)


@settings(max_examples=200, deadline=None)
@given(st.sets(WORDS, max_size=20), st.lists(st.text(alphabet="ab日\U0001f600 c", max_size=40), max_size=8), st.integers(1, 9))
def test_automaton_finds_every_pair_once(needles, texts, stretch):
    contain.STRETCH, whole = stretch, contain.STRETCH
    try:
        needles = sorted(needles)
        text, needle = Automaton(needles).find(texts)
    finally:
        contain.STRETCH = whole
    assert list(zip(text.tolist(), needle.tolist(), strict=True)) == [(i, k) for i, t in enumerate(texts) for k, n in enumerate(needles) if n in t]


def test_long_words_take_time_in_proportion():
    needles = [*(f"a{'b' * k}" for k in range(200)), "x" * 20_000]
    automaton, took = Automaton(needles), []
    for n in (60_000, 240_000):
        text = "ab" * (n // 2 - 10_000) + "x" * 20_000
        began = time.perf_counter()
        _, found = automaton.find([text])
        took.append(time.perf_counter() - began)
        assert sorted(needles[k] for k in found) == sorted(n for n in needles if n in text)
    assert took[1] < 16 * took[0] + 1


@pytest.mark.parametrize("shard_chars", [1, 30, 1 << 20])
def test_unspaced_texts_past_every_shard(spark, shard_chars):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("データ解析の学習") for _ in range(n))
    texts = [(i, text(rng.randrange(0, 40))) for i in range(40)] + [(40, text(60_000)), (41, None)]
    needles = sorted({text(k) for k in (1, 2, 3, 4, 5) for _ in range(15)})
    frame, asked = spark.createDataFrame(texts, "id int, text string").repartition(3), spark.createDataFrame([(n,) for n in needles] + [(None,), ("",)], "needle string")
    got = containing(frame, ["id"], asked, with_text=False, shard_chars=shard_chars)
    assert sorted(map(tuple, got.collect())) == sorted((i, n) for i, t in texts if t for n in needles if n in t)


def test_lists_of_parts_are_those_of_the_pairs(spark):
    tokens = spark.createDataFrame([(1, "a"), (1, "ab"), (2, "a"), (2, "zz"), (2, "abc"), (3, "")], "id int, surface string")
    terms = spark.createDataFrame([("abc",), ("bab",), ("",), (None,)], "word string")
    lists = {(r.id, r.surface): r.compounds for r in match.partial_lists(tokens, terms, ["id"]).collect()}
    assert lists == {(1, "a"): ["abc", "bab"], (1, "ab"): ["abc", "bab"], (2, "a"): ["abc", "bab"]}
    pairs = {(r.id, r.surface, r.compound) for r in match.partial_matches(tokens, terms, ["id"]).collect()}
    assert pairs == {(*k, c) for k, cs in lists.items() for c in cs}


def test_containing_against_every_pair(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(0, 4)))
    texts = [(i, rng.choice([" ", ""]) + " ".join(word() for _ in range(rng.randrange(0, 9)))) for i in range(80)] + [(80, None), (81, ""), (0, "a b"), (0, "a b")]
    needles = sorted({t[a : a + n] for _, t in texts if t for a in range(len(t)) for n in (1, 2, 3, 5, 8)}) + ["", "zz", "b  a", "  "]
    frame, asked = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(n,) for n in needles] * 2, "needle string")
    want = sorted((i, t, n) for i, t in texts for n in set(needles) if t is not None and n and n in t)
    assert sorted(map(tuple, containing(frame, ["id"], asked).collect())) == want
    alone = sorted({(t, n) for _, t, n in want})
    assert sorted(map(tuple, containing(frame.select("text"), [], asked).collect())) == alone
    assert containing(frame, ["id"], asked.where("false")).count() == 0


def test_captures_are_those_of_the_pattern(spark):
    rng = random.Random(4)
    texts = ["", "tion", "tiontion", "tiontiontion", "a tion b\ntion", "nationtion \r\nx"] + ["".join(rng.choice(["tion", "a", " ", "\n", "ti"]) for _ in range(rng.randrange(12))) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in frame.select("i", graph.captures(frame["t"], "tion").alias("c")).collect()}
    assert got == {i: re.findall("([^\n]+?)tion", t) for i, t in enumerate(texts)}


def test_items_before_the_first_hit_lie_on_the_first_page(spark):
    docs = spark.createDataFrame([("d", "nowhere at all to be found here\nthe words of page three are these\nnothing of this is there either\n")], "doc string, markdown string")
    pages = spark.createDataFrame([("d", 2, "some other thing"), ("d", 3, "the words of page three are these")], "doc string, page int, text string")
    assert [r.page for r in layout.align(layout.items(docs), pages).orderBy("pos").collect()] == [2, 3, 3]
    assert [(r.page, r.content) for r in layout.extract(docs, pages).orderBy("block").collect()][0] == (2, "nowhere at all to be found here")


def test_fuzzy_search_leaves_nothing_out(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcd é") for _ in range(rng.randrange(0, 9)))
    terms = sorted({word() for _ in range(150)})
    d = spark.createDataFrame([(t, t.upper(), i) for i, t in enumerate(terms)], "term string, definition string, ord int")
    q = spark.createDataFrame([(i, word().upper()) for i in range(12)], "query_id int, query string")
    pairs = d.crossJoin(q).select("query_id", "ord", gestalt_ratio(F.lower("query"), "term").alias("ratio"), letters_bound(F.lower("query"), F.col("term")).alias("bound")).collect()
    assert all(r.ratio <= r.bound + 1e-9 for r in pairs)
    want = [(i, k + 1, r.ord) for i in range(12) for k, r in enumerate(sorted((r for r in pairs if r.query_id == i), key=lambda r: (-r.ratio, r.ord))[:4])]
    got = dictionary.fuzzy_each(d, q, 4).join(d.select("term", "ord"), "term").select("query_id", "rank", "ord").collect()
    assert sorted(map(tuple, got)) == want


def exhaustive(terms, queries, n):
    """(query, rank, ord, ratio) by comparing every pair."""
    ratio = lambda a, b: SequenceMatcher(None, a.lower(), b).ratio()
    out = []
    for q, text in queries:
        best = sorted((-ratio(text, t), o) for o, t in terms)[:n]
        out += [(q, k + 1, o, round(-r, 9)) for k, (r, o) in enumerate(best)]
    return sorted(out)


def ranked(df):
    return sorted((r.query_id, r["rank"], r.ord, round(r.similarity, 9)) for r in df.collect())


@pytest.mark.parametrize("n", [1, 4, 10])
def test_index_gives_the_exhaustive_ranking(spark, n):
    rng = random.Random(n)
    word = lambda: "".join(rng.choice("abcdeé 語") for _ in range(rng.randrange(0, 14)))
    terms = [(i, t) for i, t in enumerate(sorted({word() for _ in range(200)}, key=lambda _: rng.random()))]
    queries = [(i, rng.choice(terms)[1][1:].upper() + rng.choice(["", "b", "zz"])) for i in range(25)] + [(30, ""), (31, "qqq"), (32, "x")]
    d, q = spark.createDataFrame(terms, "ord long, term string"), spark.createDataFrame(queries, "query_id int, query string")
    assert ranked(dictionary.fuzzy_ranked(d, q, n)) == exhaustive(terms, queries, n)
    assert ranked(dictionary.fuzzy_exhaustive(d, q, n)) == exhaustive(terms, queries, n)


def test_parts_are_ranked_as_by_all_pairs_and_few_are_compared(spark):
    d, q = registry.ordered_nodes(spark, "/root/testdata/sf0.001"), registry.name_queries(spark, "/root/testdata/sf0.001")
    terms, queries = [(r.ord, r.term) for r in d.collect()], [(r.query_id, r.query) for r in q.collect()]
    assert ranked(dictionary.fuzzy_ranked(d.select("ord", "term"), q, 10)) == exhaustive(terms, queries, 10)
    asked = dictionary.first_guesses(d.select("ord", "term"), q, 10)
    met = dictionary.candidates(d.select("ord", "term"), asked).count()
    assert asked.count() == len(queries) and met < len(terms) * len(queries)


def test_order_is_where_a_term_first_came(spark):
    rows = spark.createDataFrame([("b", "1", 3), ("a", "2", 5), ("b", "4", 9), ("c", None, 1), ("c", "5", 7)], "term string, definition string, at long")
    assert sorted(map(tuple, dictionary.merge_ordered(rows, "term", "definition", "at").collect())) == [("a", "2", 5), ("b", "4", 3), ("c", "5", 7)]
