"""Tokens by the longest piece."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.operators import qa, subword


def tokens(text, pieces):
    """By trying the pieces at each place."""
    out, at = [], 0
    while at < len(text):
        n = max((len(p) for p in pieces if p and text.startswith(p, at)), default=1)
        out.append(text[at : at + n])
        at += n
    return out


ALPHABET = "ab語 \U0001f600"


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(alphabet=ALPHABET, max_size=5), max_size=12), st.lists(st.text(alphabet=ALPHABET + "z", max_size=30), max_size=6))
def test_tokens_are_the_longest_pieces(pieces, texts):
    found = subword.Pieces(sorted(pieces)).starts(texts)
    for text, starts in zip(texts, found, strict=True):
        edge = [*starts.tolist(), len(text)]
        assert [text[a:b] for a, b in zip(edge, edge[1:], strict=False)] == tokens(text, pieces)


def test_windows_are_cut_at_tokens(spark):
    pieces = {"ab", "abc", "c", "日本", " ", "de"}
    texts = [(1, "abcdeab 日本語ab"), (2, ""), (3, None), (4, "zzz"), (5, "abc" * 40)]
    df = spark.createDataFrame(texts, "id int, body string")
    got = sorted(map(tuple, subword.token_windows(df, "body", subword.Pieces(sorted(pieces)), 5, 2).collect()))
    want = []
    for i, t in texts:
        own = tokens(t or "", pieces)
        for k, first in enumerate(range(0, len(own), 3)):
            last = min(first + 5, len(own))
            want.append((i, k, first, last, len("".join(own[:first])), len("".join(own[:last])), "".join(own[first:last])))
    assert got == sorted(want)
    with pytest.raises(ValueError, match="advance"):
        subword.token_windows(df, "body", subword.Pieces([]), 2, 2)


def test_budget_counts_the_same_tokens(spark):
    pieces = subword.Pieces.of(spark.createDataFrame([("ab",), ("c",), (None,), ("",), ("ab",)], "token string"))
    df = spark.createDataFrame([(1, "abab"), (2, "ababab"), (3, ""), (4, None), (5, "xyz")], "id int, prompt string")
    count = subword.n_tokens(pieces)
    assert {r.id: r.n for r in df.select("id", count("prompt").alias("n")).collect()} == {1: 2, 2: 3, 3: 0, 4: None, 5: 3}
    assert {r.id for r in subword.gated_prompts(df, "prompt", pieces, 3, "c").collect()} == {1, 3}
    assert {r.id for r in df.where(qa.within_budget(F.col("prompt"), 3, "c", count)).collect()} == {1, 3}


def test_long_texts_and_vocabularies(monkeypatch):
    pieces = subword.Pieces(["a" * k for k in range(1, 60)])
    began = time.perf_counter()
    (found,) = pieces.starts(["a" * 500_000])
    assert len(found) == -(-500_000 // 59) and time.perf_counter() - began < 20
    monkeypatch.setattr(subword, "MOST_CHARS", 3)
    with pytest.raises(ValueError, match="vocabulary"):
        subword.Pieces(["abcd"])
