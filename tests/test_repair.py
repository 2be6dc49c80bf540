"""Replies that are nearly JSON."""

import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions.repair import repair
from termloom.functions.text import repaired

VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-1000, 1000), st.floats(-1e6, 1e6, allow_nan=False), st.text(alphabet="ab é'{}[]:,\n\\/\U0001f600 1", max_size=8)),
    lambda own: st.one_of(st.lists(own, max_size=4), st.dictionaries(st.text(alphabet="abké", min_size=1, max_size=4), own, max_size=4)),
    max_leaves=12,
)
OBJECTS = st.dictionaries(st.text(alphabet="abké", min_size=1, max_size=4), VALUES, max_size=5)


@settings(max_examples=300, deadline=None)
@given(OBJECTS, st.sampled_from([None, 2]), st.sampled_from(["", "Sure, here it is:\n", "```json\n"]), st.sampled_from(["", "\n```", "\nThat is all."]))
def test_what_is_proper_stays(value, indent, before, after):
    assert json.loads(repair(before + json.dumps(value, indent=indent, ensure_ascii=False) + after)) == value


def part_of(cut, whole):
    """Whether a cut value holds nothing but what the whole one begins with."""
    if isinstance(cut, dict) and isinstance(whole, dict):
        return list(cut) == list(whole)[: len(cut)] and all(part_of(cut[k], whole[k]) for k in cut)
    if isinstance(cut, list) and isinstance(whole, list):
        return len(cut) <= len(whole) and all(part_of(a, b) for a, b in zip(cut, whole, strict=False))
    if isinstance(cut, str) and isinstance(whole, str):
        return whole.startswith(cut)
    return cut is None or isinstance(cut, str) or type(cut) is type(whole) or isinstance(cut, int | float)


@settings(max_examples=300, deadline=None)
@given(OBJECTS, st.data())
def test_cut_ends_give_what_was_there(value, data):
    whole = json.dumps(value, ensure_ascii=False)
    cut = whole[: data.draw(st.integers(1, len(whole)))]
    assert part_of(json.loads(repair(cut)), value)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="{}[]\"':,ab1 \n\\/*", max_size=40))
def test_anything_is_read_without_failing(text):
    got = repair(text)
    assert got is None or json.loads(got) is not None


@pytest.mark.parametrize(
    ("reply", "value"),
    [
        ("{'a': 'it's', 'b': \"x\"}", {"a": "it's", "b": "x"}),
        ("{a: 1, b_c: true, d: None}", {"a": 1, "b_c": True, "d": None}),
        ('{"a": "he said "no" to it", "b": 2}', {"a": 'he said "no" to it', "b": 2}),
        ('{"a": 1 "b": [1 2, 3,,], }', {"a": 1, "b": ["1 2", 3]}),
        ('{"a": "line\none", /* said */ "b": 1 // so\n}', {"a": "line\none", "b": 1}),
        ("{“a”: “é”, ‘b’: plain words, 'c': 01}", {"a": "é", "b": "plain words", "c": "01"}),
        ('{"a": [1, {"b": 2}', {"a": [1, {"b": 2}]}),
        ('{"a": {"b": [1, 2}, "c": 3}', {"a": {"b": [1, 2]}, "c": 3}),
        ('{"a": "\\u00e9\\n\\"q\\"", "b": "cut off', {"a": 'é\n"q"', "b": "cut off"}),
        ('{"a": 1, "b', {"a": 1}),
        ('{"a": 1, "b":', {"a": 1, "b": None}),
        ("no braces, [1, 2] alone", [1, 2]),
        ('{"a": 1} {"b": 2}', {"a": 1}),
        ("{}", {}),
        ("{", {}),
        ('{"questions": ["One?" "Two?", \'Three?\'', {"questions": ["One?", "Two?", "Three?"]}),
    ],
)
def test_cases(reply, value):
    assert json.loads(repair(reply)) == value


def test_none_and_long_replies():
    assert repair(None) is None and repair("") is None and repair("words alone") is None
    for text in ("[" * 100_000, '{"a": ' * 50_000, '{"a": "' + '" x' * 50_000, "{" + "/*" * 50_000, "{" + " " * 100_000 + "'"):
        began = time.perf_counter()
        assert repair(text) is not None
        assert time.perf_counter() - began < 3


def test_column(spark):
    rows = [(1, '```json\n{"a": 1}\n```'), (2, "{'a': 1"), (3, None), (4, "none"), (5, '{"a": "x"} done'), (6, '{"a": 2}')]
    got = {r.i: r.j for r in spark.createDataFrame(rows, "i int, t string").select("i", repaired(F.col("t")).alias("j")).collect()}
    assert {i: j and json.loads(j) for i, j in got.items()} == {1: {"a": 1}, 2: {"a": 1}, 3: None, 4: None, 5: {"a": "x"}, 6: {"a": 2}}
