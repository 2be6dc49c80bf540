"""Asking models: how many prompts, at once and at all."""

import time

import pytest

from termloom.operators import qa
from termloom.operators.models import Extractive, Window, complete
from termloom.operators.replies import ReplyStore


def counting(spark, answer):
    """A factory of models that add each prompt to an accumulator, and the accumulator."""
    asked = spark.sparkContext.accumulator(0)

    class Model:
        def complete(self, prompts):
            asked.add(len(prompts))
            return [answer(p) for p in prompts]

    return Model, asked


def test_window_keeps_order_and_overlaps():
    began = time.monotonic()
    got = list(Window(8).map(lambda x: (time.sleep(0.2 + 0.02 * (x % 3)), x)[1], range(16)))
    assert got == list(range(16)) and time.monotonic() - began < 16 * 0.2 / 2


def test_no_more_fly_than_the_window_holds():
    flying, most = set(), []

    def call(x):
        flying.add(x)
        most.append(len(flying))
        time.sleep(0.03)
        flying.discard(x)
        return x

    assert list(Window(3).map(call, range(20))) == list(range(20)) and max(most) == 3


def test_window_tries_again_and_gives_up():
    tries: dict = {}

    def call(x):
        tries[x] = tries.get(x, 0) + 1
        if x == 1 and tries[x] < 3:
            raise ValueError("not yet")
        if x == 2:
            time.sleep(1.5)
        if x == 3:
            raise KeyError("never")
        return x

    began = time.monotonic()
    got = list(Window(2, timeout=0.2, retries=2, pause=0.02).map(call, range(5)))
    assert got[:2] == [0, 1] and isinstance(got[2], TimeoutError) and isinstance(got[3], KeyError) and got[4] == 4
    assert tries == {0: 1, 1: 3, 2: 3, 3: 3, 4: 1} and time.monotonic() - began < 3


def test_sleeping_model_overlaps_in_a_task(spark):
    class Sleeper:
        def complete(self, prompts):
            time.sleep(0.25)
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(i, f"p{i}") for i in range(40)], "i int, p string").coalesce(1)
    complete(df, "p", "r", Sleeper, batch=2).limit(1).count()  # starts a worker
    began = time.monotonic()
    got = [(r.i, r.r) for r in complete(df, "p", "r", Sleeper, batch=2, window=Window(10)).collect()]
    assert time.monotonic() - began < 20 * 0.25 and got == [(i, f"P{i}") for i in range(40)]


def test_a_failure_is_one_row(spark):
    class Fails:
        def complete(self, prompts):
            if any("bad" in p for p in prompts):
                raise ValueError("bad")
            return [p.upper() for p in prompts]

    df = spark.createDataFrame([(0, "a"), (1, "bad"), (2, None), (3, "c"), (4, "")], "i int, p string").coalesce(1)
    got = {r.i: r.r for r in complete(df, "p", "r", Fails, window=Window(4)).collect()}
    assert got == {0: "A", 1: "", 2: None, 3: "C", 4: ""}
    assert {r.i: r.r for r in complete(df, "p", "r", Fails, on_error="null").collect()}[1] is None
    with pytest.raises(Exception, match="bad"):
        complete(df, "p", "r", Fails, on_error="raise").collect()


def test_no_prompt_is_asked_twice(spark, tmp_path):
    model, asked = counting(spark, str.upper)
    store = ReplyStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([(i, f"p{i % 7}" if i % 5 else None, "x") for i in range(50)], "i int, prompt string, reply string")
    want = {i: f"P{i % 7}" if i % 5 else None for i in range(50)}
    for total in (7, 7):  # the second run asks nothing
        assert {r.i: r.reply for r in store.complete(df, "prompt", "reply", model).collect()} == want
        assert asked.value == total
    more = df.unionByName(spark.createDataFrame([(99, "new", "x")], df.schema))
    assert {r.i: r.out for r in ReplyStore(spark, str(tmp_path / "store")).complete(more, "prompt", "out", model).collect()} == want | {99: "NEW"}
    assert asked.value == 8
    assert ReplyStore(spark, str(tmp_path / "store"), "another").known().count() == 0


def test_failures_are_asked_again(spark, tmp_path):
    def answer(p):
        if p == "bad":
            raise ValueError(p)
        return p.upper()

    broken, _ = counting(spark, answer)
    store = ReplyStore(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("a",), ("bad",)], "prompt string")
    assert sorted(r.r for r in store.complete(df, "prompt", "r", broken).collect()) == ["", "A"]
    mended, asked = counting(spark, str.upper)
    assert sorted(r.r for r in store.complete(df, "prompt", "r", mended).collect()) == ["A", "BAD"] and asked.value == 1


def test_question_rows_of_a_second_run_ask_nothing(spark, tmp_path):
    one = Extractive()
    model, asked = counting(spark, one._one)
    text = " ".join(f"word{i}" for i in range(900))
    articles = spark.createDataFrame([("a", text), ("b", text), ("c", text + " more")], "title string, content string")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "cut"))
    rows = lambda **more: sorted(map(tuple, qa.qa_rows(articles, model, **more).collect()))
    plain, first = rows(), asked.value
    store = ReplyStore(spark, str(tmp_path / "store"))
    assert rows(store=store) == plain
    once = asked.value - first
    assert 0 < once < first  # two articles have the same chunks
    assert rows(store=store, window=Window(3)) == plain and asked.value == first + once
