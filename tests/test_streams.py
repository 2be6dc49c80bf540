"""Dictionaries that a stream keeps, held against the batch query after any split into batches."""

import random

import pytest

from termloom.operators.dictionary import merge_last
from termloom.streaming import incremental

SCHEMA = "term string, definition string, doc long, chunk int"


def rows_(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", "é", None]), rng.choice(["one", "two", "three", "", None]), rng.randrange(6), rng.randrange(3)) for _ in range(60)]
    return rows + rows[:5]


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_any_split_gives_the_dictionary_of_the_batch_query(spark, tmp_path, batches):
    rows = rows_(batches)
    whole = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, merge_last(whole.where("term IS NOT NULL"), "term", "definition", "doc", "chunk", "definition").collect()))
    rng, said = random.Random(batches), {}
    dealt = [rng.randrange(batches) for _ in rows]
    for k in range(batches):
        own = [r for r, at in zip(rows, dealt, strict=True) if at == k]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        incremental.changes_sink(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "doc", "chunk").awaitTermination(120)
        fresh = spark.read.parquet(f"{tmp_path}/out").where(f"batch = {k}").collect() if own else []
        assert all(said.get(r.term) != (r.definition, r.doc, r.chunk) for r in fresh)  # nothing is said twice
        said |= {r.term: (r.definition, r.doc, r.chunk) for r in fresh}
    got = incremental.kept_dictionary(spark, f"{tmp_path}/out", "doc", "chunk")
    assert sorted(map(tuple, got.select("term", "definition").collect())) == want
    incremental.compact(spark, f"{tmp_path}/out", f"{tmp_path}/small", "doc", "chunk")
    small = spark.read.parquet(f"{tmp_path}/small")
    assert small.count() == len(want)
    assert sorted(map(tuple, incremental.kept_dictionary(spark, f"{tmp_path}/small", "doc", "chunk").collect())) == want
