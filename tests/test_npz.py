"""Arrays in npz files."""

import json
import os

import numpy as np
import pytest

from termloom.sources import npz, readers, writers


def arrays(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return np.array([f"term {i} é語"[: 4 + i % 7] for i in range(n)]), rng.normal(size=(n, d))


def rows_of(df):
    return sorted((r[0], tuple(r[1])) for r in df.collect())


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("dtype", [np.float64, np.float32, ">f8"])
def test_ranges_give_the_arrays(spark, tmp_path, save, dtype):
    spark.dataSource.register(npz.NpzSource)
    terms, vectors = arrays(700, 5)
    save(path := f"{tmp_path}/graph_embeddings.npz", terms=terms, embeddings=vectors.astype(dtype))
    got = spark.read.format("npz").option("partitionBytes", 1 << 12).load(path)
    assert rows_of(got) == rows_of(readers.embeddings(spark, path)) == sorted((t, tuple(v)) for t, v in zip(terms.tolist(), vectors.astype(dtype).astype(float).tolist(), strict=True))
    assert (got.rdd.getNumPartitions() > 10) == (save is np.savez)


def test_graph_of_three_files_comes_back(spark, tmp_path):
    terms, vectors = arrays(30, 4, 1)
    nodes = {t: {"definition": f"of {t}"} for t in terms.tolist()}
    edges = {terms[0]: [{"target": terms[1], "type": "SIMILAR_MEANING", "weight": 0.5}, {"target": terms[2], "type": "CATEGORY", "weight": 1.0}]}
    for name, x in (("nodes", nodes), ("edges", edges)):
        with open(f"{tmp_path}/graph_{name}.json", "w", encoding="utf-8") as f:
            json.dump(x, f, ensure_ascii=False)
    np.savez(f"{tmp_path}/graph_embeddings.npz", terms=terms, embeddings=vectors)
    n, e = readers.graph(spark, f"{tmp_path}/graph_nodes.json", f"{tmp_path}/graph_edges.json")
    v = readers.embeddings(spark, f"{tmp_path}/graph_embeddings.npz")
    writers.graph(n, e, None, f"{tmp_path}/again")
    writers.embeddings_npz(v.repartition(3), f"{tmp_path}/again.npz")
    assert rows_of(readers.embeddings(spark, f"{tmp_path}/again.npz")) == rows_of(v)
    assert {(r.term, r.definition) for r in spark.read.parquet(f"{tmp_path}/again/nodes").collect()} == {(t, f"of {t}") for t in terms.tolist()}
    assert {(r.source, r.target, r.type) for r in spark.read.parquet(f"{tmp_path}/again/edges").collect()} == {(terms[0], terms[1], "SIMILAR_MEANING"), (terms[0], terms[2], "CATEGORY")}
    part = next(x for x in os.listdir(f"{tmp_path}/again.npz") if x.endswith(".npz"))
    with np.load(f"{tmp_path}/again.npz/{part}") as own:  # as numpy reads it
        assert own["terms"].shape[0] == own["embeddings"].shape[0] and own["embeddings"].shape[1] == 4


def test_overwriting_and_small_parts(spark, tmp_path):
    terms, vectors = arrays(50, 2, 2)
    df = spark.createDataFrame(list(zip(terms.tolist(), vectors.tolist(), strict=True)), "term string, embedding array<double>")
    for _ in range(2):
        writers.embeddings_npz(df, path := f"{tmp_path}/e.npz")
        assert rows_of(readers.embeddings(spark, path)) == rows_of(df)
    assert not [x for x in os.listdir(path) if x.startswith("_writing")]
    df.coalesce(1).toDF("terms", "embeddings").write.format("npz").option("fileRows", 7).mode("append").save(small := f"{tmp_path}/small.npz")
    assert len([x for x in os.listdir(small) if x.endswith(".npz")]) == 8 and rows_of(readers.embeddings(spark, small)) == rows_of(df)


def test_what_is_no_column(spark, tmp_path):
    spark.dataSource.register(npz.NpzSource)
    np.savez(f"{tmp_path}/a.npz", x=np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="no column"):
        spark.read.format("npz").load(f"{tmp_path}/a.npz").collect()
    np.savez(f"{tmp_path}/b.npz", x=np.arange(3), y=np.arange(4))
    with pytest.raises(Exception, match="several lengths"):
        spark.read.format("npz").load(f"{tmp_path}/b.npz").collect()
    np.savez(f"{tmp_path}/c.npz", terms=np.array([], "U3"), embeddings=np.zeros((0, 4)))
    assert readers.embeddings(spark, f"{tmp_path}/c.npz").count() == 0
