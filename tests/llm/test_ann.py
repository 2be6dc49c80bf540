import numpy as np
import pytest

from termloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, rank int"


def nearest(rows, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_codes_come_closer_with_every_book():
    x = np.random.default_rng(1).normal(size=(600, 16)).astype(np.float32)
    books = ann.fit(x, books=6, words=32)
    error = [((x - ann.Codebooks(books.words[:b]).decode(ann.Codebooks(books.words[:b]).encode(x))) ** 2).sum() for b in (1, 3, 6)]
    assert error[0] > error[1] > error[2]
    wide, narrow = (((x - books.decode(books.encode(x, beam))) ** 2).sum() for beam in (8, 1))
    assert wide < narrow


def test_table_scores_are_inner_products_of_stored_vectors():
    x = np.random.default_rng(2).normal(size=(300, 8)).astype(np.float32)
    books = ann.fit(x, books=4, words=16)
    codes, table = books.encode(x), books.table(x[:5])
    sums = sum(table[b][codes[:, b]] for b in range(4))
    assert np.allclose(sums, books.decode(codes) @ x[:5].T, atol=1e-4)


def test_recall_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = nearest(rows), {}
    for r in ann.op1(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = [len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / len(want[q]) for q in want]
    assert got.keys() == want.keys() and np.mean(hits) >= 0.9
    for own in got.values():
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_edges(spark, folder):
    nan, inf = float("nan"), float("inf")
    bad = [(20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [1.0, None]), (100, [inf, 1.0]), (120, []), (160, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (140, [-1.0, 2.0]), (3, [0.5, 0.5])]
    rows = [(*r, 1, 9, 9) for r in bad + good]
    got = {}
    for r in sorted(ann.op1(spark, folder(embeddings=(rows, SCHEMA))).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert got[0] == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.5), (4, 140, -1.0)]
    assert got.keys() == {0, 140} and len(got[140]) == 4


def test_no_rows(spark, folder):
    assert ann.op1(spark, folder(embeddings=([], SCHEMA))).count() == 0


def test_groups_of_codes_merge(spark, monkeypatch):
    v = ann.usable(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    books = ann.codebooks(v)
    found = []
    for rows, slices, at_once in ((1 << 20, 1 << 15, 1024), (20, 1 << 15, 1024), (60, 3, 2)):
        monkeypatch.setattr(ann, "GROUP_ROWS", rows)
        monkeypatch.setattr(ann, "CODE_BLOCK", 16)
        monkeypatch.setattr(ann, "SLICE_QUERIES", slices)
        monkeypatch.setattr(ann, "QUERIES_AT_ONCE", at_once)
        found.append(sorted(map(tuple, ann.search(v, v.where("vec_id % 20 = 0"), 5, 12, books).select("query_id", "rank", "vec_id").collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) == 5 * len({q for q, _, _ in found[0]})


def other_rows(kind, n=2400, d=24):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, d))
    x = rng.normal(size=(n, d))
    return {
        "clusters": lambda: centres[rng.integers(0, 5, n)] + 0.01 * x,
        "near copies": lambda: np.where(np.arange(n)[:, None] % 3 > 0, centres[0] + 1e-4 * x, x),
        "copies": lambda: np.where(np.arange(n)[:, None] % 3 > 0, centres[0], x),
        "lengths": lambda: x * np.exp(4 * rng.normal(size=n))[:, None],
        "ties": lambda: (x > 1.2) * 1.0 + (np.arange(d) == 0),
        "far larger": lambda: x * np.where(np.arange(n) % 90 == 1, 1e30, 1e-3)[:, None],
    }[kind]()


@pytest.mark.parametrize("kind", ["clusters", "near copies", "copies", "lengths", "ties", "far larger"])
def test_all_nearest_are_found_on_other_rows(spark, folder, kind, monkeypatch):
    monkeypatch.setattr(ann, "CODE_BLOCK", 300)
    rows = [(i, [float(c) for c in v], 1, 9, 9) for i, v in enumerate(other_rows(kind).astype(np.float32))]
    vectors = ann.usable(spark.read.parquet(folder(embeddings=(rows, SCHEMA)) + "/embeddings.parquet")).cache()
    # Codebooks of rows of another kind, a few codewords each: they decide on the work, not on the result.
    books = ann.fit(np.random.default_rng(4).normal(size=(300, 24)), books=3, words=16)
    got = {}
    for group in (1 << 18, 700):
        monkeypatch.setattr(ann, "GROUP_ROWS", group)
        got[group] = {}
        for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), books=books).orderBy("query_id", "rank").collect():
            got[group].setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[1 << 18] == got[700] == nearest([r[:2] for r in rows])


def test_least_distances(spark):
    x = other_rows("lengths", 600, 8)
    vectors = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).cache()
    books = ann.codebooks(vectors, books=4, words=16)
    found = {}
    for r in ann.shortlists(vectors.where("vec_id % 20 = 0"), ann.index(vectors, books), books, 5, by="l2").collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for q in range(0, 600, 20):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        assert found[q] == set(np.argsort(far)[:5].tolist())
