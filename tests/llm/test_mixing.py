from collections import defaultdict

from pyspark.sql import functions as F

from termloom.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, target string"


def water(sizes, weights, total, cap):
    """Targets by sharing the excess again and again."""
    out, left, open_ = dict.fromkeys(sizes, 0.0), total, dict(weights)
    while open_ and left > 1e-9:
        whole, given = sum(open_.values()), 0.0
        for s in list(open_):
            add = min(left * open_[s] / whole, cap * sizes[s] - out[s])
            out[s] += add
            given += add
        left -= given
        open_ = {s: w for s, w in open_.items() if out[s] < cap * sizes[s] - 1e-9}
    return out


def test_targets_and_taken(spark):
    rows = [(i, ["a", "b", "c", "B", None, "z"][i % 6 if i > 50 else 0], i % 17) for i in range(400)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-3 and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_floor_keeps_every_document(spark):
    rows = [(i, "ab"[i > 90], 10) for i in range(100)]
    got = mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string, size long"), weights=(1.0, 9.0), least=1.0).collect()
    assert all(r.taken >= r.size for r in got) and sum(r.taken for r in got if r.source == "b") == 180  # b stops at twice its words


def test_positions_follow_the_schedule(spark):
    rows = [(i, "ab"[i % 2], 1) for i in range(2000)]
    mixed = mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string, size long"), weights=(1.0, 1.0), ramps=(-0.5, 0.5), share=1.0)
    order = [(r.source, r.position) for r in mixing.curriculum(mixed).collect()]
    assert [p for _, p in order] == sorted(p for _, p in order) and all(0 <= p <= 1 for _, p in order)
    early = [s for s, p in order if p < 0.1]
    assert early.count("a") > 2 * early.count("b")  # 1.5 against 0.5 at the start


def test_the_schedule_decides(spark):
    rows = [(i, "abc"[i % 3], 1 + i % 5) for i in range(300)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, size long")
    found = [sorted(map(tuple, mixing.scheduled(mixing.mixture(sizes, ramps=r)).collect())) for r in (mixing.RAMPS, (0.9, -0.9, 0.3))]
    assert [r[:5] for r in found[0]] == [r[:5] for r in found[1]] and sum(a != b for a, b in zip(*found, strict=True)) > 150
    got = mixing.scheduled(mixing.mixture(sizes)).collect()
    assert sorted(r.first_place for r in got if r.passes == 2)[0] >= 0 and sum(r.passes for r in got) > max(r.first_place or 0 for r in got)
    early = lambda s: sum(r.taken for r in got if "abc"[r.doc_id % 3] == s and r.first_position is not None and r.first_position < 0.2)
    whole = lambda s: sum(r.taken for r in got if "abc"[r.doc_id % 3] == s)
    assert early("a") / whole("a") > early("b") / whole("b") > early("c") / whole("c")  # falling, level and rising shares


def test_edges(spark, folder):
    none = folder(documents=([], DOCS))
    assert mixing.op8(spark, none).count() == 0
    rows = [(1, None, None, None, 0, "x"), (1, "", "en", None, 0, "x"), (None, "a b", "en", "s", 3, "x"), (None, "a b", "en", "s", 3, "x"), (2, "w " * 9000, "en", "s", 0, "x")]
    got = mixing.mixture(spark.createDataFrame(rows, DOCS).select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))).collect()
    assert len(got) == 5 and sum(r.taken for r in got) == round(1.5 * 9004) and {r.target for r in got if r.source is None} == {0.0}
