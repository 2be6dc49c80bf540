import math
import zlib
from collections import Counter

import numpy as np

from termloom.llm import pitman_yor

DOCS = "doc_id long, text string, score double, n_known int"


def out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def expected(rows):
    """Counts and base scores of (doc_id, text) rows."""
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    c = Counter(w for (i, _), own in zip(rows, tokens, strict=True) if not out(i) for w in own)
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(own), sum(c[w] > 0 for w in own), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) for (i, _), own in zip(rows, tokens, strict=True)]


def test_counts_and_held_out_likelihood(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in pitman_yor.op7(spark, sf).collect()}
    base = model = tokens = 0
    for i, is_out, n, known, train, score in expected(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (is_out, n, known, train)
        assert abs(r.base_score - score) < 1e-6 * abs(score) and r.score < 0
        if is_out:
            base, model, tokens = base + score, model + r.score, tokens + n
    assert model / tokens > base / tokens + 0.2  # a lower perplexity than the unigram's


def test_tables_follow_their_exact_distribution():
    rng = np.random.default_rng(0)
    # Three customers of one dish, parent's probability 0.5: by hand, from all partitions.
    d, theta, prior = 0.5, 1.0, 0.5
    weight = np.array([(1 - d) * (2 - d) * theta * prior, 3 * (1 - d) * theta * (theta + d) * prior**2, theta * (theta + d) * (theta + 2 * d) * prior**3])
    n = 20_000
    got = pitman_yor.seat(np.full(n, 3), np.arange(n), np.ones(n, int), np.full(n, prior), np.ones(n, int), d, theta, rng)
    assert np.allclose(np.bincount(got, minlength=4)[1:] / n, weight / weight.sum(), atol=0.015)


def test_many_customers_tables_by_their_mean_and_deviation():
    d, c = 0.75, 64
    for theta, prior in ((1.0, 0.01), (50.0, 0.2), (5000.0, 0.002), (800.0, 0.3)):
        k = np.arange(1, c + 1)
        weight = pitman_yor._stirling(d)[c, 1:] + np.cumsum(np.log(theta + d * np.arange(c))) + k * np.log(prior)
        weight = np.exp(weight - weight.max())
        exact = (weight * k).sum() / weight.sum()
        deviation = math.sqrt((weight * k * k).sum() / weight.sum() - exact**2)
        mean, spread = pitman_yor.tables_of_many(np.array([float(c)]), np.array([prior]), np.array([theta]), d)
        assert abs(mean[0] - exact) < 1 and abs(spread[0] - deviation) < 0.25 * deviation + 0.2


def seatings(count, prior, total, d, theta):
    """By hand: the tables that so many customers of a dish can have, with their probabilities, beside the tables of others."""
    ways = {(): 1.0}
    for _ in range(count):
        more = Counter()
        for sizes, w in ways.items():
            for i, n in enumerate(sizes):
                more[tuple(sorted((*sizes[:i], n + 1, *sizes[i + 1 :])))] += w * (n - d)
            more[tuple(sorted((*sizes, 1)))] += w * (theta + d * (total + len(sizes))) * prior
        ways = more
    by = Counter()
    for sizes, w in ways.items():
        by[len(sizes)] += w
    return {t: w / sum(by.values()) for t, w in by.items()}


def test_scores_against_seatings_by_hand(spark):
    """A corpus where every pair but one stands once, so that all seatings but that pair's are forced."""
    rows = [(1, "a b", False), (3, "c b", False), (4, "a b d", False), (1, "a e", True)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {(r.doc_id, r.held_out): r.score for r in pitman_yor.scores(frame).collect()}
    # Pairs: start-a 2, a-b 2, b-end 2, start-c, c-b, b-d, d-end: three pairs are seated at one table or at two.
    once, twice = 4, 3
    d, d0, th0 = once / (once + 2 * twice), pitman_yor.ROOT_DISCOUNT, pitman_yor.ROOT_THETA
    kinds = 5  # a, b, c, d, end
    found = set()
    for first in range(1, 3):  # tables that the parent sees of the pairs start-a, a-b, b-end
        for second in range(1, 3):
            for third in range(1, 3):
                n = {"a": first, "b": second + 1, "c": 1, "d": 1, None: third + 1}
                for two in range(1, n["b"] + 1):
                    for ends in range(1, n[None] + 1):
                        for ones in range(1, n["a"] + 1):
                            t = {"a": ones, "b": two, "c": 1, "d": 1, None: ends}
                            base = (th0 + d0 * sum(t.values())) / (th0 + sum(n.values())) / (kinds + 1)
                            p = {w: (n[w] - d0 * t[w]) / (th0 + sum(n.values())) + base for w in n}
                            assert abs(sum(p.values()) + base - 1) < 1e-12
                            # the held-out text: start-a, then a-e and e-end, which no training text has
                            for ta in range(1, 3):
                                for tab in range(1, 3):
                                    start = (2 - d * ta + (1 + d * (ta + 1)) * p["a"]) / (1 + 3)
                                    found.add(round(start, 9))
                                    found.add(("a", round((1 + d * tab) * base / (1 + 2), 9)))
                                    found.add(("end", round(p[None], 9)))
    starts = [x for x in found if isinstance(x, float)]
    new, ends = ([x[1] for x in found if isinstance(x, tuple) and x[0] == k] for k in ("a", "end"))
    low = math.log10(min(starts)) + math.log10(min(new)) + math.log10(min(ends))
    high = math.log10(max(starts)) + math.log10(max(new)) + math.log10(max(ends))
    assert low - 1e-9 <= got[1, True] <= high + 1e-9


def test_averaged_seatings_of_one_pair(spark, monkeypatch):
    """With many samples, the average over seatings of one pair comes near that of seatings enumerated by hand."""
    rng = np.random.default_rng(3)
    d, prior, customers, others = 0.6, 0.2, 5, 3
    known = pitman_yor.Known(10, np.array([5], np.uint64), np.array([1]), np.zeros(0, np.uint64), d)
    monkeypatch.setattr(pitman_yor, "SWEEPS", 3)
    count, place = np.array([4, 1, 1, 1]), np.zeros(4, int)
    many = [np.array([prior, 0.1, 0.1, 0.1])] * 4000
    got = pitman_yor.chances(known, count, place, many, np.array([7]), None, rng, (np.array([False]), np.array([0]), np.array([0])))
    exact = 0.0
    for t, p in seatings(4, prior, others, d, 1.0).items():
        exact += p * (4 - d * t + (1 + d * (t + 3)) * prior) / (1 + 7)
    assert customers == 5 and abs(got[0] - exact) < 0.004


def test_frequent_words_do_not_depend_on_partitions(spark):
    rows = [(i, f"twice twice once rare{i}", False) for i in range(40)]
    made = lambda n: spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, text string, held_out boolean")
    one, many = (pitman_yor.count_words(made(n)) for n in (1, 40))
    assert one[0] == many[0] == 200 and all(np.array_equal(a, b) for a, b in zip(one[1:], many[1:], strict=True))
    assert len(many[1]) == 3 and len(many[3]) == 3  # twice, once and the end; twice, once and the start


def test_edges(spark, folder):
    rows = [(i, t) for i, t in enumerate(["", None, "a b a b", "A\tB  c\n", "é É", "x " * 30000, "unseen word"])] + [(2, "a b a b"), (None, "no id")]
    got = pitman_yor.op7(spark, folder(documents=([(*r, 0.0, 0) for r in rows], DOCS))).collect()
    key = lambda r: tuple(map(str, r))
    mine = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=key)
    assert mine == sorted([(*r[:5], round(r[5], 6)) for r in expected(rows)], key=key)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_no_rows(spark, folder):
    assert pitman_yor.op7(spark, folder(documents=([], DOCS))).count() == 0
