import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import ngram_join
from termloom.llm.components import components

DOCS = "doc_id long, text string, class string, component_id long, part int"


def shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(rows, n, num, den):
    own = [(i, shingles(t, n)) for i, t in rows]
    up = list(range(len(own)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(own)):
        for y in range(x):
            a, b = own[x][1], own[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[find(x)] = find(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(own):
        if i is not None:
            least[find(x)].append(i)
    return sorted((i if i is not None else -1, len(s), min(least[find(x)], default=-1)) for x, (i, s) in enumerate(own))


def corpus(seed=1):
    """Chains of copies that change a little each time, groups around one text, passages in many texts, and short texts."""
    rng, rows = random.Random(seed), []
    word = lambda: f"w{rng.randrange(4000)}"
    passage = " ".join(word() for _ in range(60))
    for _ in range(12):
        text = [word() for _ in range(rng.randrange(20, 300))]
        for _ in range(rng.randrange(1, 12)):
            rows.append(" ".join(text))
            text = list(text) if rng.random() < 0.7 else rows[-1].split()
            for _ in range(rng.randrange(0, 1 + len(text) // 40)):
                text[rng.randrange(len(text))] = word()
    for _ in range(40):
        rows.append(" ".join([*(word() for _ in range(rng.randrange(0, 30))), passage, *(word() for _ in range(rng.randrange(0, 30)))]))
    rows += ["", " \n", "one", "One", "one two", "a b c d e", "a b c d e f", "A b\tc d e", *(" ".join("abcdefgh"[:k]) for k in range(1, 9))]
    rows += [None, "x " * 4000, "é É e", "é é e"]
    rng.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


def test_links_against_all_pairs(spark):
    rows = corpus()
    rows += [rows[3], (None, rows[5][1]), (None, "nothing else is like this one"), (rows[4][0], "one two three four five six")]
    frame = spark.createDataFrame([(i, t, "c", 5, 1) for i, t in rows], DOCS)
    for n, num, den in ((4, 85, 100), (5, 4, 5)):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in ngram_join.similar(frame, n, num, den).collect())
        assert got == brute(rows, n, num, den)


def test_no_rows(spark, folder):
    assert ngram_join.op6(spark, folder(documents=([], DOCS))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.floats(0.0, 0.3), st.integers(0, 2**32))
def test_similar_sets_share_a_part(size, part, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    b = a[rng.random(len(a)) >= part / 2]
    b = np.unique(np.concatenate([b, rng.integers(0, 2**64, int(size * part / 2), dtype=np.uint64)]))
    for num, den in ((85, 100), (4, 5)):
        if len(b) and ngram_join.alike(a, b, num, den):
            hashes, place, number, need = ngram_join.part_hashes([a, b], num, den)
            mine, theirs = (set(zip(hashes[place == k].tolist(), number[place == k].tolist(), strict=True)) for k in (0, 1))
            shared = [r for _, r in mine & theirs]
            assert any(shared.count(r) >= max(need[number == r]) for r in set(shared))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(0, 300) if i % 100 != 99] + [(500, k) for k in range(501, 560)] + [(7, 7), (0, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: i // 100 * 100 for i in range(300)} | {i: 500 for i in range(500, 560)}


def test_spanning_links_connect_what_the_matrix_does():
    rng = np.random.default_rng(2)
    for part in (0.02, 0.1, 0.5):
        alike = rng.random((40, 30)) < part
        rows, columns = np.arange(40), 100 + np.arange(30)
        a, b = ngram_join.spanning(alike, rows, columns)
        assert len(a) == len(b) <= 70

        def parts(links):
            up = {x: x for x in [*rows.tolist(), *columns.tolist()]}

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            for x, y in links:
                up[find(x)] = find(y)
            return {frozenset(y for y in up if find(y) == find(x)) for x in up}

        assert parts(zip(a, b, strict=True)) == parts([(int(x), 100 + int(y)) for x, y in zip(*np.nonzero(alike), strict=True)])


def test_groups_under_the_bound_are_not_fetched(spark):
    sets = {1: range(0, 100), 2: range(0, 95), 3: range(1000, 1100), 4: range(20, 120), 5: range(0, 50)}
    hashed = {k: np.sort(np.array([x * 7919 for x in v], np.uint64)) for k, v in sets.items()}
    whole = spark.createDataFrame([(k, bytearray(v.tobytes())) for k, v in hashed.items()], "class long, set binary")
    groups = spark.createDataFrame([(10, 1), (10, 3), (20, 2), (30, 4), (30, 5)], "group long, class long")
    stored = ngram_join.matrix(groups, whole).persist()
    pairs = spark.createDataFrame([(10, 20), (10, 30)], "a long, b long")
    found = {(r.a, r.b): np.frombuffer(r.names, np.int64).tolist() for r in ngram_join.qualifying(pairs, stored, 85, 100).collect()}
    # Class 1 has 95 of 100 with group 20's union, and all with that of 30, none of whose members is similar; class 3 has none.
    assert found == {(10, 20): [1], (10, 30): [1]}
    queries = ngram_join.qualifying(pairs.where("b = 20"), stored, 85, 100)
    assert sorted(map(tuple, ngram_join.opened(queries, stored, 85, 100).collect())) in ([(1, 1), (1, 2)], [(1, 2)])
