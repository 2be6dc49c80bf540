import hashlib
import random
import re
import zlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import conversations as C
from tests.llm.conftest import same

SCHEMA = "conv_id long, turn long, role string, text string, cost int, head string, _rn int, copy int"
NAMES = [x.split()[0] for x in C.RESULT.split(", ")]


def cheapest(codes):
    """(cost, least audit) by going through all rows from the last one; the rest's audit alone decides between ways of one cost."""
    inf = (float("inf"), "")
    best = [(0, ""), inf, inf, (0, "")]
    for i in range(len(codes), -1, -1):
        own = list(best) if i == len(codes) else [min([(best[q][0] + 2, "D" + best[q][1])] + keeps(codes[i], q, best)) for q in range(4)]
        for _ in range(3):
            own = [min(own[q], (own[C.OWN[q]][0] + 5, "I" + own[C.OWN[q]][1])) for q in range(4)]
        best = own
    return best[0]


def keeps(code, q, best):
    at, fault = divmod(code, 3)
    if fault == 1:
        return []
    more, to = 5 * (fault == 2), C.OWN[q]
    out = [(best[to][0] + 1 + more, "R" + best[to][1])]
    if at < 3 and C.STEP["sua"[at]][q] >= 0:
        to = C.STEP["sua"[at]][q]
        out.append((best[to][0] + more, "K" + best[to][1]))
    return out


def every_audit(codes, most):
    """All (cost, audit) up to a number of inserts that give the form, by trying."""
    todo, found = [(0, 0, "", "", 0)], []
    while todo:
        i, n, out, audit, cost = todo.pop()
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", out):
            found.append((cost, audit))
        if n < most:
            todo += [(i, n + 1, out + x, audit + "I", cost + 5) for x in "ua"]
        if i < len(codes):
            at, fault = divmod(codes[i], 3)
            todo.append((i + 1, n, out, audit + "D", cost + 2))
            if fault != 1:
                todo.append((i + 1, n, out + "sua?"[at], audit + "K", cost + 5 * (fault == 2)))
                todo += [(i + 1, n, out + x, audit + "R", cost + 1 + 5 * (fault == 2)) for x in "ua"]
    return min(found)


def brute(rows):
    groups = defaultdict(list)
    for conv_id, turn, role, text in rows:
        groups[conv_id].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv_id, own in groups.items():
        after = []
        for turn, role, text in own:
            kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
                after += [row] * (1 + (kind == 3))
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
        seen, codes, counts = set(), [], [0, 0, 0]
        for _, role, text in after:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            codes.append(C.code(role[:1], 0 if fault is None else 2 if fault == 2 else 1))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:], strict=False))
        turns = {t for t, *_ in after if t is not None}
        cost, audit = cheapest(codes)
        i, state, made = 0, "", []
        for x in audit:
            want = "assistant" if state == "u" else "user"
            if x == "I":
                made.append((want, ""))
            else:
                _, role, text = after[i]
                i += 1
                if x == "D":
                    continue
                made.append((role if x == "K" else want, text))
            state = made[-1][0][:1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in made))
        text = "\n".join(f"{r}:{t}" for r, t in made)
        out.append((conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


CODES = st.lists(st.integers(0, 11), max_size=14).map(bytes)


@settings(max_examples=400, deadline=None)
@given(CODES)
def test_search_is_cheapest_and_least(codes):
    assert C.repair(codes) == cheapest(codes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=4).map(bytes))
def test_against_all_audits(codes):
    assert C.repair(codes) == every_audit(codes, 3)


@settings(max_examples=200, deadline=None)
@given(CODES, st.integers(1, 4))
def test_segments_chain(codes, size):
    parts = [C.summary(codes[k : k + size]) for k in range(0, len(codes), size)]
    cost, audits = C.chained(parts)
    assert (cost, "".join(audits)) == cheapest(codes)


def test_many_rows_are_searched_in_segments():
    rng = random.Random(5)
    codes = bytes(rng.choices([0, 3, 6, 4, 7, 5, 8, 9], [1, 20, 20, 3, 3, 3, 3, 2], k=3000))
    assert C.repair(codes) == cheapest(codes)


def rows_(seed=1):
    rng, rows = random.Random(seed), []
    for conv_id in [*range(60), None, 999]:
        n = 40 if conv_id == 7 else 1 if conv_id == 999 else rng.randrange(1, 12)
        for k in range(n):
            turn = rng.choice([k, k, k, k, k + 3, None])
            role = rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.3 else ["user", "assistant"][k % 2]
            text = rng.choice(["Yes.", "No!", "What is it? ", "cut off", "", " \n", "é 日本.", None, "x" * 70 + rng.choice("ab") + ".", f"row {k}."])
            rows.append((conv_id, turn, role, text))
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, rows[0], rows[0], (dropped, 0, "user", "Gone."), (8000, 1, "assistant", "long é. " * 30000), (8000, 0, "user", "Why?")]


def make(folder, rows):
    return folder(conversations=([(*r, 1, "h", 2, 3) for r in rows], SCHEMA))


def test_query(spark, folder):
    rows = rows_()
    got = C.op13(spark, make(folder, rows))
    assert got.columns == NAMES
    same(got, NAMES, brute(rows))


def test_long_conversations_in_segments(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 4)
    rows = rows_(2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same(C.repaired(df, 0), NAMES, brute(rows))
    same(C.repaired(df, 8, 10_000), NAMES, brute(rows))


def test_no_rows(spark, folder):
    assert C.op13(spark, make(folder, [])).count() == 0
