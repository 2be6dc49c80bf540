"""Conversation structure repair: the cheapest edits that give a conversation the form "perhaps a system row, then pairs of user and
assistant", found by a bidirectional Dijkstra search over the edit lattice.

A node of the lattice is (rows read, state of the form); edits are its arcs. A forward heap starts where nothing is read, a reverse
heap at the ends that the form accepts; they meet, go on until every crossing of the least cost is known, and of all ways with that
cost the one with the least audit (the edits' initials) is taken. A way's end can be compared alone, its beginning can't, as
beginnings of one cost may differ in length: forward labels keep the least beginning of each length.

Rows are dealt out by conversation, sorted by turn in the shuffle, and read as a stream. A conversation with very many rows or
characters is cut into segments, which are searched one by one, from any state to any, and chained; its texts run through a digest
and are never held.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import ordered, small, spread_join, written

#: Costs of edits, and what a truncated row costs beyond, unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows in a segment of a conversation that is searched at once, and rows and characters from which one is long.
SEGMENT, LONG_ROWS, LONG_CHARS = 512, 20_000, 8 << 20
#: States of the form (s?(ua)+)?: at the start, after the system row, after a user's row, after an assistant's. Where the
#: initials lead, -1 for nowhere; what a row of the form's own choice is there; and the states in which a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
OWN = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ENDS = (START, ASSISTANT)
LEGAL = frozenset(("su", "ua", "au"))
#: A row as the search sees it, in one byte: 3 * place of its initial in "sua" (3 for others) + 0 sound, 1 to be deleted, 2 truncated.
INITIALS = "sua"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def code(initial: str, fault: int) -> int:
    at = INITIALS.find(initial) if initial else -1
    return 3 * (at if at >= 0 else 3) + fault


def arcs(codes: bytes, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows read, state) of the edits at a node."""
    if i < len(codes):
        at, fault = divmod(codes[i], 3)
        yield DELETE, "D", i + 1, q
        if fault != 1:
            more = TRUNCATED * (fault == 2)
            if at < 3 and (to := STEP[INITIALS[at]][q]) >= 0:
                yield more, "K", i + 1, to
            yield REROLE + more, "R", i + 1, OWN[q]
    yield INSERT, "I", i, OWN[q]


def arcs_back(codes: bytes, i: int, q: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, initial, rows read, state) of the edits that lead to a node."""
    before = [p for p in range(4) if OWN[p] == q]
    if i:
        at, fault = divmod(codes[i - 1], 3)
        yield DELETE, "D", i - 1, q
        if fault != 1:
            more = TRUNCATED * (fault == 2)
            if at < 3:
                yield from ((more, "K", i - 1, p) for p in range(4) if STEP[INITIALS[at]][p] == q)
            yield from ((REROLE + more, "R", i - 1, p) for p in before)
    yield from ((INSERT, "I", i, p) for p in before)


class _Search:
    """One direction's heap, costs and labels. Nodes of one cost come in the order of rows read, so that a label is whole when its
    node is taken: arcs without cost read a row."""

    def __init__(self, starts: Iterable[tuple[int, int]], forward: bool):
        self.sign = 1 if forward else -1
        self.cost = dict.fromkeys(starts, 0)
        self.label: dict = {s: {0: ""} if forward else "" for s in self.cost}
        self.heap = [(0, self.sign * i, q) for i, q in self.cost]
        heapq.heapify(self.heap)
        self.settled: dict[tuple[int, int], int] = {}

    def top(self) -> float:
        while self.heap and (self.heap[0][1] * self.sign, self.heap[0][2]) in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def take(self) -> tuple[int, int, int]:
        cost, i, q = heapq.heappop(self.heap)
        self.settled[i * self.sign, q] = cost
        return cost, i * self.sign, q

    def reach(self, node: tuple[int, int], cost: int, label) -> None:
        known = self.cost.get(node)
        if known is None or cost < known:
            self.cost[node], self.label[node] = cost, label
            heapq.heappush(self.heap, (cost, self.sign * node[0], node[1]))
        elif cost == known:
            if self.sign < 0:
                self.label[node] = min(self.label[node], label)
            else:
                own = self.label[node]
                for n, x in label.items():
                    own[n] = min(own.get(n, x), x)


def search(codes: bytes, start: int, ends: tuple[int, ...]) -> tuple[float, dict[int, str]]:
    """The least cost of ways through all rows from a state to one of some states, and the least audit of each length among
    the cheapest; infinity and none if there is no way."""
    n = len(codes)
    ahead, back = _Search([(0, start)], True), _Search([(n, q) for q in ends], False)
    best = 0 if not n and start in ends else float("inf")
    while (a := ahead.top()) + (b := back.top()) <= best and min(a, b) < float("inf"):
        if a <= b:
            cost, i, q = ahead.take()
            label = ahead.label[i, q]
            for c, initial, j, to in arcs(codes, i, q):
                ahead.reach((j, to), cost + c, {k + 1: x + initial for k, x in label.items()})
                if (j, to) in back.cost:
                    best = min(best, cost + c + back.cost[j, to])
        else:
            cost, i, q = back.take()
            label = back.label[i, q]
            for c, initial, j, of in arcs_back(codes, i, q):
                back.reach((j, of), cost + c, initial + label)
                if (j, of) in ahead.cost:
                    best = min(best, cost + c + ahead.cost[j, of])
    # The heaps' least costs are over the best together, so a cheapest way goes from the last of its nodes that is settled ahead to
    # one that is settled behind, or that last node is its end.
    found: dict[int, str] = {}
    if best == float("inf"):
        return best, found

    def keep(audit: str) -> None:
        found[len(audit)] = min(found.get(len(audit), audit), audit)

    for (i, q), cost in ahead.settled.items():
        if i == n and q in ends and cost == best:
            for x in ahead.label[i, q].values():
                keep(x)
        for c, initial, j, to in arcs(codes, i, q):
            if back.settled.get((j, to)) == best - cost - c:
                for x in ahead.label[i, q].values():
                    keep(x + initial + back.label[j, to])
    return best, found


def summary(codes: bytes) -> dict[tuple[int, int], tuple[float, dict[int, str]]]:
    """search() of a segment, from every state to every state that it can end in."""
    out = {}
    for p in range(4):
        for q in range(4):
            if (got := search(codes, p, (q,)))[1]:
                out[p, q] = got
    return out


def chained(segments: list[dict]) -> tuple[int, list[str]]:
    """The least cost of a conversation of some segments, and each one's part of the least audit. Works from the last one on, as
    of two ways the one with the lesser rest is the lesser, whatever stands before."""
    rest: dict[int, tuple[float, list[str]]] = {q: (0, []) for q in ENDS}  # audits of the segments from the last one back
    for own in reversed(segments):
        now: dict[int, tuple] = {}
        for (p, q), (cost, audits) in own.items():
            if q in rest:
                for x in audits.values():
                    way = (cost + rest[q][0], [*rest[q][1], x])
                    if p not in now or way[0] < now[p][0] or way[0] == now[p][0] and _less(way[1], now[p][1]):
                        now[p] = way
        rest = now
    cost, parts = rest[START]
    return int(cost), parts[::-1]


def _less(a: list[str], b: list[str]) -> bool:
    """Whether the one audit is less than the other; both are lists of parts, the last part first."""
    return "".join(reversed(a)) < "".join(reversed(b))


def repair(codes: bytes) -> tuple[int, str]:
    """The least cost of a conversation's edits, and of the cheapest ones the least audit."""
    if len(codes) <= SEGMENT:
        cost, found = search(codes, START, ENDS)
        return int(cost), min(found.values())
    cost, parts = chained([summary(codes[k : k + SEGMENT]) for k in range(0, len(codes), SEGMENT)])
    return cost, "".join(parts)


class Edits:
    """Applies an audit to rows that come one by one, from a state of the form on: (role, text) of what they become."""

    def __init__(self, audit: str, state: int = START):
        self.audit, self.at, self.state = audit, 0, state

    def inserts(self) -> Iterator[tuple[str, str]]:
        """What stands before the next row, or behind the last."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, OWN[self.state]
            yield ROLES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        x, self.at = self.audit[self.at], self.at + 1
        if x == "K":
            self.state = STEP[role[:1]][self.state]
            yield role, text
        elif x == "R":
            self.state = OWN[self.state]
            yield ROLES[self.state], text


class Digest:
    """The hash of rows joined by newlines, fed as they come."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def feed(self, rows: Iterable[tuple[str, str]]) -> None:
        for role, text in rows:
            self.hash.update(f"{chr(10) * self.some}{role}:{text}".encode())
            self.some = True


# ---- rows ----

#: What sorts a conversation's rows: the turn (null first), and for rows of one turn the role and the text, by its beginning and then by
#: a hash. `copy` tells a row from its repetition.
BY = ("turn", "role", "head", "same", "copy")
#: What damage() trims to find a text's last character.
BLANKS = " \t\n\x0b\x0c\r"


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) after damage: those columns, `kept` (false for a dropped row, of which conv_id alone
    counts), fault (1 blank, 2 truncated, 0 neither) and copy (1 for a repetition). A null role or text, and a null number in
    what is hashed, is one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).when(kind == 0, "").otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind != 0).alias("kept"), kind.alias("kind"))
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1))
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 2).otherwise(0)
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return own.select("conv_id", "turn", "role", "text", "kept", fault.alias("fault"), F.explode(copies).alias("copy"))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"head": F.substring("text", 1, 64), "same": F.md5("text")})


class _Turns:
    """Gaps among turns that come in order, null ones first."""

    def __init__(self):
        self.first = self.last = None
        self.distinct = 0

    def feed(self, turn: int | None) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn

    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.distinct


class Conversation:
    """A conversation whose rows come in order and are held until it is over."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.seen, self.codes, self.turns = conv_id, [], set(), bytearray(), _Turns()
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def feed(self, turn: int | None, role: str, text: str, fault: int, same: str) -> None:
        self.turns.feed(turn)
        if self.rows:
            self.illegal += self.rows[-1][0][:1] + role[:1] not in LEGAL
        if fault == 1:
            self.blank += 1
        elif (role, same) in self.seen:
            self.duplicate += 1
            fault = 1
        else:
            self.truncated += fault == 2
        self.seen.add((role, same))
        self.rows.append((role, text))
        self.codes.append(code(role[:1], fault))

    def result(self) -> tuple:
        cost, audit = repair(bytes(self.codes))
        digest, edits = Digest(), Edits(audit)
        for row in self.rows:
            digest.feed(edits.row(*row))
        digest.feed(edits.inserts())
        return self.conv_id, self.turns.gaps(), self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hash.hexdigest()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in small(batches, 256):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _result_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([pa.field(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in RESULT.split(", "))])
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == 1024:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema)


def repaired_short(rows: DataFrame) -> DataFrame:
    """RESULT of damaged() rows, conversation by conversation, each held in memory while it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            own, began = None, False
            for conv_id, turn, role, text, kept, fault, same in _records(batches):
                if not began or own.conv_id != conv_id:
                    if began:
                        yield own.result()
                    own, began = Conversation(conv_id), True
                if kept:
                    own.feed(turn, role, text, fault, same)
            if began:
                yield own.result()

        yield from _result_batches(results())

    placed = keyed(rows.repartition("conv_id")).sortWithinPartitions("conv_id", *BY)
    return placed.select("conv_id", "turn", "role", "text", "kept", "fault", "same").mapInArrow(run, RESULT)


def repaired_long(rows: DataFrame) -> DataFrame:
    """RESULT of damaged() rows of conversations of any length.

    Rows get their places in range partitions, which a conversation may share or span. What was seen earlier is found by a
    join on hashes; segments of SEGMENT rows are searched as groups of codes, and a conversation's summaries are chained: some
    characters for each row meet in a task, as the audit itself does, but no texts. Those, with their segments' audits before
    them, come sorted through a digest."""
    no_rows = rows.groupBy("conv_id").agg(F.max("kept").alias("some")).where("NOT some").select("conv_id")
    placed = written(ordered(keyed(rows.where("kept")), [F.col("conv_id").asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in BY)]), "turns")
    placed = placed.withColumns({"conv_id": F.coalesce("conv_id", F.lit(0)), "no_id": F.col("conv_id").isNull(), "initial": F.substring("role", 1, 1)})
    ids = ["conv_id", "no_id"]
    first = placed.groupBy(*ids, "role", "same").agg(F.min("_rn").alias("first"))
    light = placed.select(*ids, "turn", "role", "same", "fault", "initial", "_rn")
    known = spread_join(light, first, [*ids, "role", "same"], F.col("_rn"), how="inner")
    again = (F.col("fault") != 1) & (F.col("_rn") > F.col("first"))
    at = F.instr(F.lit(INITIALS), F.when(F.col("initial") == "", "?").otherwise(F.col("initial")))
    coded = known.select(*ids, "turn", "initial", "_rn", (F.col("fault") == 1).cast("long").alias("blank"), again.cast("long").alias("duplicate"), ((F.col("fault") == 2) & ~again).cast("long").alias("truncated"), (3 * F.when(at > 0, at - 1).otherwise(3) + F.when(again, 1).otherwise(F.col("fault"))).cast("int").alias("code"))
    segment = F.floor(F.col("_rn") / SEGMENT)
    coded = written(coded.withColumn("segment", segment), "codes")

    def searched(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_rn")
        codes, initials = bytes(rows["code"].tolist()), rows["initial"].tolist()
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        own = [(p, q, int(c), x) for (p, q), (c, audits) in summary(codes).items() for x in audits.values()]
        head = rows.iloc[0]
        return pd.DataFrame({"conv_id": head["conv_id"], "no_id": head["no_id"], "start": head["_rn"], "illegal": illegal, "first": initials[0], "last": initials[-1], "ways": [[{"p": p, "q": q, "cost": c, "audit": x} for p, q, c, x in own]]})

    ways = "array<struct<p int, q int, cost long, audit string>>"
    found = written(coded.groupBy(*ids, "segment").applyInPandas(searched, f"conv_id long, no_id boolean, start long, illegal long, first string, last string, ways {ways}"), "segments")

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        summaries = []
        for ways_ in rows["ways"]:
            own: dict = {}
            for w in ways_:
                own.setdefault((w["p"], w["q"]), (w["cost"], {}))[1][len(w["audit"])] = w["audit"]
            summaries.append(own)
        cost, parts = chained(summaries)
        illegal = int(rows["illegal"].sum()) + sum(a + b not in LEGAL for a, b in zip(rows["last"], rows["first"].iloc[1:], strict=False))
        head = rows.iloc[0]
        return pd.DataFrame({"conv_id": head["conv_id"], "no_id": head["no_id"], "start": rows["start"], "part": parts, "cost": cost, "illegal": illegal})

    parts = written(found.groupBy(*ids).applyInPandas(joined, "conv_id long, no_id boolean, start long, part string, cost long, illegal long"), "audits")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def results():
            key = digest = edits = None
            for conv_id, no_id, _, kind, role, text, part in _records(batches):
                if (conv_id, no_id) != key:
                    if key is not None:
                        digest.feed(edits.inserts())
                        yield (*key, digest.hash.hexdigest())
                    key, digest, edits = (conv_id, no_id), Digest(), Edits("")
                if kind == 0:
                    digest.feed(edits.inserts())
                    edits = Edits(part, edits.state)
                else:
                    digest.feed(edits.row(role, text))
            if key is not None:
                digest.feed(edits.inserts())
                yield (*key, digest.hash.hexdigest())

        out = list(results())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["conv_id", "no_id", "repaired_sha256"])

    none = lambda kind: F.lit(None).cast(kind)
    heads = parts.select(*ids, F.col("start").alias("at"), F.lit(0).alias("kind"), none("string").alias("role"), none("string").alias("text"), "part")
    texts = placed.select(*ids, F.col("_rn").alias("at"), F.lit(1).alias("kind"), "role", "text", none("string").alias("part"))
    hashed = heads.unionByName(texts).repartition(*ids).sortWithinPartitions(*ids, "at", "kind").mapInArrow(digests, "conv_id long, no_id boolean, repaired_sha256 string")
    turns = coded.where("turn IS NOT NULL").select(*ids, "turn").distinct().groupBy(*ids).agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    counts = coded.groupBy(*ids).agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
    audits = parts.groupBy(*ids).agg(F.max("cost").alias("cost"), F.max("illegal").alias("illegal"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"]), "").alias("audit"))
    all_ = audits.join(counts, ids).join(hashed, ids).join(turns, ids, "left").withColumns({"conv_id": F.when(~F.col("no_id"), F.col("conv_id")), "gaps": F.coalesce("gaps", F.lit(0))})
    names = [x.split()[0] for x in RESULT.split(", ")]
    zeros = [F.lit(0).cast("long").alias(c) for c in names[1:7]]
    return all_.select(*names).unionByName(no_rows.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))


def repaired(conversations: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """RESULT of conversations (conv_id, turn, role, text): the same rows, whichever conversations count as long."""
    own = conversations.select("conv_id", "turn", "role", "text")
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("_n"), F.sum(F.length("text").cast("long")).alias("_c"))
    long_ = written(sizes.where((F.col("_n") > long_rows) | (F.col("_c") > long_chars)).select(F.col("conv_id").alias("_id")), "long")
    if long_.isEmpty():
        return repaired_short(damaged(own))
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    return repaired_short(damaged(own.join(long_, same, "left_anti"))).unionByName(repaired_long(damaged(own.join(long_, same, "left_semi"))))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults and cheapest repair. Rows with a null conv_id are one conversation; rows of one turn are ordered by
    role and text; rows that repeat are duplicates; an empty or long text is a text as any; other columns play no part."""
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, d: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
_BLANK = "[\\x20\\x09-\\x0D]"
_INSERTED = "list_reduce([{0}, {0}, {0}, {0}], lambda u, v: list_transform([1, 2, 3, 4], lambda q: list_min([u[q], {{'c': u[[3, 3, 4, 3][q]].c + 5, 'a': 'I' || u[[3, 3, 4, 3][q]].a}}])))"
#: Goes through the rows from the last one on, with the least (cost, audit) from each state. Rows of one turn are in the order of
#: their whole texts, this module's by 64 characters and a hash: the same where a turn comes once.
ORACLE = f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER w AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_replace(text, '{_BLANK}+$', '') AS core FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, core = '' AS blank, core <> '' AND seen > 1 AS duplicate, core <> '' AND seen = 1 AND right(core, 1) NOT IN ('.', '!', '?') AS truncated,
  place > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY place), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal,
  list({{'role': role, 'text': text}} ORDER BY place) AS rows,
  list({{'f': CASE WHEN blank OR duplicate THEN 1 WHEN truncated THEN 2 ELSE 0 END, 'r': CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END, 's': NULL::STRUCT(c BIGINT, a VARCHAR)[]}} ORDER BY place DESC) AS codes FROM f GROUP BY conv_id),
b AS (SELECT *, list_reduce(list_prepend({{'f': 0, 'r': 0, 's': {_INSERTED.format("[{'c': 0::BIGINT, 'a': ''}, {'c': 1000000000000, 'a': ''}, {'c': 1000000000000, 'a': ''}, {'c': 0, 'a': ''}]")}}}, codes),
  lambda x, y: {{'f': 0, 'r': 0, 's': list_reduce([list_transform([1, 2, 3, 4], lambda q: list_min(list_filter([
    {{'c': x.s[q].c + 2, 'a': 'D' || x.s[q].a}},
    CASE WHEN y.f <> 1 THEN {{'c': x.s[[3, 3, 4, 3][q]].c + 1 + 5 * (y.f // 2), 'a': 'R' || x.s[[3, 3, 4, 3][q]].a}} END,
    CASE WHEN y.f <> 1 AND [[2, 0, 0, 0], [3, 3, 0, 3], [0, 0, 4, 0], [0, 0, 0, 0]][y.r][q] > 0 THEN {{'c': x.s[[[2, 0, 0, 0], [3, 3, 0, 3], [0, 0, 4, 0], [0, 0, 0, 0]][y.r][q]].c + 5 * (y.f // 2), 'a': 'K' || x.s[[[2, 0, 0, 0], [3, 3, 0, 3], [0, 0, 4, 0], [0, 0, 0, 0]][y.r][q]].a}} END], lambda z: z IS NOT NULL)))] || [NULL, NULL, NULL],
    lambda u, v: list_transform([1, 2, 3, 4], lambda q: list_min([u[q], {{'c': u[[3, 3, 4, 3][q]].c + 5, 'a': 'I' || u[[3, 3, 4, 3][q]].a}}])))}}).s[1] AS best FROM g),
r AS (SELECT *, list_reduce(list_prepend({{'x': '', 'i': 1::BIGINT, 'q': '', 'out': NULL::VARCHAR}}, list_transform(string_split(best.a, ''), lambda z: {{'x': z, 'i': 0::BIGINT, 'q': '', 'out': NULL::VARCHAR}})),
  lambda a, z: CASE z.x WHEN 'D' THEN {{'x': '', 'i': a.i + 1, 'q': a.q, 'out': a.out}}
    WHEN 'K' THEN {{'x': '', 'i': a.i + 1, 'q': left(rows[a.i].role, 1), 'out': concat_ws(chr(10), a.out, rows[a.i].role || ':' || rows[a.i].text)}}
    WHEN 'R' THEN {{'x': '', 'i': a.i + 1, 'q': CASE a.q WHEN 'u' THEN 'a' ELSE 'u' END, 'out': concat_ws(chr(10), a.out, CASE a.q WHEN 'u' THEN 'assistant' ELSE 'user' END || ':' || rows[a.i].text)}}
    WHEN 'I' THEN {{'x': '', 'i': a.i, 'q': CASE a.q WHEN 'u' THEN 'a' ELSE 'u' END, 'out': concat_ws(chr(10), a.out, CASE a.q WHEN 'u' THEN 'assistant' ELSE 'user' END || ':')}} ELSE a END).out AS repaired FROM b),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM c LEFT JOIN r ON c.conv_id IS NOT DISTINCT FROM r.conv_id"""
