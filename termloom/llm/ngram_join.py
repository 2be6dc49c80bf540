"""Similarity join of documents by the Jaccard similarity of their word n-grams, exact, with a token-group matrix.

Documents with equal sets are one class from the start. Which classes can be similar at all is read off parts of their sets:
for sizes of one range, hashes deal all n-grams into so many parts that two sets at the threshold agree in one whole part at
least. Classes that share parts with one class, their centre, form groups of bounded size with it, and are compared within
their group. Between what is left apart decides the matrix: a group stores the union of its members' n-grams once, a class
whose n-grams overlap that union too little can be similar to no member, and only the groups that qualify are opened and their
members compared. Groups meet groups, never classes classes, and a pair of them is one row whatever they share. Every link is
verified on whole sets of 64-bit n-gram hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import Words, mix, pieces, small, spread_join, temporary, trim, written
from termloom.llm.components import components

#: Classes and n-grams that a group has at most (one class, if that has more), groups that a task compares with one at a time,
#: n-grams in a slice of the matrix, and characters whose parts meet in one task.
GROUP, GROUP_GRAMS, AT_ONCE, SLICE, BUCKET_CHARS = 128, 200_000, 32, 1 << 14, 12_000_000
_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct n-grams of words; of a text with fewer words, of all of them together."""
    words = Words(texts)
    held = np.diff(words.first)
    grams = np.zeros(max(0, len(words.hash) - n + 1), np.uint64)
    for j in range(n):
        grams += words.hash[j : j + len(grams)] * _ODD[j]
    grams = mix(grams)
    out = []
    for first, k in zip(words.first[:-1].tolist(), held.tolist(), strict=True):
        if k >= n:
            out.append(np.unique(grams[first : first + k - n + 1]))
        else:
            out.append(mix((words.hash[first : first + k] * _ODD[:k]).sum(keepdims=True, dtype=np.uint64) + np.uint64(k)) if k else np.zeros(0, np.uint64))
    return out


def class_of(own: np.ndarray) -> int:
    """A number that equal sets share."""
    return int(mix(mix(own ^ np.uint64(0xA5A5A5A5)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(own)))[0].astype(np.int64)) if len(own) else 0


class Ranges:
    """Ranges of set sizes, such that of two similar sets the smaller lies in the larger one's range or the one before."""

    def __init__(self, num: int, den: int, largest: int):
        self.low, self.parts, self.spare = [1], [], []
        while True:
            high = self.low[-1] * den // num
            differ = 2 * high * (den - num) // (den + num)  # elements in one of two similar sets alone, at most
            self.spare.append(1 + differ // 32 if differ else 0)
            self.parts.append(differ + 1 + self.spare[-1])
            self.low.append(high + 1)
            if high > largest and len(self.parts) > 1 and self.low[-2] > largest:
                break

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, "right") - 1


def part_hashes(own: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place in `own`, range, need) of each set's parts, for its range and the next.

    Two sets of similarity num/den share `need` hashes of a range or more, by either one's need: as many parts as there are,
    less one for each element that can be in one set alone, less the set's empty parts, which have no hash. Where that
    leaves nothing, the set adds a hash for each empty part, under which such sets meet each other, and needs one."""
    size = np.array([len(x) for x in own])
    full = np.flatnonzero(size)
    if not len(full):
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    ranges = Ranges(num, den, int(size.max()))
    parts, low = np.array(ranges.parts), np.array(ranges.low)
    every = np.concatenate([own[i] for i in full])
    mixed, high = mix(every ^ np.uint64(0x5EED)), every >> np.uint64(32)
    of = np.repeat(np.arange(len(full)), size[full])
    hashes, places, numbers, needs = [], [], [], []
    for ahead in (0, 1):
        number = ranges.of(size[full]) + ahead
        m = parts[number]
        part = (high * m[of].astype(np.uint64)) >> np.uint64(32)  # rises with the hashes, so parts lie together
        slot = (np.cumsum(m) - m)[of] + part.astype(np.int64)
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        salt = number.astype(np.uint64) * np.uint64(0x1000003)
        hashes.append(mix(np.add.reduceat(mixed, first) + mix(salt[of[first]] + (part[first] << np.uint64(40)))))
        places.append(full[of[first]])
        filled = np.bincount(of[first], minlength=len(full))
        n = size[full]
        largest = np.minimum(n * den // num, low[number + 1] - 1)  # of the sets that this one can be similar to here
        need = m - (n + largest) * (den - num) // (den + num) - (m - filled)
        numbers.append(number[of[first]])
        needs.append(np.maximum(need, 1)[of[first]])
        for k in np.flatnonzero(need < 1):
            empty = np.setdiff1d(np.arange(m[k]), part[first][of[first] == k].astype(np.int64)).astype(np.uint64)
            hashes.append(mix(mix(salt[k] + (empty << np.uint64(40))) ^ np.uint64(0xE)))
            places.append(np.full(len(empty), full[k]))
            numbers.append(np.full(len(empty), number[k]))
            needs.append(np.ones(len(empty), np.int64))
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(numbers), np.concatenate(needs)


def alike(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of num/den or more."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) * den < len(large) * num:
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return both * den >= (len(a) + len(b) - both) * num


def document_classes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and class of every row of docs (doc_id, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for at in pieces(texts):
                own = sets(texts[at], n)
                columns = [batch.column("doc_id").slice(at.start, at.stop - at.start), pa.array([len(x) for x in own], pa.int64()), pa.array([class_of(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "class"])
            trim()

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_shingles long, class long")


def shared_parts(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """part, class, range and need, for every part hash that two classes or more have.

    Each task packs its hashes by bucket. Those that several classes of one batch share go in as one, with a list beside
    the buckets, so that a hash which a third of all rows have puts one entry a batch into its bucket."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(12, chars // BUCKET_CHARS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for at in pieces(texts):
                own = sets(texts[at], n)
                names = np.array([class_of(x) for x in own], np.int64)
                _, once = np.unique(names, return_index=True)
                own, names = [own[i] for i in once], names[once]
                hashes, place, number, need = part_hashes(own, num, den)
                order = np.argsort(hashes, kind="stable")
                hashes, place, about = hashes[order], place[order], ((number << 16) + np.minimum(need, 65535)).astype("<u4")[order]
                first = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1))) if len(hashes) else np.zeros(0, np.int64)
                many = np.repeat(np.diff(first, append=len(hashes)) > 1, np.diff(first, append=len(hashes)))
                rows = [(-1 - int(hashes[first[0]] % np.uint64(buckets)) if len(first) else -1, hashes[many].tobytes(), names[place[many]].tobytes(), about[many].tobytes())] if many.any() else []
                bucket = (hashes[first] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                    if len(part):
                        rows.append((int(bucket[part[0]]), hashes[first[part]].tobytes(), names[place[first[part]]].tobytes(), about[first[part]].tobytes()))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["bucket", "parts", "classes", "about"]).astype({"bucket": "int64"}), schema=schema, preserve_index=False)
            trim()

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        parts = np.frombuffer(b"".join(table.column("parts").to_pylist()), np.uint64)
        names = np.frombuffer(b"".join(table.column("classes").to_pylist()), np.int64)
        about = np.frombuffer(b"".join(table.column("about").to_pylist()), "<u4").astype(np.int32)
        if key[0].as_py() >= 0:
            order = np.lexsort((names, parts))
            parts, names, about = parts[order], names[order], about[order]
            new = np.ones(len(parts), bool)
            new[1:] = (parts[1:] != parts[:-1]) | (names[1:] != names[:-1])
            parts, names, about = parts[new], names[new], about[new]
            same = parts[1:] == parts[:-1]
            keep = np.append(same, False) | np.append(False, same)
            parts, names, about = parts[keep], names[keep], about[keep]
            del order, new, same, keep
        trim()
        return pa.table({"part": pa.array(parts.view(np.int64)), "class": pa.array(names), "range": pa.array(about >> 16), "need": pa.array(about & 0xFFFF)})

    schema = pa.schema([("bucket", pa.int64()), ("parts", pa.binary()), ("classes", pa.binary()), ("about", pa.binary())])
    packed = docs.select("text").where(F.length("text") > 0).mapInArrow(pack, "bucket long, parts binary, classes binary, about binary")
    return packed.groupBy("bucket").applyInArrow(meet, "part long, class long, range int, need int")


def whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """class and set (packed sorted hashes) of the wanted classes (class, doc_id, of one row that has it)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for at in pieces(texts):
                own = sets(texts[at], n)
                yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["class", "set"])
            trim()

    known = wanted.select(F.col("doc_id").alias("_doc"), F.col("class").alias("_class"))
    texts = docs.join(known, docs["doc_id"].eqNullSafe(known["_doc"])).select("text")
    found = texts.mapInArrow(make, "class long, set binary")
    return found.join(wanted.select("class"), "class").groupBy("class").agg(F.first("set").alias("set"))


class Members:
    """Some classes and their sets, packed into a row and back."""

    COLUMNS = ("names", "sizes", "grams")

    def __init__(self, names: np.ndarray, sets: list[np.ndarray]):
        self.names, self.sets = names, sets

    @classmethod
    def of_rows(cls, table: pa.Table) -> Members:
        """From rows of a class and a set each; the repeated ones are one."""
        sets = dict(zip(table.column("class").to_pylist(), table.column("set").to_pylist(), strict=True))
        return cls(np.array(list(sets), np.int64), [np.frombuffer(x, np.uint64) for x in sets.values()])

    @classmethod
    def unpacked(cls, names: bytes, sizes: bytes, grams: bytes) -> Members:
        return cls(np.frombuffer(names, np.int64), np.split(np.frombuffer(grams, np.uint64), np.cumsum(np.frombuffer(sizes, np.int64))[:-1]))

    def packed(self, of: np.ndarray | None = None) -> tuple[bytes, bytes, bytes]:
        own = [self.sets[i] for i in (range(len(self.sets)) if of is None else of)]
        return (self.names if of is None else self.names[of]).tobytes(), np.array([len(x) for x in own], np.int64).tobytes(), b"".join(x.tobytes() for x in own)

    def similar(self, other: Members, num: int, den: int) -> np.ndarray:
        """A matrix of which of these sets have a Jaccard similarity of num/den or more with which of the others."""
        sizes, theirs = (np.array([len(x) for x in m.sets]) for m in (self, other))
        grams = np.intersect1d(np.concatenate(self.sets), np.concatenate(other.sets))
        both = np.zeros((len(sizes), len(theirs)), np.int64)
        for at in range(0, len(grams), SLICE):
            part = grams[at : at + SLICE]
            a, b = (np.stack([_within(part, x) for x in m.sets]).astype(np.float32) for m in (self, other))
            both += np.rint(a @ b.T).astype(np.int64)
        return both * den >= (sizes[:, None] + theirs[None, :] - both) * num


def _within(some: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of some sorted hashes are in a sorted set."""
    return own[np.minimum(np.searchsorted(own, some), len(own) - 1)] == some if len(own) else np.zeros(len(some), bool)


def spanning(alike: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect what the ones of a matrix connect, one at most for each row and column: from each part's first row."""
    left, open_, a, b = alike.any(axis=1), np.ones(len(columns), bool), [], []
    for start in np.flatnonzero(left):
        front = np.array([start]) if left[start] else np.zeros(0, int)
        while len(front):  # rows reached anew, and what they reach
            left[front] = False
            met = np.flatnonzero(alike[front].any(axis=0) & open_)
            open_[met] = False
            a += [rows[start]] * (len(front) + len(met))
            b += [*rows[front].tolist(), *columns[met].tolist()]
            front = np.flatnonzero(alike[:, met].any(axis=1) & left)
    return a, b


def linked_within(groups: DataFrame, whole: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect whatever is similar within a group; groups: group and class."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        own = Members.of_rows(table)
        a, b = spanning(own.similar(own, num, den), own.names, own.names)
        found = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        return found.filter(pa.array(np.array(a) != np.array(b)))

    return groups.join(whole, "class").groupBy("group").applyInArrow(compare, "a long, b long")


def matrix(groups: DataFrame, whole: DataFrame) -> DataFrame:
    """The token-group matrix: of each group its members' names, set sizes and sets, and the union of the sets, packed."""

    def store(key: tuple, table: pa.Table) -> pa.Table:
        own = Members.of_rows(table)
        row = (*own.packed(), np.unique(np.concatenate(own.sets)).tobytes())
        return pa.table({"group": key[0:1], **{c: pa.array([x], pa.binary()) for c, x in zip((*Members.COLUMNS, "union"), row, strict=True)}})

    return groups.join(whole, "class").groupBy("group").applyInArrow(store, "group long, names binary, sizes binary, grams binary, union binary")


def portioned(rows: DataFrame, stored: DataFrame, key: str) -> tuple:
    """rows and stored (a row for each key), to be grouped together: AT_ONCE rows or so with a copy of their key's."""
    turn = [c for c in rows.columns if c in ("a", "b")]
    portions = rows.groupBy(key).agg(F.ceil(F.count("*") / AT_ONCE).cast("int").alias("portions"))
    dealt = spread_join(rows, portions, [key], F.struct(*turn), how="inner").withColumn("portion", F.pmod(F.xxhash64(*turn), F.col("portions")).cast("int"))
    copies = stored.join(portions.select(F.col(key).alias("group"), F.col("portions").alias("copies")), "group").withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return dealt.groupBy(key, "portion"), copies.groupBy("group", "portion")


def qualifying(pairs: DataFrame, stored: DataFrame, num: int, den: int) -> DataFrame:
    """a, b and, packed, those members of group a that overlap the union of group b enough to be similar to one of b's members."""

    def bound(mine: pa.Table, own: pa.Table) -> pa.Table:
        rows = []
        if len(mine) and len(own):
            members = Members.unpacked(*(own.column(c)[0].as_py() for c in Members.COLUMNS))
            for a, b, union in zip(*(mine.column(c).to_pylist() for c in ("a", "b", "union")), strict=True):
                union = np.frombuffer(union, np.uint64)
                # A similar member shares num/den of the query at least, all of it within the union.
                of = np.array([i for i, x in enumerate(members.sets) if int(_within(x, union).sum()) * den >= len(x) * num], int)
                if len(of):
                    rows.append((a, b, *members.packed(of)))
        return pa.table({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(("a", "b", *Members.COLUMNS), (*[pa.int64()] * 2, *[pa.binary()] * 3), strict=True))})

    unions = stored.select(F.col("group").alias("b"), "union")
    asked, held = portioned(pairs.join(unions, "b").select("a", "b", "union"), stored.drop("union"), "a")
    return asked.cogroup(held).applyInArrow(bound, "a long, b long, names binary, sizes binary, grams binary")


def opened(queries: DataFrame, stored: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that connect the queries' classes with the members that they are similar to, of the groups that the bound
    lets through."""

    def compare(mine: pa.Table, own: pa.Table) -> pa.Table:
        a, b = [], []
        if len(mine) and len(own):
            members = Members.unpacked(*(own.column(c)[0].as_py() for c in Members.COLUMNS))
            for row in zip(*(mine.column(c).to_pylist() for c in Members.COLUMNS), strict=True):
                asked = Members.unpacked(*row)
                for out, own_links in zip((a, b), spanning(asked.similar(members, num, den), asked.names, members.names), strict=True):
                    out += own_links
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    asked, held = portioned(queries, stored.drop("union"), "b")
    return asked.cogroup(held).applyInArrow(compare, "a long, b long")


def chunked(classes: DataFrame, by: str) -> DataFrame:
    """classes (class, n_shingles, and what it groups by), with group: chunks of bounded size of those with equal `by`."""
    size = classes.groupBy(by).agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n_shingles") / GROUP_GRAMS)).cast("int").alias("_chunks"))
    dealt = spread_join(classes, size, [by], F.col("class"), how="inner")
    return dealt.withColumn("group", F.xxhash64(by, F.pmod(F.xxhash64("class", F.lit(1)), F.col("_chunks")))).drop("_chunks")


def class_components(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node (a class) and root (its component), for the classes with links to others."""
    with temporary(docs.sparkSession) as keep:
        parts = keep(shared_parts(docs, n, num, den).distinct(), "parts")
        # A class that shares fewer parts than it needs with all others together is similar to none.
        enough = parts.groupBy("class", "range").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("class", "range")
        parts = keep(spread_join(parts, enough, ["class", "range"], F.col("part"), how="inner"), "parts")
        about = classes.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
        wanted = keep(parts.select("class").distinct().join(about, "class"), "wanted")
        whole = keep(whole_sets(docs, wanted, n), "sets")
        # The centre of a part is one of its classes. Of the centres with which it shares as many parts as it needs, a class takes
        # the first one by hash, so that classes with much in common meet at few.
        centre = parts.groupBy("part").agg(F.min(F.struct(F.xxhash64("class").alias("turn"), F.col("class").alias("centre"))).alias("c"))
        around = spread_join(parts, centre, ["part"], F.col("class"), how="inner").where("class <> c.centre")
        around = around.groupBy("class", "c", "range").agg(F.count("*").alias("n"), F.max("need").alias("need"))
        first = around.groupBy("class").agg(F.min(F.struct((F.col("n") < F.col("need")).alias("few"), "c.turn", "c.centre")).alias("f")).select("class", F.col("f.centre").alias("near"))
        grouped = keep(chunked(wanted.join(first, "class", "left").withColumn("near", F.coalesce("near", "class")), "near"), "groups")
        # Every group of a centre has the centre too, which so links all of them.
        members = grouped.select("group", "class").unionByName(grouped.select("group", F.col("near").alias("class"))).distinct()
        several = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
        links = keep(linked_within(members.join(several, "group"), whole, num, den), "links")
        joined = components(links).withColumnRenamed("node", "class")
        pairs, groups = apart(keep, parts, grouped.join(joined, "class", "left"))
        pairs, stored = keep(pairs, "pairs"), keep(matrix(groups, whole), "matrix")
        queries = keep(qualifying(pairs, stored, num, den), "queries")
        return components(links.unionByName(keep(opened(queries, stored, num, den), "links")))


def apart(keep: Callable[[DataFrame, str], DataFrame], parts: DataFrame, about: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, groups): pairs (a, b) of groups, some of them with themselves, that share parts enough to have similar members of
    different components, and the classes of these groups. about: class, n_shingles and root (null: its own component); keep stores tables.

    Classes of one component form groups, and so do those without another that share parts with one component."""
    about = about.select("class", "n_shingles", F.coalesce("root", "class").alias("component"), F.col("root").isNull().alias("alone"))
    of_part = spread_join(parts, about, ["class"], F.col("part"), how="inner")
    mixed = of_part.groupBy("part").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("part", "x")
    of_part = spread_join(of_part, mixed, ["part"], F.col("class"), how="inner")
    enough = of_part.groupBy("class", "range").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("class", "range")
    of_part = keep(spread_join(of_part, enough, ["class", "range"], F.col("part"), how="inner"), "apart")
    classes = of_part.groupBy("class", "n_shingles", "component", "alone").agg(F.min("x").alias("beside"))
    classes = classes.withColumn("of", F.xxhash64("alone", F.when(F.col("alone"), F.col("beside")).otherwise(F.col("component"))))
    groups = keep(chunked(classes, "of").select("class", "group"), "groups")
    met = spread_join(of_part, groups, ["class"], F.col("part"), how="inner").groupBy("part", "range", "group")
    met = met.agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("need").alias("need"))
    a, b = (met.select("part", *(F.col(c).alias(f"{c}_{x}") for c in ("range", "group", "low", "high", "need"))) for x in "ab")
    both = a.join(b, "part").where("group_a <= group_b AND range_a = range_b AND NOT (low_a = high_b AND high_a = low_b)")
    pairs = both.groupBy("group_a", "group_b", "range_a").agg(F.count("*").alias("n"), F.greatest(F.min("need_a"), F.min("need_b")).alias("need")).where("n >= need")
    return pairs.select(F.col("group_a").alias("a"), F.col("group_b").alias("b")).distinct(), groups


def similar(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, class and component_id (the least doc_id connected by links of similarity num/den or more).

    Words, white space and case are those of common.Words. Documents without words are linked with nothing, their own
    component each. Equal sets share a class. Repeated rows and doc_ids are documents of their own; of a component without
    any doc_id the component_id is null."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    classes = written(document_classes(docs, n), "classes")
    filled = classes.where("n_shingles > 0")
    roots = class_components(docs, filled, n, num, den).withColumnRenamed("node", "class")
    rooted = spread_join(filled, roots, ["class"], F.struct("doc_id")).withColumn("root", F.coalesce("root", "class"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = spread_join(rooted, least, ["root"], F.struct("doc_id")).select("doc_id", "n_shingles", "class", "component_id")
    return out.unionByName(classes.where("n_shingles = 0").select("doc_id", "n_shingles", "class", F.col("doc_id").alias("component_id")))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component by 4-word shingles at a Jaccard similarity of 0.85. Null and empty texts have no shingles and
    are their own components; repeated rows come as often as they do, equal sets being linked; of a component without any doc_id
    the component_id is null."""
    found = similar(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)
    return found.select("doc_id", "n_shingles", "component_id")
