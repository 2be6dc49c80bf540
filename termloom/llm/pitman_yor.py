"""A hierarchical Pitman-Yor language model of words, learnt and applied over the whole corpus.

Each word is a context restaurant, where the words that follow it are seated; each table there is a customer of the one parent
that all contexts share, and the parent's tables are drawn from a uniform distribution over all words and an unknown one. Seating
is sampled by Gibbs: first the tables of every context's words, then for each sample the parent's tables given those, and the
contexts' tables given that parent. A text's probability averages the predictive probabilities of the samples.

Neither counts nor probabilities of words go through the driver, but for a bounded number of frequent words, common contexts
and hot pairs. Pairs of neighbouring words are dealt out by context in packed arrays, the few contexts that make up much of any
corpus by both words. A bucket of contexts seats its restaurants and sends each word's tables to the word's bucket, where the
parent is sampled; the answers come back to the buckets that asked, where the parts of every text's score are added up. What
travels and what is stored grows with the corpus, and no word shares its counts with others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import Words, mix, pieces, temporary, trim, written

CELLS, BLOCKS = 1 << 20, 64
#: A word is frequent from this part of all tokens on, a pair hot, and a context common: so many of them there can be at most.
FREQUENT, HOT, COMMON = 1 / (1 << 18), 1 / (1 << 18), 1 / 1000
#: Tokens packed together in a task, characters for each bucket of contexts, such buckets for each bucket of words, Gibbs sweeps
#: of a bucket's restaurants before its tables are taken, samples averaged, and sweeps for each of them.
PACK_TOKENS, BUCKET_CHARS, PER_WORDS, BURN_IN, SAMPLES, SWEEPS = 1_000_000, 8_000_000, 4, 3, 3, 2
THETA, ROOT_THETA, ROOT_DISCOUNT = 1.0, 10.0, 0.5
START, END = (mix(np.array([x], np.uint64))[0] for x in (0x57A127, 0xE2D))
#: Words travel as the lower 40 bits of their hashes, in two arrays.
WORD_BITS = np.uint64(40)
_WORD, _LOW = (np.uint64(1) << WORD_BITS) - np.uint64(1), np.uint64(0xFFFFFFFF)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; null doc_ids aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def _stirling(discount: float, most: int = 64) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: ways to seat c customers at t tables, by weight."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, :-1][: c + 1], np.log(np.maximum(c - discount * t, 0)) + out[c, 1 : c + 2])
    return out


def tables_of_many(c: np.ndarray, prior: np.ndarray, theta: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the number of tables of c customers, by the saddle point of the generating function of one table
    and others beside it, (1 - (1 - z) ** discount) (1 - prior (1 - (1 - z) ** discount)) ** (-theta / discount - 1).

    theta: the restaurant's, with the rest of its tables. The mean is off by a sixth of the deviation at most at 64 customers."""
    low, high = np.full(len(c), -700.0), np.zeros(len(c))  # of log(1 - z): the customers expected fall as it rises
    for _ in range(60):
        y = (low + high) / 2
        step = -np.expm1(discount * y)
        many = discount * -np.expm1(y) * np.exp((discount - 1) * y) / step * (1 + (theta / discount + 1) * prior * step / (1 - prior * step)) > c
        low, high = np.where(many, y, low), np.where(many, high, y)
    left, step = np.exp(high), -np.expm1(discount * high)
    z, each = 1 - left, discount * (1 - left) * left ** (discount - 1) / step
    others = (theta / discount + 1) * prior * step / (1 - prior * step)
    with np.errstate(over="ignore", invalid="ignore"):
        spread = (1 - discount) * discount * z * z * left ** (discount - 2) / step + each - each * each
        var = others / (1 - prior * step)
        var = var * (1 + others) * spread / (var * each * each + (1 + others) * spread)
    return 1 + others, np.sqrt(np.maximum(np.where(np.isfinite(var), var, others), 0))


def seat(count: np.ndarray, place: np.ndarray, tables: np.ndarray, prior: np.ndarray, total: np.ndarray, discount: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """One Gibbs sweep: new numbers of tables of dishes, given those of the rest of their restaurants.

    count, tables, prior: customers, tables and parent's probability of each dish; place: its restaurant; total: tables of
    each restaurant. Up to 64 customers the number is drawn from its exact conditional distribution, beyond from a normal
    one with its mean and variance."""
    new = np.minimum(count, 1)
    rest = np.maximum(total[place] - tables, 0)
    table = _stirling(discount)
    order = np.argsort(count, kind="stable")
    some, first = np.unique(count[order], return_index=True)
    for c, start, stop in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        if not 1 < c <= 64:
            continue
        for at in range(start, stop, 200_000 // c + 1):
            own = order[at : min(stop, at + 200_000 // c + 1)]
            k = np.arange(1, c + 1)
            opens = np.cumsum(np.log(theta + discount * (rest[own][:, None] + np.arange(c))), axis=1)
            weight = table[c, 1 : c + 1] + opens + k * np.log(prior[own])[:, None]
            weight = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
            new[own] = 1 + (weight < rng.random(len(own))[:, None] * weight[:, -1:]).sum(1)
    large = np.flatnonzero(count > 64)
    if len(large):
        mean, deviation = tables_of_many(count[large].astype(float), np.minimum(prior[large], 1 - 1e-9), theta + discount * rest[large], discount)
        new[large] = np.clip(np.rint(mean + deviation * rng.normal(size=len(large))), 1, count[large])
    return new


def _find(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted names, and whether they are there."""
    if not len(names):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return at, names[at] == x


@dataclass
class Known:
    """What every task holds: training tokens; frequent words (hashes, sorted, and by their travelling bits), their counts and,
    by sample, parent's probabilities; an unknown word's by sample; common contexts with their customers and tables; hot pairs
    with the logarithms of their chances, and customers and tables of hot pairs by context."""

    total: int
    words: np.ndarray
    counts: np.ndarray
    common: np.ndarray
    discount: float = 0.75
    own: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    #: By sample: what one of the parent's customers, one of its tables, and nothing but the base give.
    customer: float = 0.0
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))
    customers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tables: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_log: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_customers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hot_tables: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.short = self.words & _WORD
        self.by_short = np.argsort(self.short, kind="stable")
        self.short = self.short[self.by_short]

    def place(self, word: np.ndarray) -> np.ndarray:
        """Places among the frequent words of words' travelling bits; -1: none."""
        at, there = _find(self.short, word)
        return np.where(there, self.by_short[at] if len(self.by_short) else -1, -1)

    def probability(self, customers: np.ndarray, tables: np.ndarray, sample: int) -> np.ndarray:
        """The parent's predictive probability of words with so many customers and tables there."""
        return (customers - ROOT_DISCOUNT * tables) * self.customer + self.base[sample]


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(context ^ mix(word & _WORD))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of some documents of a task together: number, doc_ids, held-out flags, tokens of each, and context, word and document
    of every pair of neighbours (a start before the first word, an end after the last)."""
    seq, held, size = 0, [], 0
    for batch in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
        texts, ids, out = batch.column("text").to_pylist(), batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False)
        for at in pieces(texts):
            words = Words(texts[at])
            n = np.diff(words.first) + 1
            end = np.cumsum(n)
            word = np.zeros(end[-1], np.uint64)
            word[end - 1] = END
            inner = np.ones(len(word), bool)
            inner[end - 1] = False
            word[inner] = words.hash
            context = np.concatenate([word[:1], word[:-1]])
            context[end - n] = START
            held.append((ids.slice(at.start, at.stop - at.start), out[at], n, context, word))
            size += len(word)
            if size > PACK_TOKENS or sum(len(x[2]) for x in held) > 20_000:
                yield seq, *_joined(held)
                seq, size = seq + 1, 0
                trim()
    if held:
        yield seq, *_joined(held)


def _joined(held: list[tuple]) -> tuple:
    """The parts of a pack as one; held is emptied, so that whoever takes the pack can let go of its arrays."""
    n = np.concatenate([x[2] for x in held])
    ids, out = pa.concat_arrays([x[0] for x in held]), np.concatenate([x[1] for x in held]).astype(bool)
    context, word = (np.concatenate([x[k] for x in held]) for k in (3, 4))
    held.clear()
    return ids, out, n, context, word, np.repeat(np.arange(len(n), dtype=np.uint16), n)  # a pack has fewer than 2 ** 15 documents


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_VECTOR = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])


def _sparse(kind: str, vector: np.ndarray, size: int) -> list[tuple]:
    """A vector's entries that aren't zero, in blocks of places."""
    at = np.flatnonzero(vector)
    cut = np.searchsorted(at, np.arange(1, BLOCKS) * -(-size // BLOCKS))
    return [(kind, i, x.astype("<u4").tobytes(), vector[x].astype("<i8").tobytes()) for i, x in enumerate(np.split(at, cut)) if len(x)]


def _summed(rows: DataFrame, sizes: dict[str, int]) -> dict[str, np.ndarray]:
    """The vectors of each kind, added up in blocks; of sizes that parameters bound."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sizes[key[0].as_py()], np.int64)
        for batch in batches:
            for places, counts in zip(batch.column("places").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[np.frombuffer(places, "<u4")] += np.frombuffer(counts, "<i8")
        yield _rows(_VECTOR, [(key[0].as_py(), key[1].as_py(), (at := np.flatnonzero(total)).astype("<u4").tobytes(), total[at].tobytes())])

    out = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
    for r in rows.groupBy("kind", "block").applyInArrow(add, "kind string, block long, places binary, counts binary").collect():
        out[r.kind][np.frombuffer(r.places, "<u4")] += np.frombuffer(r.counts, "<i8")
    return out


def count_words(docs: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Training tokens, frequent words (hashes, the end among them) with their counts, and common contexts, from two passes over
    the texts: a frequent word's cell has as many tokens as the word, so only words of such cells are counted, by whole words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for _, _, out, _, _, word, doc in _pairs(batches):
            cells += np.bincount((word[~out[doc]] & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        yield _rows(_VECTOR, _sparse("cells", cells, CELLS))

    cells = _summed(docs.mapInArrow(count, "kind string, block long, places binary, counts binary"), {"cells": CELLS})["cells"]
    total = int(cells.sum())
    least = max(3, total * FREQUENT)
    heavy = cells >= least
    heavy[int(END & np.uint64(CELLS - 1))] = True
    heavy = docs.sparkSession.sparkContext.broadcast(heavy)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, out, _, _, word, doc in _pairs(batches):
            word = word[~out[doc]]
            names, n = np.unique(word[heavy.value[(word & np.uint64(CELLS - 1)).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    # Fewer than one in FREQUENT words can have so many tokens: the bound of what comes to the driver.
    end = int(END.astype(np.int64))
    often = docs.mapInArrow(words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("word") == end)).toPandas()
    names, n = often["word"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    if END not in names:
        names, n = np.append(names, END), np.append(n, 0)
    order = np.argsort(names)
    names, n = names[order], n[order]
    return total, names, n, np.unique(np.append(names[(n >= max(3, total * COMMON)) & (names != END)], START))


def _bucket(context: np.ndarray, word: np.ndarray, buckets: int, common: np.ndarray) -> np.ndarray:
    """Where a pair goes: by its context; by both words if the context is common."""
    out = (context % np.uint64(buckets)).astype(np.int32)
    spread = np.flatnonzero(_find(common, context)[1])
    out[spread] = _pair(context[spread], word[spread]) % np.uint64(buckets)
    return out


_PACKED = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), *((c, pa.binary()) for c in ("contexts", "sizes", "low", "high", "n", "docs"))])
_PACKED_DDL = "bucket long, batch long, contexts binary, sizes binary, low binary, high binary, n binary, docs binary"


def _packed(context: np.ndarray, word: np.ndarray, each: np.ndarray, docs: bool, known: Known, buckets: int, batch: int) -> pa.RecordBatch:
    """A row for each bucket: its distinct contexts, how many words each has there, those words, and how many entries each pair
    has. each: of every pair, its document and flag, kept entry by entry (docs), or else what is added up by pair."""
    bucket, word = _bucket(context, word, buckets, known.common), word & _WORD
    order = np.lexsort((word, context, bucket))
    context, word, bucket, each = context[order], word[order], bucket[order], each[order]
    first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))[: len(word)])
    n = np.diff(first, append=len(word)) if docs else np.add.reduceat(each, first) if len(first) else first
    if not docs:  # a frequent word that no training document has there need not be asked for
        kept = (n > 0) | (known.place(word[first]) < 0)
        first, n = first[kept], n[kept]
    context, word, bucket = context[first], word[first], bucket[first]
    cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    entries = np.concatenate([[0], np.cumsum(n)]) if docs else None
    rows = []
    for start, stop in pairwise(cut):
        if stop > start:
            own, w = context[start:stop], word[start:stop]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            listed = each[entries[start] : entries[stop]].tobytes() if docs else b""
            sizes = np.diff(new, append=len(own)).astype("<u4")
            rows.append((int(bucket[start]), batch, own[new].tobytes(), sizes.tobytes(), (w & _LOW).astype("<u4").tobytes(), (w >> np.uint64(32)).astype(np.uint8).tobytes(), n[start:stop].astype("<u4").tobytes(), listed))
    return _rows(_PACKED, rows)


def _joined_words(low: list[bytes], high: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(low), "<u4").astype(np.uint64) | (np.frombuffer(b"".join(high), np.uint8).astype(np.uint64) << np.uint64(32))


class Restaurants:
    """The contexts of a bucket: names (sorted), and of distinct pairs the context's place and the word; `of` each pair given."""

    def __init__(self, table: pa.Table):
        column = lambda c: table.column(c).to_pylist()
        contexts = np.frombuffer(b"".join(column("contexts")), "<u8")
        self.sizes = np.frombuffer(b"".join(column("sizes")), "<u4")
        self.names, at = np.unique(contexts, return_inverse=True)
        keys = (np.repeat(at, self.sizes).astype(np.uint64) << WORD_BITS) | _joined_words(column("low"), column("high"))
        self.n = np.frombuffer(b"".join(column("n")), "<u4")
        keys, self.of = np.unique(keys, return_inverse=True)
        self.place, self.word = (keys >> WORD_BITS).astype(np.int64), keys & _WORD

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, x, len(self.names)).astype(np.int64)


_SEATED = "kind string, block long, places binary, counts binary, bucket long, low binary, high binary, once long, twice long, kinds long"


def seat_contexts(docs: DataFrame, known: Known, buckets: int, word_buckets: int) -> DataFrame:
    """Seats all training pairs, by bucket, before there is a parent: a word's share of the tokens stands for it. Rows by kind:

    tables: tables of frequent words; customers, seats: of common contexts; words: for a word bucket (block), words that aren't
    frequent and their tables in this bucket, none if only texts kept from learning have them here; hot: hot pairs, with their
    customers and their context's customers and tables; stats: pairs seen once and twice, and different words."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("places", pa.binary()), ("counts", pa.binary()), ("bucket", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("once", pa.int64()), ("twice", pa.int64()), ("kinds", pa.int64())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, out, _, context, word, doc in _pairs(batches):
            yield _packed(context, word, (~out[doc]).astype(np.int64), False, shared.value, buckets, 0)
            trim()

    def seated(key: tuple, table: pa.Table) -> pa.Table:
        own, bucket = shared.value, key[0].as_py()
        rng, at = np.random.default_rng(bucket), Restaurants(table)
        count = np.bincount(at.of, at.n, len(at.word)).astype(np.int64)
        names, word = np.unique(at.word, return_inverse=True)
        place = own.place(names)
        here = np.bincount(word, count, len(names)) / max(1, int(count.sum()))
        prior = np.clip(np.where(place >= 0, own.counts[place] / max(1, own.total), np.minimum(here, FREQUENT)), 1e-12, 1 - 1e-9)[word]
        tables = np.minimum(count, 1)
        for _ in range(BURN_IN):
            tables = seat(count, at.place, tables, prior, at.sums(tables), own.discount, THETA, rng)
        by_word = np.bincount(word, tables, len(names)).astype(np.int64)
        customers, total = at.sums(count), at.sums(tables)
        common, is_common = _find(own.common, at.names)
        rows = []
        for kind, where, x, size in (("tables", place[place >= 0], by_word[place >= 0], len(own.words)), ("customers", common[is_common], customers[is_common], len(own.common)), ("seats", common[is_common], total[is_common], len(own.common))):
            rows += [(*r, bucket, *[None] * 5) for r in _sparse(kind, np.bincount(where, x, size).astype(np.int64), size)]
        rare, n = names[place < 0], by_word[place < 0]
        to = (mix(rare) % np.uint64(word_buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            if len(part):
                w = rare[part]
                rows.append(("words", int(to[part[0]]), None, n[part].astype("<u4").tobytes(), bucket, (w & _LOW).astype("<u4").tobytes(), (w >> np.uint64(32)).astype(np.uint8).tobytes(), *[None] * 3))
        hot = np.flatnonzero(count >= max(3, own.total * HOT))
        if len(hot):
            figures = np.stack([count[hot], customers[at.place[hot]], total[at.place[hot]]]).astype("<i8")
            rows.append(("hot", 0, at.names[at.place[hot]].tobytes(), figures.tobytes(), bucket, at.word[hot].tobytes(), *[None] * 4))
        rows.append(("stats", 0, None, None, bucket, None, None, int((count == 1).sum()), int((count == 2).sum()), int(((customers > 0) & ~is_common).sum())))
        del at, count, word, prior, tables
        trim()
        return pa.Table.from_batches([_rows(schema, rows)])

    packed = docs.mapInArrow(pack, _PACKED_DDL)
    return packed.groupBy("bucket").applyInArrow(seated, _SEATED)


_ANSWER = "bucket long, low binary, high binary, customers binary, tables binary, n long, sums array<long>"


def seat_parent(words: DataFrame, tables: int) -> DataFrame:
    """Samples of the parent's tables of all words that aren't frequent. For each bucket that asked, its words with their
    customers and, sample after sample, tables; and, with no bucket, sums of customers and of each sample's tables."""
    schema = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("low", "high", "customers", "tables")), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def sample(key: tuple, table: pa.Table) -> pa.Table:
        rng = np.random.default_rng([1, key[0].as_py()])
        column = lambda c: table.column(c).to_pylist()
        names, of = np.unique(_joined_words(column("low"), column("high")), return_inverse=True)
        n = np.bincount(of, np.frombuffer(b"".join(column("counts")), "<u4"), len(names)).astype(np.int64)
        drawn = [parent_tables(n, tables, rng) for _ in range(SAMPLES)]
        rows, first = [(None, None, None, None, None, int(n.sum()), [int(x.sum()) for x in drawn])], 0
        for bucket, low, high in zip(column("bucket"), column("low"), column("high"), strict=True):
            own = of[first : first + len(high)]
            first += len(high)
            rows.append((bucket, low, high, n[own].astype("<u4").tobytes(), b"".join(x[own].astype("<u4").tobytes() for x in drawn), None, None))
        return pa.Table.from_batches([_rows(schema, rows)])

    return written(words.groupBy("block").applyInArrow(sample, _ANSWER), "parent")


def parent_tables(customers: np.ndarray, tables: int, rng: np.random.Generator) -> np.ndarray:
    """A draw of the parent's tables of words with so many customers, where `tables` stands for all of them together."""
    at = np.zeros(len(customers), np.int64)
    return seat(customers, at, np.minimum(customers, 1), np.full(len(customers), 1 / (tables + 1)), np.array([tables]), ROOT_DISCOUNT, ROOT_THETA, rng)


def chances(known: Known, count: np.ndarray, place: np.ndarray, prior: list[np.ndarray], customers: np.ndarray, total: np.ndarray | None, rng: np.random.Generator, extra: tuple | None = None) -> np.ndarray:
    """Predictive probabilities of pairs, averaged over the samples. customers and total: of restaurants; extra: (which
    restaurants' tables are known, their tables, and tables elsewhere of all), else all are known."""
    chance = np.zeros(len(count))
    for p in prior:
        tables = np.minimum(count, 1)
        for sweep in range(SWEEPS + 1):
            if extra is not None:
                fixed, given, more = extra
                total = np.where(fixed, given, np.bincount(place, tables, len(customers)).astype(np.int64) + more)
            if sweep < SWEEPS:
                tables = seat(count, place, tables, p, total, known.discount, THETA, rng)
        seated = (count - known.discount * tables + (THETA + known.discount * total[place]) * p) / (THETA + customers[place])
        chance += np.where(customers[place] > 0, seated, p) / len(prior)
    return chance


def with_hot_pairs(known: Known, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], rng: np.random.Generator) -> Known:
    """known, with the hot pairs (contexts, words, and their customers, their contexts' customers and tables) seated."""
    context, word, (count, customers, total) = pairs
    at, common = _find(known.common, context)
    customers, total = np.where(common, known.customers[at], customers), np.where(common, known.tables[at], total)
    own = [p[known.place(word)] for p in known.own]
    chance = chances(known, count, np.arange(len(count)), own, customers, np.maximum(total, 1), rng)
    tables = seat(count, np.arange(len(count)), np.minimum(count, 1), np.mean(own, axis=0), np.maximum(total, 1), known.discount, THETA, rng)
    order = np.argsort(pair := _pair(context, word))
    known.hot, known.hot_log = pair[order], np.log10(chance)[order]
    known.hot_contexts, of = np.unique(context, return_inverse=True)
    known.hot_customers, known.hot_tables = (np.bincount(of, x, len(known.hot_contexts)).astype(np.int64) for x in (count, tables))
    return known


_PART = pa.schema([("batch", pa.int64()), *((c, pa.binary()) for c in ("place", "model", "base_place", "base", "known", "ids", "valid", "out", "tokens"))])
_PART_DDL = "batch long, place binary, model binary, base_place binary, base binary, known binary, ids binary, valid binary, out binary, tokens binary"


def part_scores(docs: DataFrame, known: Known, answers: DataFrame, buckets: int) -> DataFrame:
    """Rows by batch (a pack of a task): what a bucket adds to the scores of the pack's documents, at their places there; and a
    row with the documents' ids, flags and tokens and what the frequent words and hot pairs add.

    The counts of a context's word are a bucket's own; those of frequent contexts' words are known before."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, ids, out, n, context, word, doc in _pairs(batches):
            own, batch = shared.value, (part << 32) + seq
            at, frequent = _find(own.words, word)
            seen, log = np.where(frequent, own.counts[at], 0), np.zeros(len(word))
            log[frequent] = np.log10(seen[frequent] + 0.5)
            base, seen = np.bincount(doc, log, len(n)), np.bincount(doc, seen > 0, len(n))
            at, hot = _find(own.hot, _pair(context, word))
            model = np.bincount(doc[hot], own.hot_log[at[hot]], len(n)) if len(own.hot) else np.zeros(len(n))
            flag = (doc | (out[doc].astype(np.uint16) << 15))[~hot]
            context, word = context[~hot], word[~hot]
            del log, at, hot, frequent, doc
            yield _packed(context, word, flag, True, own, buckets, batch)
            del context, word, flag
            valid = np.array(ids.is_valid())
            ids = np.where(valid, np.array(ids.fill_null(0)), 0).astype("<i8")
            every = np.arange(len(n), dtype="<u2").tobytes()
            about = _rows(_PART, [(batch, every, model.tobytes(), every, base.tobytes(), seen.astype("<u4").tobytes(), ids.tobytes(), valid.tobytes(), out.tobytes(), n.astype("<i8").tobytes())])
            yield _rows(_PACKED, [(-1 - batch, batch, *[None] * 5, _bytes(about))])

    def score(asked: pa.Table, told: pa.Table) -> pa.Table:
        if not len(asked):
            return pa.Table.from_batches([], _PART)
        bucket = asked.column("bucket")[0].as_py()
        if bucket < 0:  # a pack's own row
            return pa.ipc.open_stream(asked.column("docs")[0].as_py()).read_all()
        own, rng, at = shared.value, np.random.default_rng([2, bucket]), Restaurants(asked)
        blobs = asked.column("docs").to_pylist()
        docs = np.frombuffer(b"".join(blobs), "<u2")
        given = np.repeat(np.arange(len(at.n)), at.n)  # of every entry, the pair in its pack
        count = np.bincount(at.of[given], docs < 1 << 15, len(at.word)).astype(np.int64)
        names, word = np.unique(at.word, return_inverse=True)
        frequent = own.place(names)
        column = lambda c: told.column(c).to_pylist() if len(told) else []
        rare, n = _joined_words(column("low"), column("high")), np.frombuffer(b"".join(column("customers")), "<u4")
        drawn = [np.frombuffer(x, "<u4").reshape(SAMPLES, -1) for x in column("tables")]
        drawn = np.concatenate(drawn, axis=1) if drawn else np.zeros((SAMPLES, 0), "<u4")
        order = np.argsort(rare)
        rare, n, drawn = rare[order], n[order], drawn[:, order]
        to, there = _find(rare, names)
        prior = []
        for s in range(SAMPLES):
            p = np.full(len(names), own.base[s])
            p[there] = own.probability(n[to[there]], drawn[s][to[there]], s)
            p[frequent >= 0] = own.own[s][frequent[frequent >= 0]]
            prior.append(p[word])
        del names, word, rare, n, drawn, order
        hot, has_hot = _find(own.hot_contexts, at.names)
        more = lambda x: np.where(has_hot, x[hot], 0) if len(x) else np.zeros(len(at.names), np.int64)
        common, is_common = _find(own.common, at.names)
        customers = np.where(is_common, own.customers[common], at.sums(count) + more(own.hot_customers))
        chance = chances(own, count, at.place, prior, customers, None, rng, (is_common, own.tables[common], more(own.hot_tables)))
        model = np.log10(chance)
        rarely = ~(_find(own.words, at.names)[1] | (at.names == START))
        rows, entry = [], 0
        for batch, blob in zip(asked.column("batch").to_pylist(), blobs, strict=True):
            mine = at.of[given[entry : entry + len(blob) // 2]]
            doc = docs[entry : entry + len(blob) // 2] & 0x7FFF
            entry += len(blob) // 2
            place, to = np.unique(doc, return_inverse=True)
            add = np.bincount(to, model[mine], len(place))
            context = at.place[mine]
            here = rarely[context]
            base_place, to = np.unique(doc[here], return_inverse=True)
            seen = customers[context[here]]
            rows.append((batch, place.astype("<u2").tobytes(), add.tobytes(), base_place.astype("<u2").tobytes(), np.bincount(to, np.log10(seen + 0.5), len(base_place)).tobytes(), np.bincount(to, seen > 0, len(base_place)).astype("<u4").tobytes(), *[None] * 4))
        del at, docs, given, count, prior, chance, model
        trim()
        return pa.Table.from_batches([_rows(_PART, rows)])

    packed = docs.mapInArrow(pack, _PACKED_DDL)
    told = answers.where("bucket IS NOT NULL").select("bucket", "low", "high", "customers", "tables")
    return packed.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(score, _PART_DDL)


def _bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def model(docs: DataFrame, buckets: int) -> tuple[Known, DataFrame, int, int]:
    """What tasks hold of the model, the parent's answers for all other words, training documents and different training words."""
    rng = np.random.default_rng(5)
    total, words, counts, common = count_words(docs)
    known = Known(total, words, counts, common)
    with temporary(docs.sparkSession) as keep:
        return _sampled(keep(seat_contexts(docs, known, buckets, max(12, buckets // PER_WORDS)), "seated"), known, rng)


def _sampled(seated: DataFrame, known: Known, rng: np.random.Generator) -> tuple[Known, DataFrame, int, int]:
    """model(), once the contexts are seated."""
    words, counts, common = known.words, known.counts, known.common
    vectors = ["tables", "customers", "seats"]
    sums = _summed(seated.where(F.col("kind").isin(vectors)).select("kind", "block", "places", "counts"), dict(zip(vectors, (len(words), len(common), len(common)), strict=True)))
    once, twice, kinds = (x or 0 for x in seated.agg(F.sum("once"), F.sum("twice"), F.sum("kinds")).first())
    n_docs = int(counts[words == END][0])
    kinds += int((sums["customers"][common != START] > 0).sum()) + (n_docs > 0)
    answers = seat_parent(seated.where("kind = 'words'").select("block", "bucket", "low", "high", "counts"), kinds)
    of = answers.where("bucket IS NULL").select(F.sum("n"), *(F.sum(F.col("sums")[s]) for s in range(SAMPLES))).first()
    drawn = [parent_tables(sums["tables"], kinds, rng) for _ in range(SAMPLES)]
    customers = int(sums["tables"].sum()) + (of[0] or 0)
    known.discount = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))
    known.customer = 1 / (ROOT_THETA + customers)
    known.base = np.array([(ROOT_THETA + ROOT_DISCOUNT * (int(x.sum()) + (more or 0))) / (ROOT_THETA + customers) / (kinds + 1) for x, more in zip(drawn, of[1:], strict=True)])
    known.own = np.stack([known.probability(sums["tables"], x, s) for s, x in enumerate(drawn)])
    known.customers, known.tables = sums["customers"], sums["seats"]
    # Fewer than one in HOT pairs can be so frequent.
    hot = seated.where("kind = 'hot'").select("places", "low", "counts").collect()
    if hot:
        figures = np.concatenate([np.frombuffer(r.counts, "<i8").reshape(3, -1) for r in hot], axis=1)
        known = with_hot_pairs(known, (np.frombuffer(b"".join(r.places for r in hot), "<u8"), np.frombuffer(b"".join(r.low for r in hot), "<u8"), figures), rng)
    return known, answers, n_docs, kinds


def scores(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out): the doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Without training documents every word is the unknown one, and scores are zero."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(12, chars // BUCKET_CHARS)
    known, answers, n_docs, kinds = model(docs, buckets)
    total, all_log = known.total, float(np.log10(known.total + 0.5 * (kinds + 1)))

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, sums = None, {c: np.zeros(1 << 15) for c in ("model", "base", "known")}
        for batch in batches:
            for r in batch.to_pylist():
                sums["model"][np.frombuffer(r["place"], "<u2")] += np.frombuffer(r["model"], "<f8")
                for c, kind in (("base", "<f8"), ("known", "<u4")):
                    sums[c][np.frombuffer(r["base_place"], "<u2")] += np.frombuffer(r[c], kind)
                about = r if r["ids"] is not None else about
        ids, valid, out, tokens = (np.frombuffer(about[c], t) for c, t in (("ids", "<i8"), ("valid", bool), ("out", bool), ("tokens", "<i8")))
        own = {c: x[: len(ids)] for c, x in sums.items()}
        parts = [pa.array(ids, mask=~valid), pa.array(out), pa.array(tokens), pa.array(own["known"].astype(np.int64)), pa.array(np.full(len(ids), total, np.int64)), pa.array(own["base"] - tokens * all_log), pa.array(own["model"])]
        yield pa.RecordBatch.from_arrays(parts, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return part_scores(docs, known, answers, buckets).groupBy("batch").applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score. A null or empty text is its end alone; repeated rows are learnt from and scored as often as they come."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scores(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out")))
