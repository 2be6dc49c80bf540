"""Approximate nearest neighbours by additive quantisation.

A vector's direction is stored as a sum of codewords, one from each of several codebooks of full-dimensional vectors, beside its
length. Each codebook is fitted to what those before it leave, and all are then refitted, one after another; a vector's codes
are found by beam search. A query's inner products with all codewords make a lookup table, in which a stored vector's score is
the sum of its codes' entries (with its length, also its distance). How far the sum lies from the vector is stored too and
bounds the score: what can be among the nearest by its bound is ranked by exact values, of the vectors that lie beside the codes.
So the nearest are found whatever rows the codebooks were fitted on; these decide on the work.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.llm.common import written

#: Codebooks, codewords in each, beam width, and rows that the codebooks are fitted on at most.
BOOKS, WORDS, BEAM, FIT_ROWS = 24, 256, 4, 20_000
#: Queries handled together, queries that one copy of a group serves, rows in a stored block of codes, and rows of a group of blocks.
QUERIES_AT_ONCE, SLICE_QUERIES, CODE_BLOCK, GROUP_ROWS = 1024, 1 << 15, 8192, 1 << 17
#: A stored block's arrays, beside the codes and the vectors themselves, and their types: far is a direction's distance from the sum of
#: codewords.
STORED = {"ids": np.int64, "lengths": np.float64, "far": np.float32}


@dataclass
class Codebooks:
    """words: (books, words, dimensions)."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The codes of rows of x: each book in turn extends the `beam` best sums so far."""
        k, d = self.words.shape[1:]
        n = len(x)
        codes, rest = np.zeros((n, 1, 0), np.int16), x.astype(np.float32)[:, None, :]
        for words in self.words:
            # |rest - w|^2 of every sum in the beam and every word
            cost = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ words.T).reshape(n, -1, k) + (words**2).sum(1)
            cost = cost.reshape(n, -1)
            width = min(beam, cost.shape[1])
            to = np.argpartition(cost, width - 1, axis=1)[:, :width]
            cost = np.take_along_axis(cost, to, 1)
            codes = np.concatenate([np.take_along_axis(codes, (to // k)[:, :, None], 1), (to % k)[:, :, None].astype(np.int16)], axis=2)
            rest = np.take_along_axis(rest, (to // k)[:, :, None], 1) - words[to % k]
        return codes[np.arange(n), cost.argmin(1)].astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[b][codes[:, b]] for b in range(len(self.words)))

    def rounding(self) -> float:
        """What float32 can add to or take from a sum of a table's entries, for a query of length 1."""
        books, _, d = self.words.shape
        return 2.0**-22 * (books + d) * max(1.0, float(np.sqrt((self.words.astype(np.float64) ** 2).sum(2)).max(1).sum()))

    def table(self, queries: np.ndarray) -> np.ndarray:
        """(books, words, queries): inner products."""
        return np.ascontiguousarray(np.einsum("bkd,qd->bkq", self.words, queries, optimize=True), np.float32)


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, beam: int = BEAM, rounds: int = 4, seed: int = 7) -> Codebooks:
    """Codebooks for rows like x: k-means on residuals, book after book, then each book refitted to
    what the beam-searched codes of all others leave."""
    rng, x = np.random.default_rng(seed), x.astype(np.float32)
    words = min(words, len(x))
    rest, made = x.copy(), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
            order = np.argsort(near, kind="stable")
            held, first, count = np.unique(near[order], return_index=True, return_counts=True)
            centres[held] = np.add.reduceat(rest[order], first) / count[:, None]
        near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(1)
        made.append(centres)
        rest = rest - centres[near]
    out = Codebooks(np.stack(made))
    for _ in range(2):
        codes = np.concatenate([out.encode(x[i : i + 512], beam) for i in range(0, len(x), 512)])
        rest = x - out.decode(codes)
        for b in range(books):
            rest += out.words[b][codes[:, b]]
            order = np.argsort(codes[:, b], kind="stable")
            held, first, count = np.unique(codes[order, b], return_index=True, return_counts=True)
            out.words[b][held] = np.add.reduceat(rest[order], first) / count[:, None]
            rest -= out.words[b][codes[:, b]]
    return out


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x, none of them zero, at length 1, and their lengths; of components of any size."""
    largest = np.abs(x).max(1)
    x = x / largest[:, None]
    length = np.sqrt((x**2).sum(1))
    return x / length[:, None], largest * length


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id, best first."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>), one row for each vec_id: vectors that are null, zero, empty or hold null or
    non-finite components take no part, nor do null vec_ids and lengths other than the commonest (of equally common ones the
    longest); of several rows with a vec_id the least vector does."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))  # false for NaN, which is above all numbers
    good = vectors.select("vec_id", x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull() & finite)
    good = good.where(F.exists(x, lambda v: v != 0))
    length = good.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size(x) == (length["n"] if length else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def codebooks(vectors: DataFrame, rows: int = FIT_ROWS, **how: int) -> Codebooks:
    """Codebooks fitted on the driver to the directions of about `rows` of the vectors at most, those with the least hashes of vec_id."""
    part = min(1.0, rows / max(1, vectors.count()))
    turn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    sample = vectors.where(turn < int(part * (1 << 30))).select("vec_id", "embedding").toPandas().sort_values("vec_id")
    return fit(directions(np.stack(sample["embedding"].to_numpy()))[0], **how)


def index(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """Blocks of codes: first vec_id, n, and packed arrays of codes, vectors (in single precision, if that holds them) and STORED."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # of a size that parameters fix

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for frame in frames:
            for at in range(0, len(frame), CODE_BLOCK):
                part = frame.iloc[at : at + CODE_BLOCK].sort_values("vec_id")
                x = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                unit, lengths = directions(x)
                codes = np.concatenate([own.encode(unit[i : i + 512]) for i in range(0, len(x), 512)])
                far = np.nextafter(np.sqrt(((unit - own.decode(codes)) ** 2).sum(1)).astype(np.float32), np.float32(np.inf))
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                arrays = {"codes": codes, "vectors": short if (short == x).all() else x, "lengths": lengths, "far": far, "ids": part["vec_id"].to_numpy(np.int64)}
                yield pd.DataFrame({"first": arrays["ids"][:1], "n": [len(x)], **{c: [v.tobytes()] for c, v in arrays.items()}})

    return vectors.select("vec_id", "embedding").mapInPandas(encode, "first long, n int, codes binary, vectors binary, lengths binary, far binary, ids binary")


def shortlists(queries: DataFrame, blocks: DataFrame, books: Codebooks, size: int, by: str = "dot") -> DataFrame:
    """query_id, vec_id and near of the `size` nearest stored vectors of each query, itself aside, ties to smaller ids: of those that
    the bounds of their codes' scores don't rule out, near is the exact inner product, or, by="l2", what half the distance's
    square lacks of half the query's.

    The stored codes lie in groups of some hundred thousand, and each query goes to every group: queries are the small side. A task
    holds one group's codes, which come first in its partition, sorted so by the shuffle, and the queries stream past them, some
    QUERIES_AT_ONCE with their tables at a time; the groups' shortlists are merged by score. A group is copied only as often as
    its queries are more than SLICE_QUERIES, or as tasks would stand idle. Every query meets all codes: among vectors of all
    directions alike no part of them can be left out.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(books)
    groups = -(-(blocks.agg(F.sum("n")).first()[0] or 0) // GROUP_ROWS) or 1
    slices = max(1, -(-2 * spark.sparkContext.defaultParallelism // groups), -(-queries.count() // SLICE_QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    held = ["codes", "vectors", *STORED]
    stored = blocks.select(F.pmod(F.xxhash64("first"), F.lit(groups)).cast("int").alias("group"), each(slices).alias("slice"), F.lit(0).alias("kind"), "first", *held, *none("array<double>", "embedding"))
    asked = queries.select(each(groups).alias("group"), F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), F.col("vec_id").alias("first"), *none("binary", *held), "embedding")

    def shortlisted(own: Codebooks, group: list[dict[str, np.ndarray]], mine: pd.DataFrame) -> pd.DataFrame:
        ask, x = mine["first"].to_numpy(np.int64), np.stack(mine["embedding"].to_numpy()).astype(np.float64)
        unit, long = directions(x)
        table, slack = own.table(unit.astype(np.float32)), own.rounding()
        kept, least = [(np.zeros(0), np.zeros(0, np.int64))] * len(ask), np.full(len(ask), -np.inf)
        for block in group:
            for at in range(0, len(block["ids"]), 1024):
                part = {c: v[at : at + 1024] for c, v in block.items()}
                codes, lengths = part["codes"], part["lengths"]
                score = table[0][codes[:, 0]]
                for b in range(1, len(table)):
                    score += table[b][codes[:, b]]
                bound = (score + (part["far"].astype(np.float64) + slack)[:, None]) * lengths[:, None] * long
                if by == "l2":
                    bound -= (lengths**2)[:, None] / 2 * (1 - 1e-12)
                can, whole = np.ascontiguousarray((bound >= least).T), part["vectors"].astype(np.float64)
                for q in np.flatnonzero(can.any(1)).tolist():
                    more = np.flatnonzero(can[q] & (part["ids"] != ask[q]))
                    near = (whole[more] * x[q]).sum(1) - (lengths[more] ** 2 / 2 if by == "l2" else 0.0)
                    both, ids = np.concatenate([kept[q][0], near]), np.concatenate([kept[q][1], part["ids"][more]])
                    top = best(both, ids, size)
                    kept[q] = both[top], ids[top]
                    if len(top) == size:
                        least[q] = both[top[-1]]
        return pd.DataFrame({"query_id": np.repeat(ask, [len(i) for _, i in kept]), "vec_id": np.concatenate([i for _, i in kept]), "near": np.concatenate([n for n, _ in kept])})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, key, group = shared.value, None, []
        for frame in frames:
            change = np.flatnonzero((frame[["group", "slice", "kind"]].diff().fillna(0) != 0).any(axis=1))
            for low, high in pairwise([0, *change.tolist(), len(frame)]):
                part = frame.iloc[low:high]
                if not len(part):
                    continue
                if (now := (part["group"].iloc[0], part["slice"].iloc[0])) != key:
                    key, group = now, []
                if part["kind"].iloc[0] == 0:
                    for row in part[held].to_dict("records"):
                        read = {c: np.frombuffer(row[c], kind) for c, kind in STORED.items()}
                        n = len(read["ids"])
                        short = len(row["vectors"]) == 4 * n * own.words.shape[2]
                        read["codes"] = np.frombuffer(row["codes"], np.uint8).reshape(n, -1)
                        read["vectors"] = np.frombuffer(row["vectors"], np.float32 if short else np.float64).reshape(n, -1)
                        group.append(read)
                elif group:
                    for at in range(0, len(part), QUERIES_AT_ONCE):
                        yield shortlisted(own, group, part.iloc[at : at + QUERIES_AT_ONCE])

    together = stored.unionByName(asked).repartition("group", "slice").sortWithinPartitions("group", "slice", "kind", "first")
    found = together.mapInPandas(scan, "query_id long, vec_id long, near double")
    if groups > 1:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id"))
        found = found.withColumn("_place", place).where(F.col("_place") <= size).drop("_place")
    return found


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shortlist: int = 0, books: Codebooks | None = None) -> DataFrame:
    """The k nearest of vectors by inner product for each query (rows of vectors), ties to the smaller vec_id: query_id, rank,
    vec_id, score. vectors are usable() ones; the scores are sums in double precision over the originals. shortlist: the length of
    a query's list in a group, if that is more than k."""
    if not vectors.head(1):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = books or codebooks(vectors)
    found = shortlists(queries, written(index(vectors, books), "codes"), books, max(k, shortlist))
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")  # a group has the shortlist's length
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("near").alias("score"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose vec_id is divisible by 20 among all others, ties to the smaller vec_id. Which vectors
    take part, and which of repeated vec_ids, says usable()."""
    vectors = written(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
