"""A quality classifier by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, hashed, and pairs of neighbouring character classes over all of it (which tell prose from
shouting, markup, lists and junk in any language) with the buckets of some figures of its words. Either kind is weighted by how
rare its terms are and reduced by a singular value decomposition, a randomised one for the words, all fitted on labelled rows;
both together are a vector for each text. Every document is compared with every labelled vector in blocks, and the labels of
its nearest ones vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import Words, pieces, trim

#: Labelled rows used at most, about, dimensions kept, neighbours that vote, and the score from which a document is predicted good.
LABELLED, DIMENSIONS, NEIGHBOURS, THRESHOLD = 6000, 48, 25, 0.3
#: Buckets of words' hashes, dimensions kept of them, and the part of a cosine that is the words'.
WORD_BUCKETS, WORD_DIMENSIONS, WORD_PART = 1 << 16, 24, 0.1
_CLASSES = 32
_class_of = np.full(256, 31, np.uint16)
for _k, _chars in enumerate(("abcdfghjklmnpqrstvwxyz", "eiou", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r\x0b\x0c", ".", ",", "!", "?", "|", "%", "#", "*", "$", "&", "'\"`", "()[]", "{}<>", "-_", "=+~^", ":;", "/\\", "@")):
    _class_of[list(_chars.encode())] = _k
_class_of[0x80:0xC0], _class_of[0xC0:] = 25, 26
#: Upper bounds of the buckets of each figure; past the last one is another bucket.
BUCKETS = {
    "words": (1, 5, 20, 60, 200, 600, 2000),
    "letters a word": (2, 3, 4, 5, 6, 8, 12),
    "same word again": (0.002, 0.01, 0.03, 0.08, 0.2, 0.5),
    "distinct words": (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9),
    "upper case": (0.01, 0.03, 0.06, 0.12, 0.3, 0.6),
    "neither letters nor space": (0.01, 0.03, 0.06, 0.12, 0.2, 0.35),
    "words a line": (3, 8, 16, 32, 64, 128),
}
N_TERMS = _CLASSES**2 + sum(len(b) + 1 for b in BUCKETS.values())


def terms(texts: list[str]) -> np.ndarray:
    """A row of term weights for each text, before rarity: square roots of parts of its pairs of characters, and its buckets."""
    n, words = len(texts), Words(texts)
    raw = [b"\n" + (t or "").encode("utf-8") + b"\n" for t in texts]
    size = np.array([len(x) for x in raw])
    kind = _class_of[np.frombuffer(b"".join(raw), np.uint8)]
    of = np.repeat(np.arange(n), size)
    counts = np.bincount((of[:-1] * _CLASSES + kind[:-1]) * _CLASSES + kind[1:], minlength=n * _CLASSES**2).reshape(n, -1).astype(np.float32)
    out = np.zeros((n, N_TERMS), np.float32)
    out[:, : _CLASSES**2] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    by_kind = counts.reshape(n, _CLASSES, _CLASSES).sum(2)
    held = np.diff(words.first)
    some, length = np.maximum(held, 1), np.bincount(words.doc, words.end - words.start, n)
    again = np.bincount(words.doc[1:][(words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=n)
    order = np.lexsort((words.hash, words.doc))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
    letters = np.maximum(1, by_kind[:, :3].sum(1) + by_kind[:, 26])
    figures = {
        "words": held, "letters a word": length / some, "same word again": again / some, "distinct words": np.bincount(words.doc[order][new], minlength=n) / some,
        "upper case": by_kind[:, 2] / letters, "neither letters nor space": by_kind[:, [3, *range(7, 25), 31]].sum(1) / np.maximum(1, size), "words a line": held / np.maximum(1, by_kind[:, 5]),
    }
    at = _CLASSES**2
    for name, bounds in BUCKETS.items():
        out[np.arange(n), at + np.searchsorted(bounds, figures[name])] = 0.25
        at += len(bounds) + 1
    out[held == 0] = 0  # a text without words is like no other
    return out


@dataclass
class WordCounts:
    """The words of some texts, sparse and by text: starts of the texts, buckets, and how often each stands there."""

    start: np.ndarray
    bucket: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> WordCounts:
        words = Words(texts)
        key = words.doc * WORD_BUCKETS + (words.hash >> np.uint64(40)).astype(np.int64) % WORD_BUCKETS
        key, n = np.unique(key, return_counts=True)
        return cls(np.searchsorted(key, np.arange(len(texts) + 1) * WORD_BUCKETS), key % WORD_BUCKETS, n.astype(np.float32))

    def weighted(self, rarity: np.ndarray) -> np.ndarray:
        """Weights of the entries: one plus the logarithm of the count, times the rarity, every text's of length one."""
        x = (1 + np.log(self.n)) * rarity[self.bucket]
        size = np.sqrt(np.bincount(self.text(), x * x, len(self.start) - 1))
        return (x / np.maximum(size, 1e-9)[self.text()]).astype(np.float32)

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def times(self, x: np.ndarray, into: np.ndarray) -> np.ndarray:
        """The product of the matrix with these entries x and one with a row for each bucket."""
        out = np.zeros((len(self.start) - 1, into.shape[1]), np.float32)
        some = np.flatnonzero(np.diff(self.start))
        for k in range(0, len(some), 256):
            part = some[k : k + 256]
            low, high = self.start[part[0]], self.start[part[-1] + 1]
            out[part] = np.add.reduceat(into[self.bucket[low:high]] * x[low:high, None], self.start[part] - low)
        return out

    def transposed_times(self, x: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The product of the transposed matrix and one with a row for each text."""
        out, of = np.zeros((WORD_BUCKETS, left.shape[1]), np.float32), self.text()
        for d in range(left.shape[1]):
            out[:, d] = np.bincount(self.bucket, x * left[of, d], WORD_BUCKETS)
        return out


def word_axes(counts: WordCounts, dimensions: int = WORD_DIMENSIONS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Rarity of the buckets and the right singular vectors of the weighted counts, by power steps on a random start."""
    n = len(counts.start) - 1
    rarity = (np.log((1 + n) / (1 + np.bincount(counts.bucket, minlength=WORD_BUCKETS))) + 0.5).astype(np.float32)
    x, k = counts.weighted(rarity), min(dimensions + 8, n)
    left = np.random.default_rng(seed).normal(size=(n, k)).astype(np.float32)
    for _ in range(3):
        left = np.linalg.qr(left)[0]
        right = np.linalg.qr(counts.transposed_times(x, left))[0]
        left = counts.times(x, right)
    axes = np.linalg.svd(left, full_matrices=False)[2]
    return rarity, (right @ axes[:dimensions].T).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Model:
    """What scoring takes: weights by rarity and the projection, of either kind of terms, and the labelled vectors with their
    labels, in order of doc_id."""

    rarity: np.ndarray
    into: np.ndarray
    word_rarity: np.ndarray
    word_into: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def vector(self, rows: np.ndarray, counts: WordCounts) -> np.ndarray:
        shape = _unit(_unit(rows * self.rarity) @ self.into)
        words = _unit(counts.times(counts.weighted(self.word_rarity), self.word_into))
        return np.concatenate([shape * np.float32((1 - WORD_PART) ** 0.5), words * np.float32(WORD_PART**0.5)], axis=1)

    def score(self, texts: list[str], neighbours: int = NEIGHBOURS, block: int = 512) -> np.ndarray:
        """The label expected of each text, 0 to 1; of texts without words, the labels' mean; 0.5 if there are no labels."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.full(len(texts), self.labels.mean())
        x = self.vector(terms(texts), WordCounts.of(texts))
        k = min(neighbours, len(self.labels))
        for at in range(0, len(x), block):
            like = x[at : at + block] @ self.vectors.T
            near = nearest(like, k)
            weight = np.maximum(np.take_along_axis(like, near, 1), 0).astype(np.float64) ** 4 + 1e-12
            vote = (weight * self.labels[near]).sum(1) / weight.sum(1)
            seen = np.abs(x[at : at + block]).sum(1) > 0
            out[at : at + block][seen] = vote[seen]
        return np.clip(out, 0, 1)


def nearest(like: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, of equal ones the first."""
    least = np.partition(like, like.shape[1] - k, axis=1)[:, like.shape[1] - k, None]
    above, at = like > least, like == least
    room = k - above.sum(1, keepdims=True)
    return np.nonzero(above | at & (np.cumsum(at, axis=1) <= room))[1].reshape(-1, k)


def fit(rows: np.ndarray, counts: WordCounts, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    if not len(rows):
        return Model(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32), np.ones(WORD_BUCKETS, np.float32), np.zeros((WORD_BUCKETS, 1), np.float32), np.zeros((0, 2), np.float32), np.zeros(0))
    rarity = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 0.5).astype(np.float32)
    x = rows * rarity
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))  # the right singular vectors
    del x
    model = Model(rarity, axes[:, ::-1][:, : min(dimensions, len(rows))].astype(np.float32), *word_axes(counts), np.zeros(0), labels.astype(np.float64))
    model.vectors = model.vector(rows, counts)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether labels of this doc_id are kept from learning; null ones can have no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _arrays(table: pa.Table, name: str, kind: str | type, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of the packed arrays in a column, in some order of rows, with no copy of them row by row."""
    if not len(order):
        return np.zeros(1, np.int64), np.zeros(0, kind)
    own = pa.concat_arrays(table[name].chunks).cast(pa.large_binary())
    at = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, 8 * own.offset) // 4
    data, size = np.frombuffer(own.buffers()[2], kind, at[-1]), np.diff(at)[order]
    start = np.concatenate([[0], np.cumsum(size)])
    return start, data[np.repeat(at[:-1][order] - start[:-1], size) + np.arange(start[-1])]


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """A model of about `most` labelled documents at most (those with the least hashes of doc_id), without held-out ones.

    A doc_id with several labels has the least of them; one with several documents stands for the least text."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    part = min(1.0, most / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # `most` ids and labels
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def weigh(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for at in pieces(texts):
                rows, counts = terms(texts[at]), WordCounts.of(texts[at])
                held = [(counts.bucket[x:y].astype("<i4").tobytes(), counts.n[x:y].tobytes()) for x, y in pairwise(counts.start.tolist())]
                yield pd.DataFrame({"doc_id": frame["doc_id"][at], "quality": frame["quality"][at], "terms": [x.tobytes() for x in rows], "words": [b for b, _ in held], "counts": [n for _, n in held]})

    got = sample.mapInPandas(weigh, "doc_id long, quality int, terms binary, words binary, counts binary").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    labels_ = got["quality"].to_numpy()[order]
    (_, rows), (start, words), (_, n) = _arrays(got, "terms", np.float32, order), _arrays(got, "words", "<i4", order), _arrays(got, "counts", np.float32, order)
    del got
    model = fit(rows.reshape(-1, N_TERMS), WordCounts(start, words, n), labels_)
    trim()
    return model


def scored(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs with a score: its columns and `name`, in whose place the score comes if it is one of them."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a size that parameters fix

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the other columns pass as they are
            texts = batch.column("text").to_pylist()
            found = [shared.value.score(texts[at]) for at in pieces(texts)]
            yield batch.append_column(name, pa.array(np.concatenate(found) if found else [], pa.float64()))
            trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(score, f"{schema}, `{name}` double")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score. Texts that are null, empty or without words score the mean of the labels; rows that repeat score
    alike; of equally near labelled texts those with the smaller doc_ids vote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    found = scored(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
