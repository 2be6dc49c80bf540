"""A toxicity classifier: a factorization machine over hashed terms.

A text's terms are its words and their beginnings, hashed to buckets. Which buckets say most about the label is counted over the
labelled sample with Spark; those alone are features. The machine's score of a text is a bias, a weight for each feature that it
has, and for each pair of them the product of their latent vectors, so that words which are harmless alone count together. It is
trained by stochastic gradient steps on the features of the sample, which are small, and scores every text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import pieces, span_hashes, trim

#: Labelled rows used at most, about; features at most, documents of the sample that one has at least, and its likelihood ratio
#: (natural logarithm; what says less adds noise to long texts); the score from which a text is predicted toxic.
LABELLED, FEATURES, FEWEST, EVIDENCE, THRESHOLD = 20_000, 2048, 4, 8.0, 0.5
#: Bits of a bucket, bytes of the words' beginnings, and terms that are hashed at once.
BITS, BEGINNINGS = 21, (3, 4, 5, 6, 8)
#: Latent dimensions, passes, texts of a step, step size, what holds weights and latent vectors down, and the part of a text's
#: features that a step leaves out, so that a word's beginning learns to tell without the whole word.
RANK, PASSES, STEP_TEXTS, RATE, DAMP, DAMP_PAIRS, DROPPED = 6, 15, 128, 0.15, 1e-5, 3e-2, 0.4
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the words of letters in any case, and of the beginnings of longer ones; repeated as they come."""
    lowered = [(t or "").lower().encode("utf-8") for t in texts]
    raw = np.frombuffer(b" ".join(lowered) + b" ", np.uint8)
    size = np.array([len(x) + 1 for x in lowered], np.int64)
    edge = np.flatnonzero(np.diff(_LETTER[raw].view(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    of = np.searchsorted(np.cumsum(size), start, "right")
    length = end - start
    longer = [np.flatnonzero(length > k) for k in BEGINNINGS]
    starts = np.concatenate([start, *(start[x] for x in longer)])
    ends = np.concatenate([end, *(start[x] + k for x, k in zip(longer, BEGINNINGS, strict=True))])
    whole = np.arange(len(starts)) < len(start)  # a word is another term than the same letters as a beginning
    hashed = span_hashes(raw, starts, ends) ^ np.where(whole, np.uint64(0), np.uint64(0x5DEECE66D << 20))
    return np.concatenate([of, *(of[x] for x in longer)]), (hashed >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Machine:
    """slot: the feature of each bucket, -1 for none; bias, weights and latent vectors (a row for each feature)."""

    slot: np.ndarray
    bias: float
    weights: np.ndarray
    latent: np.ndarray

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the texts, and the distinct features of each."""
        of, bucket = terms(texts)
        found = self.slot[bucket]
        some = found >= 0
        key = np.unique(of[some] * len(self.weights) + found[some])
        width = max(1, len(self.weights))
        return np.searchsorted(key, np.arange(len(texts) + 1) * width), key % width

    def raw(self, start: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Scores before they are squeezed between 0 and 1."""
        sums, squares, linear = _sums(self.latent, self.weights, start, feature)
        return self.bias + linear + 0.5 * ((sums**2).sum(1) - squares)

    def score(self, texts: list[str]) -> np.ndarray:
        """Chances of being toxic; of texts without features, the bias's. Without toxic labels all are 0."""
        if self.bias == -np.inf:
            return np.zeros(len(texts))
        return _squeeze(self.raw(*self.features(texts)))


def _squeeze(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _sums(latent: np.ndarray, weights: np.ndarray, start: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text, of its features: the sum of latent vectors, of their squared lengths, and of weights."""
    n = len(start) - 1
    sums, squares, linear = np.zeros((n, latent.shape[1])), np.zeros(n), np.zeros(n)
    some = np.flatnonzero(np.diff(start))
    if len(some):
        rows = latent[feature]
        sums[some] = np.add.reduceat(rows, start[some])
        squares[some] = np.add.reduceat((rows**2).sum(1), start[some])
        linear[some] = np.add.reduceat(weights[feature], start[some])
    return sums, squares, linear


def fit(slot: np.ndarray, start: np.ndarray, feature: np.ndarray, labels: np.ndarray, seed: int = 5) -> Machine:
    """A machine for texts given by their features; slot: as the machine keeps it. Steps are scaled for each number by the
    gradients that it has seen."""
    n, width, rng = len(labels), int(slot.max(initial=-1)) + 1, np.random.default_rng(seed)
    if not n or not labels.any():
        return Machine(slot, -np.inf, np.zeros(width), np.zeros((width, RANK)))
    part = min(labels.mean(), 1 - 0.5 / n)
    bias, weights, latent = float(np.log(part / (1 - part))), np.zeros(width), rng.normal(scale=0.05, size=(width, RANK))
    seen_bias, seen_weights, seen_latent = 1e-6, np.full(width, 1e-6), np.full((width, RANK), 1e-6)
    size = np.diff(start)
    for _ in range(PASSES):
        order = rng.permutation(n)
        for at in range(0, n, STEP_TEXTS):
            own = order[at : at + STEP_TEXTS]
            begin = np.concatenate([[0], np.cumsum(size[own])])
            held = feature[np.repeat(start[own] - begin[:-1], size[own]) + np.arange(begin[-1])]
            kept = rng.random(len(held)) >= DROPPED
            count = np.bincount(np.repeat(np.arange(len(own)), size[own])[kept], minlength=len(own))
            begin, held = np.concatenate([[0], np.cumsum(count)]), held[kept]
            sums, squares, linear = _sums(latent, weights, begin, held)
            wrong = (_squeeze(bias + linear + 0.5 * ((sums**2).sum(1) - squares)) - labels[own]) / len(own)
            each = np.repeat(wrong, count)
            kinds, which = np.unique(held, return_inverse=True)
            by_weight = np.bincount(which, each, len(kinds)) + DAMP * weights[kinds]
            pull = each[:, None] * (np.repeat(sums, count, axis=0) - latent[held])
            by_latent = np.stack([np.bincount(which, pull[:, f], len(kinds)) for f in range(RANK)], axis=1) + DAMP_PAIRS * latent[kinds] / len(own)
            seen_bias += wrong.sum() ** 2
            seen_weights[kinds] += by_weight**2
            seen_latent[kinds] += by_latent**2
            bias -= RATE * wrong.sum() / seen_bias**0.5
            weights[kinds] -= RATE * by_weight / seen_weights[kinds] ** 0.5
            latent[kinds] -= RATE / 3 * by_latent / seen_latent[kinds] ** 0.5
    return Machine(slot, bias, weights, latent)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this doc_id are kept from learning; null ones can have no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def telling(sample: DataFrame, most: int = FEATURES, fewest: int = FEWEST, evidence: float = EVIDENCE) -> list[int]:
    """The buckets of terms (`most` at most) that say most about the label of a sample (text, toxic): by the likelihood ratio of
    their counts in toxic and other texts, of those with that ratio in `fewest` texts or more; ties to smaller buckets."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, toxic = frame["text"].tolist(), frame["toxic"].to_numpy(np.int64)
            for at in pieces(texts):
                of, bucket = terms(texts[at])
                key = np.unique(bucket << 24 | of)
                bucket, n = np.unique(key >> 24, return_counts=True)
                bad = np.bincount(np.searchsorted(bucket, key >> 24), toxic[at][key & 0xFFFFFF], len(bucket)).astype(np.int64)
                yield pd.DataFrame({"bucket": bucket, "n": n, "bad": bad})

    counts = sample.select("text", "toxic").mapInPandas(count, "bucket long, n long, bad long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    all_, bad = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not all_ or not bad or bad == all_:
        return []
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    n, b = F.col("n"), F.col("bad")
    ratio = part(b, n * (bad / all_)) + part(n - b, n * (1 - bad / all_)) + part(bad - b, (all_ - n) * (bad / all_)) + part((all_ - n) - (bad - b), (all_ - n) * (1 - bad / all_))
    best = counts.where(n >= fewest).withColumn("ratio", F.round(ratio, 9)).where(F.col("ratio") >= evidence).orderBy(F.desc("ratio"), "bucket").limit(most)
    return [r.bucket for r in best.select("bucket").collect()]


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED, evidence: float = EVIDENCE) -> Machine:
    """A machine learnt from about `most` labelled documents at most (those with the least hashes of doc_id), without held-out ones.

    A doc_id with several labels has the largest of them; one with several documents stands for the least text."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = min(1.0, most / max(1, known.count()))
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    sample = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")  # `most` ids and labels
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    slot = np.full(1 << BITS, -1, np.int32)
    buckets = telling(sample, evidence=evidence)
    slot[buckets] = np.arange(len(buckets))
    empty = Machine(slot, 0.0, np.zeros(len(buckets)), np.zeros((len(buckets), 1)))
    shared = sample.sparkSession.sparkContext.broadcast(empty)  # of a size that parameters fix

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for at in pieces(texts):
                start, feature = shared.value.features(texts[at])
                yield pd.DataFrame({"doc_id": frame["doc_id"][at], "toxic": frame["toxic"][at], "features": [feature[x:y].astype("<i4").tobytes() for x, y in zip(start[:-1], start[1:], strict=True)]})

    got = sample.mapInPandas(read, "doc_id long, toxic int, features binary").toPandas().sort_values("doc_id")
    own = [np.frombuffer(x, "<i4") for x in got["features"]]
    start = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
    machine = fit(slot, start, np.concatenate([*own, np.zeros(0, "<i4")]), got["toxic"].to_numpy(np.float64))
    trim()
    return machine


def scored(docs: DataFrame, machine: Machine, name: str = "toxicity", kept: list[str] | None = None) -> DataFrame:
    """docs (its columns, or those `kept`) with a score in `name`, in whose place it comes if it is one of them."""
    kept = [c for c in (docs.columns if kept is None else kept) if c != name]
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [shared.value.score(texts[at]) for at in pieces(texts)]
            out = pa.array(np.concatenate(found) if found else [], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], [*kept, name])
            trim()

    own = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(score, ", ".join([*(f"`{c}` {own[c]}" for c in kept), f"`{name}` double"]))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chance of being toxic. Texts that are null, empty or without telling words have the chance of one that
    says nothing; without any toxic label all have 0; rows that repeat score alike; other columns play no part."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    machine = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    found = scored(docs, machine, "score", ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
