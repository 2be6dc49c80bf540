"""From documents to token ids: quality, near duplicates, mixing and encoding, each a stage that reads what the one before kept.

A stage is (name, function) with function(spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import mixing, ngram_join, quality, sentencepieces
from termloom.llm.common import written


def free(name: str, docs: DataFrame) -> str:
    """A name that no column of docs has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learnt from the labels of these documents, predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.learn(docs.select("doc_id", "text"), labels)
    name = free("quality_score", docs)
    return quality.scored(docs, model, name).where(F.col(name) >= quality.THRESHOLD).select(*docs.columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8 or more): that with the least doc_id.

    Documents without words all stay. Rows with equal doc_id and text are one; without a doc_id, all stay whose group has none."""
    found = ngram_join.similar(docs, 5, 4, 5)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id")).distinct()
    left = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    repeated = not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
    return left.dropDuplicates(["doc_id", "text"]) if repeated else left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, sorted by training position: every document once, and 50 % of all
    words again, by source weight; the document at which a source's share ends comes again if over half of it would."""
    sizes = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    mixed = mixing.mixture(written(sizes, "sizes"), least=1.0)
    again = F.element_at("taken_by_pass", 2) * 2 > F.col("size")
    places = F.when(again, F.col("positions")).otherwise(F.slice("positions", 1, 1))
    own, all_, at = free("of", docs), free("places", docs), free("at", docs)
    of = mixed.groupBy(F.col("doc_id").alias(own)).agg(F.max_by(places, F.col("taken")).alias(all_))
    taken = docs.join(of, docs["doc_id"].eqNullSafe(of[own])).withColumn(at, F.explode(all_)).withColumn(at, F.coalesce(at, F.lit(0.0)))
    return taken.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that the mix takes, as often as it does."""
    return sentencepieces.query(docs)


STAGES = [("quality classifier", keep_good), ("n-gram Jaccard join", keep_distinct), ("mixing sources", mix_sources), ("SentencePiece encoding", encode)]

#: SQL can express neither the classifier's votes nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
