"""The stateless steps over a stream of documents, and dictionaries that a stream keeps up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructField, StructType

from termloom.functions.text import split_words
from termloom.operators.chunk import token_windows
from termloom.operators.dictionary import merge_last, upsert


def chunk_stream(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Chunks of a stream of documents (doc_id, text), as of a table."""
    return token_windows(docs.select("doc_id", split_words(F.col("text")).alias("tokens")), "tokens", size, overlap)


def dictionary_sink(definitions: DataFrame, path: str, checkpoint: str, *order: str) -> StreamingQuery:
    """Keeps a dictionary below `path` up to date with a stream of definitions (term, definition, and `order`).

    Each batch writes a new version, named by its number, from the one before; a batch that runs again writes the same one."""

    def update(batch: DataFrame, number: int) -> None:
        new = merge_last(batch, "term", "definition", *order)
        if number:
            new = upsert(batch.sparkSession.read.parquet(f"{path}/version={number - 1}"), new)
        new.write.mode("overwrite").parquet(f"{path}/version={number}")

    return definitions.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes(definitions: DataFrame, *order: str) -> DataFrame:
    """What a stream of definitions (term, definition, and `order`, columns that aren't null) changes in the dictionary: term,
    definition and `order`, a row for each term and batch in which its last definition is another one than before.

    Each term's last definition is kept as state, by key; a batch reads the state of its own terms alone. Rows of one place
    in the order count by their definition, the greatest last, so that it doesn't matter how a stream falls into batches. Null
    terms and definitions change nothing."""
    own = definitions.where("term IS NOT NULL AND definition IS NOT NULL").select("term", "definition", *order)
    kept = StructType([StructField(f.name, f.dataType) for f in own.schema.fields if f.name != "term"])
    names, by = [f.name for f in own.schema.fields], [*order, "definition"]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else None  # (definition, *order)
        last = old
        for frame in frames:
            top = frame.sort_values(by).iloc[-1]
            own = tuple(x.item() if hasattr(x, "item") else x for x in (top["definition"], *(top[c] for c in order)))
            if last is None or (*own[1:], own[0]) > (*last[1:], last[0]):
                last = own
        if last != old:
            state.update(last)
            yield pd.DataFrame([(*key, *last)], columns=names)

    return own.groupBy("term").applyInPandasWithState(update, own.schema, kept, "update", GroupStateTimeout.NoTimeout)


def changes_sink(definitions: DataFrame, path: str, checkpoint: str, *order: str) -> StreamingQuery:
    """Writes the changes() of a stream below `path`, each batch as one partition, which a repeated batch writes again: what a
    batch costs grows with its own terms, not with the dictionary."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes(definitions, *order).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_dictionary(spark: SparkSession, path: str, *order: str) -> DataFrame:
    """term and definition after all changes below `path`: what merge_last() gives for all definitions at once."""
    return merge_last(spark.read.parquet(path), "term", "definition", *order, "definition")


def compact(spark: SparkSession, path: str, to: str, *order: str) -> None:
    """Writes the last change of each term alone below another path, as one batch that others may follow."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("term").agg(F.max(F.struct(*order, "definition")).alias("x"))
    newest = rows.agg(F.max("batch")).first()[0]
    last.select("term", "x.definition", *(F.col(f"x.{c}") for c in order)).write.mode("overwrite").parquet(f"{to}/batch={newest}")
