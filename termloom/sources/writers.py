"""Writing tables: Parquet as the form that is read again, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.sources.npz import NpzSource


def dictionary(df: DataFrame, path: str) -> None:
    df.select("term", "definition").write.mode("overwrite").parquet(path)


def graph(nodes: DataFrame, edges: DataFrame, embeddings: DataFrame | None, path: str) -> None:
    """nodes, edges by type and, if there are any, embeddings, below one folder."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    if embeddings is not None and not embeddings.isEmpty():
        embeddings.write.mode("overwrite").parquet(f"{path}/embeddings")


def embeddings_npz(embeddings: DataFrame, path: str) -> None:
    """Embeddings (term, embedding) as arrays of terms and embeddings, in a folder of npz files (named *.npz for the reader)."""
    embeddings.sparkSession.dataSource.register(NpzSource)
    own = embeddings.where("term IS NOT NULL AND embedding IS NOT NULL").select(F.col("term").alias("terms"), F.col("embedding").cast("array<double>").alias("embeddings"))
    own.write.format("npz").mode("overwrite").save(path)


def metadata(dictionary_df: DataFrame, tokenizer: str, technical_terms: DataFrame, path: str, **others: DataFrame) -> None:
    """A row with the tokenizer and the numbers of terms, and of nodes, edges, matches or whatever else is given, as JSON."""
    counts = dictionary_df.agg(F.count("*").alias("total_terms")).join(F.broadcast(technical_terms.agg(F.count("*").alias("technical_terms_loaded"))))
    for name, df in others.items():
        counts = counts.join(F.broadcast(df.agg(F.count("*").alias(f"total_{name}"))))
    counts.select(F.lit(tokenizer).alias("tokenizer"), "*").write.mode("overwrite").json(path)


def qa_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A CSV file with a header, for spreadsheets: one task writes it, and a mark of the byte order stands before the first column's
    name. Without one_file, a file for each task, without such marks."""
    first, *rest = df.columns
    own = df.coalesce(1).select(F.col(first).alias(f"\ufeff{first}"), *rest) if one_file else df
    own.write.mode("overwrite").option("escape", '"').csv(path, header=True)


def blocks_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def terms_json(df: DataFrame, path: str) -> None:
    df.select("term").write.mode("overwrite").json(path)


def markdown(df: DataFrame, path: str) -> None:
    """Rendered documents (doc, markdown), as lines of JSON in files that hold many of them."""
    df.select("doc", "markdown").write.mode("overwrite").json(path)


def upsert_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Graph nodes (id, ...) with the new values of those that are in `new`, by id, and its other rows."""
    mine = new.select("id", *(F.col(c).alias(f"_{c}") for c in new.columns if c != "id"))
    both = old.join(mine, "id", "full")
    return both.select("id", *(F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c != "id"))
