"""Connected components of links between numbered things, by rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, scratch, spread_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (large) or smaller neighbours, and itself, linked to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    joined = spread_join(both, least, ["u"], F.col("v"), how="inner")  # a hub's links lie in several places
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): for each node in them, node and root, the least node that it is connected with.

    Each round is written to the shared folder and takes the place of the one before; the rounds grow as the logarithm of the
    longest way."""
    spark = links.sparkSession
    links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().write.parquet(at := scratch(spark, "links"))
    seen = None
    while True:
        edges, last = _star(_star(spark.read.parquet(at), large=True), large=False), at
        edges.write.parquet(at := scratch(spark, "links"))
        edges = spark.read.parquet(at)
        discard(spark, last)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
