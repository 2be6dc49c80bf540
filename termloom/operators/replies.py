"""A store of a model's replies, so that no prompt is asked twice, in one run or another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators.models import Extractive, LanguageModel, Window, complete

SCHEMA = "key string, model string, reply string, part string"


class ReplyStore:
    """Replies below a path that driver and executors share, by the hash of model and prompt, partitioned by its first digits.

    What is stored stays; a run adds the replies that it lacks, in one commit. A reply that fails isn't stored, so the next run asks
    again. Two runs at once may both ask, and then the lesser reply counts for both."""

    def __init__(self, spark: SparkSession, path: str, model: str = "default", digits: int = 1):
        self.spark, self.path, self.model, self.digits = spark, path, model, digits
        spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("part").parquet(path)  # so that there is a folder

    def key(self, prompt: Column) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.model}\n"), prompt), 256)

    def known(self) -> DataFrame:
        """key and reply of all that is stored of this model."""
        own = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("model") == self.model)
        return own.groupBy("key").agg(F.min("reply").alias("reply"))

    def add(self, prompts: DataFrame, factory: Callable[[], LanguageModel] = Extractive, batch: int = 20, window: Window | None = None) -> None:
        """Asks for and stores what the column `prompt` has that isn't stored; equal prompts once. Null ones aren't asked."""
        own = prompts.select("prompt").where("prompt IS NOT NULL").distinct().withColumn("key", self.key(F.col("prompt")))
        new = complete(own.join(self.known().select("key"), "key", "left_anti"), "prompt", "reply", factory, batch, "null", window)
        rows = new.where("reply IS NOT NULL").select("key", F.lit(self.model).alias("model"), "reply", F.substring("key", 1, self.digits).alias("part"))
        rows.write.mode("append").partitionBy("part").parquet(self.path)

    def complete(self, df: DataFrame, prompt: str, out: str, factory: Callable[[], LanguageModel] = Extractive, batch: int = 20, window: Window | None = None) -> DataFrame:
        """models.complete() by way of the store: df with the replies to its column `prompt` in `out`; empty for what failed.

        Replies travel by key, and df meets them as it is; a key with many rows is split by AQE's join."""
        self.add(df.select(F.col(prompt).alias("prompt")), factory, batch, window)
        found = self.known().select(F.col("key").alias("_key"), F.col("reply").alias("_reply"))
        told = df.withColumn("_key", self.key(F.col(prompt))).join(found, "_key", "left")
        return told.select(*(c for c in df.columns if c != out), F.when(F.col(prompt).isNotNull(), F.coalesce("_reply", F.lit(""))).alias(out))
