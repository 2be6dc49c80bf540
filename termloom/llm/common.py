"""What several operators share: scratch tables, a distributed row order, and word hashes of whole texts."""

from __future__ import annotations

import contextlib
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space of every word-based operator here, as a character class for Java's regular expressions and DuckDB's.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def _path(spark: SparkSession, at: str):
    """A Hadoop path with its scheme, and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return path.makeQualified(store.getUri(), store.getWorkingDirectory()), store


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme: spark.checkpoint.dir. Where that is unset, one in the
    warehouse; on a single machine one in /tmp."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
        local = spark.sparkContext.master.startswith("local")
        at = at.rpartition("/")[0] if at else tempfile.mkdtemp(prefix="spark-", dir="/tmp") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return _path(spark, at)[0].toString()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to a table in the shared folder and read again: it survives lost executors and has a short lineage."""
    df.write.parquet(path := scratch(df.sparkSession, what))
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, at: str) -> None:
    """Removes a table in the shared folder that nothing reads any more."""
    path, store = _path(spark, at)
    store.delete(path, True)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Gives a function like written(), whose tables are removed at the end: what is left by then must not read them."""
    held: list[str] = []

    def write(df: DataFrame, what: str) -> DataFrame:
        held.append(scratch(spark, what))
        df.write.parquet(held[-1])
        return spark.read.parquet(held[-1])

    try:
        yield write
    finally:
        for at in held:
            discard(spark, at)


def ordered(df: DataFrame, order: list[Column], value: str | None = None) -> DataFrame:
    """df with _rn, a row's place (from 0) in the whole order, and _before, the sum of `value` over all rows before it.

    Range partitions are numbered and stored, each is counted, and a window inside each partition adds the counts of those
    before it: nothing but one row per partition (a bound that doesn't grow with the rows) is ever in one task or broadcast.
    Rows equal in all of `order` get adjacent places in any order.
    """
    shared_dir(df.sparkSession)
    df = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).checkpoint()
    amount = F.coalesce(F.col(value), F.lit(0)) if value else F.lit(0)
    parts = df.groupBy("_pid").agg(F.count("*").alias("_n"), F.sum(amount.cast("long")).alias("_v"))
    earlier = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_pid", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", "_v")))
    inside = Window.partitionBy("_pid").orderBy(*order)
    so_far = F.sum(amount.cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        df.withColumns({"_row": F.row_number().over(inside), "_sum": so_far})
        .join(F.broadcast(parts), "_pid")
        .withColumns({"_rn": F.col("_n") + F.col("_row") - 1, "_before": F.col("_v") + F.col("_sum") - amount})
        .drop("_pid", "_n", "_v", "_row", "_sum")
    )


_PRIME, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 5 << 18)
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_PRIME, _INVERSE)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of x."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Spans of so many bytes or more are hashed one by one: modulo 2 ** 64 the polynomial fails for long spans of a regular build.
LONG_SPAN = 256
#: The numbers that stand for the bytes, for a hash and another that is independent of it.
_BYTES = (np.arange(1, 257, dtype=np.uint64), mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of raw[start:end]; equal bytes have equal hashes. second: of another kind, to tell apart what the first don't."""
    powers, inverses = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[second][raw] * powers[: len(raw)], out=sums[1:])
    out = mix((sums[end] - sums[start]) * inverses[start])
    for i in np.flatnonzero(end - start >= LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8, salt=b"second" * second).digest(), "little")
    return out


class Words:
    """The words of some texts, as arrays: doc[i] is word i's text, hash[i] its 64-bit hash (equal words have equal hashes)."""

    def __init__(self, texts: list[str]):
        raw = [(t or "").encode("utf-8").lower() for t in texts]  # of bytes: lowers A to Z alone
        self.n = len(raw)
        self.bytes = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self.doc_start = np.cumsum([0, *(len(x) + 1 for x in raw)])
        space = _IS_SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        self.start, self.end = edge[0::2], edge[1::2]
        self.doc = np.searchsorted(self.doc_start, self.start, "right") - 1
        self.hash = span_hashes(self.bytes, self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(self.n + 1))  # text k's words are first[k]:first[k + 1]


def trim() -> None:
    """Gives memory that large arrays have left free back to the system, where the C library can."""
    import ctypes

    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices of some rows, so that few texts are Python strings at once."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def pieces(texts: list[str], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of texts of about `most` characters together (one text at least), so that arrays over them stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t or "") + 1
    if start < len(texts):
        yield slice(start, len(texts))


def load(path: str) -> bytes:
    """A file's bytes; path: a path or a URI that pyarrow knows."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with store.open_input_stream(at) as f:
        return f.read()


def save(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all, so that a repeated task leaves one copy. folder: a path or a URI that pyarrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(part := f"{path}/_{name}-{uuid.uuid4().hex}") as f:
        f.write(data)
    store.move(part, f"{path}/{name}")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], turn: Column, salts: int = 8, how: str = "left") -> DataFrame:
    """left joined with right, which has one small row for each key; the rows of a key in left are dealt out by turn.

    A key with a third of all rows then lies in `salts` places, and right, repeated so often, stays in proportion to its keys.
    """
    dealt = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(turn), F.lit(salts)).cast("int")).join(dealt, [*keys, "_salt"], how).drop("_salt")
