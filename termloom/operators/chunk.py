"""Windows over tokens and characters, as generated rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _starts(n: Column, step: int) -> Column:
    """0, step, 2 * step, ... below n; none for n = 0, as sequence() would refuse."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))


def _windows(df: DataFrame, n: Column, step: int, window: Callable[[Column], Column], of: str) -> DataFrame:
    """df without the column `of`, a row for each window. Windows are cut within their row: what is dealt out as rows holds
    its own window alone, not all tokens."""
    kept = [c for c in df.columns if c != of]
    return df.select(*kept, F.inline(F.transform(_starts(n, step), window)))


def token_windows(df: DataFrame, tokens: str, size: int, overlap: int, joiner: str = " ") -> DataFrame:
    """chunk_id, start_token, end_token and text of windows of `size` tokens that share `overlap` with the one before.

    The last window may lie wholly within the one before; texts without tokens give none."""
    if size - overlap <= 0:
        raise ValueError("windows must advance: overlap has to be less than size")
    step, n = size - overlap, F.size(tokens)
    window = lambda s: F.struct(s.alias("start_token"), (s / step).cast("int").alias("chunk_id"), F.least(s + size, n).alias("end_token"), F.array_join(F.slice(tokens, s + 1, size), joiner).alias("text"))
    return _windows(df, n, step, window, tokens)


def capped_windows(df: DataFrame, tokens: str, size: int, overlap: int, most: int, joiner: str = " ") -> DataFrame:
    """Windows of at most `most` tokens; without overlap, one more token is left out between two of them."""
    width = min(size, most)
    step = width - overlap + (overlap <= 0)
    if width <= 0 or step <= 0:
        raise ValueError("windows must advance: overlap has to be less than their width")
    n = F.size(tokens)
    window = lambda s: F.struct(s.alias("start_token"), (s / step).cast("int").alias("chunk_id"), F.least(F.lit(width), n - s).alias("n_tokens"), F.array_join(F.slice(tokens, s + 1, width), joiner).alias("text"))
    return _windows(df, n, step, window, tokens)


def char_windows(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """chunk_id and chunk of windows of `size` characters."""
    if size - overlap <= 0:
        raise ValueError("windows must advance: overlap has to be less than size")
    step = size - overlap
    window = lambda s: F.struct((s / step).cast("int").alias("chunk_id"), F.substring(F.col(text), s + 1, F.lit(size)).alias("chunk"))
    return _windows(df, F.length(text), step, window, text)


def trim_tokens(tokens: Column, n: int, joiner: str = " ") -> Column:
    """The first n tokens as text."""
    return F.array_join(F.slice(tokens, 1, n), joiner)
