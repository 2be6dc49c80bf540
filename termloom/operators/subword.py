"""Subword tokens by a vocabulary: the longest piece that fits, from left to right, with offsets back into the text.

Windows and budgets count the same tokens. A character that no piece begins with is a token of its own, so tokens cover the text and
a window is cut out of it as it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from termloom.operators.contain import Automaton, _codes, _pieces

#: Characters that a vocabulary's pieces may have together: every task holds their trie.
MOST_CHARS = 1 << 21


class Pieces:
    """Cuts texts into tokens. The trie is built once in each Python worker that uses it."""

    def __init__(self, pieces: list[str]):
        self.pieces = sorted({p for p in pieces if p})
        if sum(map(len, self.pieces)) > MOST_CHARS:
            raise ValueError(f"a vocabulary of more than {MOST_CHARS} characters")
        self._trie: Automaton | None = None

    @classmethod
    def of(cls, vocabulary: DataFrame) -> Pieces:
        """The pieces of a table (token); null and empty ones are left out. It is told to be too large before it is read."""
        own = vocabulary.select("token").where("token <> ''").distinct()
        if (own.agg(F.sum(F.length("token").cast("long"))).first()[0] or 0) > MOST_CHARS:
            raise ValueError(f"a vocabulary of more than {MOST_CHARS} characters")
        return cls([r.token for r in own.collect()])

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "_trie": None}

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """The places where the tokens of each text begin."""
        self._trie = self._trie or Automaton(self.pieces)
        out = []
        for part in _pieces(texts):
            some = texts[part]
            size = np.array([len(t) for t in some], np.int64)
            upto = np.cumsum(size)
            step = np.maximum(1, self._trie.longest_at(_codes("".join(some)), np.repeat(upto, size))).tolist()
            for end, n in zip(upto.tolist(), size.tolist(), strict=True):
                first = at = end - n
                own = []
                while at < end:
                    own.append(at - first)
                    at += step[at]
                out.append(np.array(own, np.int64))
        return out


def n_tokens(pieces: Pieces) -> Callable[[Column], Column]:
    """A function that counts a text's tokens, as qa.within_budget takes one; null for null."""

    @pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        own = [len(x) for x in pieces.starts(texts.fillna("").tolist())]
        return pd.Series(own, index=texts.index).where(texts.notna())

    return count


def token_windows(df: DataFrame, text: str, pieces: Pieces, size: int, overlap: int) -> DataFrame:
    """df without the column `text`, a row for each window of `size` tokens that share `overlap` with the one before: chunk_id,
    start_token, end_token, start_char, end_char and text. The last window may lie wholly within the one before; null and
    empty texts give none."""
    if size - overlap <= 0:
        raise ValueError("windows must advance: overlap has to be less than size")
    step, kept = size - overlap, [c for c in df.columns if c != text]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for part in _pieces(texts):
                rows, columns = [], [[] for _ in range(6)]
                for i, starts in enumerate(pieces.starts(texts[part]), part.start):
                    edge = [*starts.tolist(), len(texts[i])]
                    for k, first in enumerate(range(0, len(starts), step)):
                        last = min(first + size, len(starts))
                        rows.append(i)
                        for column, x in zip(columns, (k, first, last, edge[first], edge[last], texts[i][edge[first] : edge[last]]), strict=True):
                            column.append(x)
                own = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *(pa.array(c, pa.string() if k == 5 else pa.int32()) for k, c in enumerate(columns))], [*kept, "chunk_id", "start_token", "end_token", "start_char", "end_char", "text"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "chunk_id int, start_token int, end_token int, start_char int, end_char int, text string"])
    return df.mapInArrow(cut, schema)


def gated_prompts(df: DataFrame, prompt: str, pieces: Pieces, most: int, system: str = "") -> DataFrame:
    """The rows whose system prompt and `prompt` have `most` tokens together at most, counted as one text."""
    return df.where(n_tokens(pieces)(F.concat(F.lit(system), F.col(prompt))) <= most)
