"""Fill-in-the-middle transformation by secondary-sort assembly.

A text is cut into a prefix, a middle and a suffix. Its code points leave the task that reads it as pieces of bounded length,
each with the key of its row and the place that it has in the output. Pieces are dealt out by key and sorted by place in the
shuffle (repartitionAndSortWithinPartitions, in its DataFrame form), and what comes in that order runs through an incremental
digest, so that no text is whole in memory after it is read. Restoring reads the output's own markers off the same stream, gives
every piece its place in the text, and sorts again within the partition, without another shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import small

#: The marks before prefix, suffix and middle: fixed values. Per cent of documents that stay plain, and of the others that have
#: the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Code points of a piece, and of the pieces that are emitted at once.
CHUNK, AT_ONCE = 4096, 1 << 20
#: The parts of a text (0 prefix, 1 middle, 2 suffix) in the order in which a form has them, each after its mark.
ORDER = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
KEYS = "doc_id long, row long, same long"
PIECES = f"{KEYS}, form string, n long, prefix_chars long, middle_chars long, at long, piece string"
RESTORED = f"{KEYS}, part int, at long, piece string, form string, n long, prefix_chars long, middle_chars long, output_sha256 string"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def plan(doc_id: int | None, text: str) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text."""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not n or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return "plain", n, n
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < SPM_BELOW else "psm"), a, b


def pieces(text: str, form: str, a: int, b: int, chunk: int = CHUNK) -> Iterator[tuple[int, str]]:
    """(place in the output, piece), in order."""
    spans = {0: (0, a), 1: (a, b), 2: (b, len(text))}
    at = 0
    for mark, (start, end) in [("", (0, len(text)))] if form == "plain" else [(m, spans[k]) for m, k in ORDER[form]]:
        if mark:
            yield at, mark
            at += len(mark)
        for k in range(start, end, chunk):
            piece = text[k : min(k + chunk, end)]
            yield at, piece
            at += len(piece)


class Parts:
    """Tells of a stream of output pieces, however they are cut, which part of the text each belongs to and where it stands there.

    A text with a mark in it is plain, so the first occurrence of the mark that comes next is that mark."""

    def __init__(self, form: str):
        self.marks = list(ORDER.get(form, ()))
        self.part, self.at, self.held = (None if self.marks else 0), 0, ""

    def feed(self, piece: str) -> Iterator[tuple[int, int, str]]:
        """(part, place in the part, text) of what is known by now."""
        text, self.held = self.held + piece, ""
        while self.marks:
            mark, part = self.marks[0]
            at = text.find(mark)
            if at < 0:
                keep = next((k for k in (2, 1) if text.endswith(mark[:k])), 0)  # perhaps a mark that goes on in the next piece
                text, self.held = text[: len(text) - keep], text[len(text) - keep :]
                break
            yield from self._own(text[:at])
            text, self.part, self.at = text[at + len(mark) :], part, 0
            self.marks.pop(0)
        yield from self._own(text)

    def end(self) -> Iterator[tuple[int, int, str]]:
        yield from self._own(self.held)
        self.held = ""

    def _own(self, text: str) -> Iterator[tuple[int, int, str]]:
        if text:
            if self.part is None:
                raise ValueError("an output that doesn't start with its form's mark")
            yield self.part, self.at, text
            self.at += len(text)


def _batches(rows: Iterator[tuple], schema: pa.Schema, piece: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches whose pieces (the column at `piece`) have some AT_ONCE characters together."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[piece] or "") + 64
        if size >= AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in small(batches, 256):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def output_pieces(docs: DataFrame) -> DataFrame:
    """The pieces (PIECES) of docs (doc_id, text), a row's pieces together in one partition and in the order of its output.

    A row's key is its doc_id, its number and a hash of its text, so that rows of one doc_id, or of none, lie anywhere."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, row, same, text in _rows(batches):
                form, a, b = plan(doc_id, text)
                own = (doc_id, row, same, form, len(text), *((None, None) if form == "plain" else (a, b - a)))
                some = False
                for at, piece in pieces(text, form, a, b):
                    some = True
                    yield (*own, at, piece)
                if not some:
                    yield (*own, 0, "")

        yield from _batches(rows(), _arrow(PIECES), 8)

    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("same"), text.alias("text"))
    return own.mapInArrow(cut, PIECES).repartition("doc_id", "row", "same").sortWithinPartitions("doc_id", "row", "same", "at")


def outputs(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output, the whole transformed text, of docs (doc_id, text)."""
    own = output_pieces(docs).groupBy("doc_id", "row", "same", "n", "form", "prefix_chars", "middle_chars")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "")
    return own.agg(joined.alias("output")).drop("row", "same")


def restored_pieces(output: DataFrame) -> DataFrame:
    """Pieces of outputs, as output_pieces() gives them, in their order in the text (RESTORED): a head with the output's digest
    (part -1) for each row, and its parts after it. The text's pieces come from the output and its form alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key = parts = digest = head = None
            for *own, form, n, prefix_chars, middle_chars, _, piece in _rows(batches):
                if own != key:
                    if key is not None:
                        yield from ((*key, part, at, text, None, None, None, None, None) for part, at, text in parts.end())
                        yield (*key, -1, 0, None, *head, digest.hexdigest())
                    key, parts, digest, head = own, Parts(form), hashlib.sha256(), (form, n, prefix_chars, middle_chars)
                digest.update(piece.encode("utf-8"))
                for part, at, text in parts.feed(piece):
                    yield (*key, part, at, text, None, None, None, None, None)
            if key is not None:
                yield from ((*key, part, at, text, None, None, None, None, None) for part, at, text in parts.end())
                yield (*key, -1, 0, None, *head, digest.hexdigest())

        yield from _batches(rows(), _arrow(RESTORED), 5)

    return output.mapInArrow(read, RESTORED).sortWithinPartitions("doc_id", "row", "same", "part", "at")


def digests(restored: DataFrame) -> DataFrame:
    """A row for each head among restored_pieces(), with the digest of the text that follows it (RESULT)."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            head = digest = None
            for doc_id, _, _, part, _, piece, form, n, prefix_chars, middle_chars, output in _rows(batches):
                if part < 0:
                    if head:
                        yield (*head, digest.hexdigest())
                    head, digest = (doc_id, n, form, prefix_chars, middle_chars, output), hashlib.sha256()
                else:
                    digest.update(piece.encode("utf-8"))
            if head:
                yield (*head, digest.hexdigest())

        yield from _batches(rows(), _arrow(RESULT), 6)

    return restored.mapInArrow(close, RESULT)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form, cuts and digests. A null text is empty and plain; a null doc_id counts as an empty number; rows that
    repeat come as often as they are there; other columns play no part."""
    return digests(restored_pieces(output_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))


def _hash(k: int) -> str:
    return f"('0x' || substring(h, {8 * k + 1}, 8))::BIGINT"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, length(t)::BIGINT AS n, {_hash(0)} % (length(t) + 1) AS x, {_hash(1)} % (length(t) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR {_hash(2)} % 100 >= {PLAIN_FROM} THEN 'plain' WHEN {_hash(3)} % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, least(x, y)::BIGINT AS a, greatest(x, y)::BIGINT AS b FROM c),
s AS (SELECT *, '{PREFIX}' || substring(t, 1, a) AS pre, '{MIDDLE}' || substring(t, a + 1, b - a) AS mid, '{SUFFIX}' || substring(t, b + 1, n - b) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM s"""
