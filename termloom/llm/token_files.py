"""Token-id output: documents to the ids of a public tokenizer, in binary files of Simple-8b words, and back."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import simple8b
from termloom.llm.common import mix, ordered, pieces, save, scratch, span_hashes, written

#: About so many ids go into a file: some 9 MB, which one task holds when it reads the file.
FILE_IDS = 4_000_000
_ODD = np.zeros(256, bool)
_ODD[[*range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class ChunkEncoder:
    """What tokenizers' Tokenizer gives for whole texts, with each word encoded once or so.

    Byte-level BPE never merges over the start of a word with its one space before, so a text is the sum of its chunks between
    spaces. That doesn't hold beside a space that has white space on both sides, or ends the text after white space; such
    texts, and those that hold a special token's string, go to the library whole. Chunks are found by their hashes in a table
    of a fixed size, where a new one takes the place of an old one; those that aren't there are encoded together, each after a
    space, and told apart by the pieces that start with it. A chunk is known by two independent hashes of 64 bits.
    """

    UNSURE = re.compile(r"\s \s|\s \Z")
    #: One of these is in every text that UNSURE finds; information separators are white space to some patterns alone.
    DOUBTS = tuple(f"{c} " for c in " \n\t\r\x0b\x0c")
    SEPARATORS = "\x1c\x1d\x1e\x1f"
    RARE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
    ODD_SPACE = re.compile(r"[^\S ]")
    #: Slots of the table, ids that it may point at, and chunks that the library takes as one text.
    SLOTS, MOST_IDS, TOGETHER = 1 << 22, 1 << 23, 512

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # the former counts no offsets
        n = self.tokenizer.get_vocab_size()
        self.starts_word = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(n)])
        self.marks = np.zeros(256, np.int64)  # the ids of punctuation marks
        for m in ".,;:!?":
            ids = self.tokenizer.encode(m, add_special_tokens=False).ids
            self.marks[ord(m)] = ids[0] if len(ids) == 1 else 0
        self.key, self.check = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.uint64)
        self.at, self.length = np.zeros(self.SLOTS, np.int32), np.zeros(self.SLOTS, np.int32)
        self.ids, self.used = np.zeros(self.MOST_IDS, "<u4"), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.batch(texts, add_special_tokens=False)]

    def _learn(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks raw[start:end], each after a space, save those that are the first of their texts: those of all
        together, and how many each has."""
        odd = np.concatenate([[0], np.cumsum(_ODD[raw])])
        alone = first | (start == end) | (odd[end] > odd[start])
        plain = np.flatnonzero(~alone)
        size = end[plain] - start[plain] + 1  # with the space before
        where = np.repeat(start[plain] - 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())
        joined, edge = raw[where].tobytes(), np.append((np.cumsum(size) - size)[:: self.TOGETHER], size.sum())
        texts = [joined[x:y].decode("utf-8") for x, y in pairwise(edge.tolist())] if len(plain) else []
        parts, places, sizes = [], [], []
        for k, (t, ids) in enumerate(zip(texts, self._whole(texts), strict=True)):
            own = plain[k * self.TOGETHER : (k + 1) * self.TOGETHER]
            new = np.flatnonzero(self.starts_word[ids])
            if len(new) == len(own) and (t.isascii() or not self.ODD_SPACE.search(t)):
                parts.append(ids)
                places.append(own)
                sizes.append(np.diff(new, append=len(ids)))
            else:  # a rare white space may have met the next chunk's
                alone[own] = True
        rest = np.flatnonzero(alone)
        found = self._whole([" " * (not first[i]) + raw[start[i] : end[i]].tobytes().decode("utf-8") for i in rest])
        places, sizes = np.concatenate([*places, rest]), np.concatenate([*sizes, [len(x) for x in found]]).astype(np.int64)
        ids, begin = np.concatenate([*parts, *found, np.zeros(0, "<u4")]), np.cumsum(sizes) - sizes
        order = np.argsort(places)
        begin, sizes = begin[order], sizes[order]
        return ids[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())], sizes

    def _sure(self, t: str) -> bool:
        if any(x in t for x in self.special) or any(x in t for x in self.SEPARATORS):
            return False
        if any(x in t for x in self.DOUBTS) or not t.isascii() and self.RARE_SPACE.search(t):
            return not self.UNSURE.search(t)
        return True

    def _chunked(self, texts: list[str]) -> list[np.ndarray]:
        raw = np.frombuffer("".join([" " + t for t in texts]).encode("utf-8") + b" ", np.uint8)
        space = np.flatnonzero(raw == 0x20)
        start, end = space[:-1] + 1, space[1:]
        own = np.array([t.count(" ") + 1 for t in texts])
        first = np.zeros(len(start), bool)
        first[np.cumsum(own) - own] = True
        mark = raw[end - 1]
        marked = (end - start > 1) & (self.marks[mark] > 0) & _LETTER[raw[end - 2]]  # a mark after a letter is a word of its own
        end = end - marked
        hashed = span_hashes(raw, start, end)
        hashed = np.where(first, mix(hashed ^ np.uint64(0xF1)), hashed) | np.uint64(1)  # never an empty slot's zero
        check = span_hashes(raw, start, end, second=True)
        slot = (hashed >> np.uint64(20)).astype(np.int64) & (self.SLOTS - 1)
        ids, at, length = self.ids, self.at[slot].astype(np.int64), self.length[slot].astype(np.int64)
        lacking = np.flatnonzero((self.key[slot] != hashed) | (self.check[slot] != check))
        if len(lacking):
            _, one, of = np.unique(mix(hashed[lacking]) + check[lacking], return_index=True, return_inverse=True)
            one = lacking[one]
            new, size = self._learn(raw, start[one], end[one], first[one])
            begin = np.cumsum(size) - size
            if self.used + len(new) < len(self.ids):
                begin += self.used
            else:  # the table starts again; these texts still read what was known
                ids, self.ids = np.concatenate([ids, new]), np.zeros(max(self.MOST_IDS, len(new) + 1), "<u4")
                self.key[:], self.used = 0, 0
            at[lacking], length[lacking] = (begin + (len(ids) - len(new) if ids is not self.ids else 0))[of], size[of]
            self.ids[self.used : self.used + len(new)] = new
            self.used += len(new)
            to = slot[one]
            self.key[to], self.check[to], self.at[to], self.length[to] = hashed[one], check[one], begin, size
        length += marked
        upto = np.cumsum(length)
        out = ids.take(np.repeat(at - (upto - length), length) + np.arange(upto[-1]), mode="clip")
        out[upto[marked] - 1] = self.marks[mark[marked]]
        edge = [0, *upto[np.cumsum(own) - 1].tolist()]
        return [out[x:y] for x, y in pairwise(edge)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        sure = [self._sure(t) for t in texts]
        whole = iter(self._whole([t for t, ok in zip(texts, sure, strict=True) if not ok]))
        plain = [t for t, ok in zip(texts, sure, strict=True) if ok]
        chunked = iter([x for at in pieces(plain, 1 << 20) for x in self._chunked(plain[at])])
        return [next(chunked if ok else whole) for ok in sure]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """An encoder that a Python worker keeps for all its tasks."""
    return ChunkEncoder(path)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Writes the ids of docs (doc_id, text) to files in ascending doc_id (null first, then by text); returns a row per file.

    tokenizer: a byte-level BPE file. Each text's ids are followed by end_id; a null text is empty. Range partitions are sorted
    and written file by file; a file has a fixed name for its place, so a task that runs again replaces what it wrote.
    """

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4")
        doc_ids, ids, size = [], [], 0

        def flush():
            name = f"part-{part:06d}-{seq:06d}.s8b"
            save(folder, name, simple8b.pack(doc_ids, ids))
            return pd.DataFrame({"part": [part], "seq": [seq], "n_ids": [size], "n_docs": [len(doc_ids)]})

        for frame in frames:
            names = [None if x is None else int(x) for x in frame["doc_id"]]
            for at in range(0, len(frame), 256):
                for k, got in enumerate(encode(frame["text"].iloc[at : at + 256].tolist()), at):
                    doc_ids.append(names[k])
                    ids.append(np.concatenate([got, end]))
                    size += len(got) + 1
                    if size >= FILE_IDS:
                        yield flush()
                        doc_ids, ids, size, seq = [], [], 0, seq + 1
        if doc_ids:
            yield flush()

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = texts.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return written(placed.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(write, "part int, seq int, n_ids long, n_docs long"), "files")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Of each document in the files: part and seq (its file), at (ids before it there), doc_id, n_tokens, ids_crc32 and,
    unless with_ids is false, ids."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"], strict=True):
                part, seq = map(int, re.search(r"part-(\d+)-(\d+)\.s8b$", path).groups())
                rows, at, held = [], 0, 0
                for doc_id, got in simple8b.unpack(data):
                    rows.append((part, seq, at, doc_id, len(got), zlib.crc32(got.astype("<u4").tobytes()), *([got.astype(np.int64)] if with_ids else [])))
                    at, held = at + len(got), held + len(got)
                    if with_ids and held > 1 << 20:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    schema = "part int, seq int, at long, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("path", "content")
    return files.mapInPandas(read, schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, as read from them. Repeated rows are written as often as they come."""
    import public_tokenizers

    folder = scratch(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_tokens(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    before = ordered(files, [F.col("part"), F.col("seq")], "n_ids").select("part", "seq", "_before")
    if files.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    read = read_tokens(spark, folder, with_ids=False).join(before, ["part", "seq"])
    return read.select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
