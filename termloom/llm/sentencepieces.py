"""SentencePiece encoding and decoding by batched Viterbi search over the pieces and scores of a public model file.

A text's segmentation is the one whose pieces have the largest sum of scores (of equal ones, the library's: at each place the
longest last piece). Pieces hold the space mark only at their start, so the units between spaces are searched apart; units of
equal length advance together, a place at a time. All their substrings are hashed and looked up among the sorted hashes of the
pieces, and the maxima at each place leave the length and id of the last piece. What no piece covers becomes byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import mix, pieces, trim

SPACE_MARK = "▁"
#: Types of a piece and the penalty of an uncovered character under the least score: fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
#: Characters of a unit from which it is searched alone, and of which substrings are looked up at a time.
LONG = 4096
_BASE, _SKETCH = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 19) - 1)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol-buffers message."""

    def number(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value, shift, i = value | (data[i] & 127) << shift, shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = number(i)
        if tag & 7 == 0:
            value, i = number(i)
        else:
            size, i = number(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Pieces:
    """A model file's pieces, ready for the search. Models that change characters before they encode aren't supported."""

    def __init__(self, path: str, most_known: int = 100_000):
        self.text, self.score, self.kind = [], [], []
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        for field, value in model:
            if field == 1:
                own = dict(_fields(value))
                self.text.append(own[1].decode())
                self.score.append(float(np.frombuffer(own.get(2, bytes(4)), "<f4")[0]))
                self.kind.append(own.get(3, NORMAL))
            elif field == 3 and (dict(_fields(value)).get(2) or dict(_fields(value)).get(4, 1)):
                raise ValueError("this model normalises text, which isn't supported")
        used = [i for i, k in enumerate(self.kind) if k in (NORMAL, USER_DEFINED)]
        if any(SPACE_MARK in self.text[i].lstrip(SPACE_MARK) for i in used):
            raise ValueError("this model has pieces that go over a space, which isn't supported")
        self.longest = max(len(self.text[i]) for i in used)
        self.unknown = min(self.score[i] for i in used) - UNKNOWN_PENALTY
        self.unknown_id = self.kind.index(UNKNOWN)
        self.byte_id = {int(self.text[i][3:5], 16): i for i, k in enumerate(self.kind) if k == BYTE}
        keys = np.array([self._key(self.text[i]) for i in used], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array(used, np.int64)[order], np.array(self.score)[used][order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.sketch = np.zeros(int(_SKETCH) + 1, bool)
        self.sketch[self.keys & _SKETCH] = True
        # Characters that are only ever a unit of their own may be cut at; long lines fall apart there.
        joined = set("".join(self.text[i] for i in used if len(self.text[i]) > 1))
        cut = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.unit = re.compile(f"[{cut}]|{SPACE_MARK}*[^{SPACE_MARK}{cut}]+|{SPACE_MARK}+" if cut else f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
        raw = [b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(SPACE_MARK, " ").encode() for t, k in zip(self.text, self.kind, strict=True)]
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.known, self.most_known = {}, most_known

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        """Rolling sums of columns of code points: row j is that of the first j."""
        out = np.zeros((codes.shape[0] + 1, codes.shape[1]), np.uint64)
        for j in range(codes.shape[0]):
            out[j + 1] = out[j] * _BASE + codes[j] + np.uint64(1)
        return out

    @staticmethod
    def _power(n: int) -> np.uint64:
        return np.uint64(pow(int(_BASE), n, 1 << 64))

    def _key(self, piece: str) -> np.uint64:
        codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)[:, None].astype(np.uint64)
        return mix(self._sums(codes)[-1] + np.uint64(len(piece)))[0]

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of code points (of one length) one after another, and how many each has; -1 - c stands for a
        character c that no piece covers."""
        n, size = codes.shape
        codes = np.ascontiguousarray(codes.T).astype(np.uint64)  # a row for each place
        sums, score, found = self._sums(codes), {}, {}
        for k in range(1, min(self.longest, size) + 1):  # substrings of k characters, by their start
            key = mix(sums[k:] - sums[:-k] * self._power(k) + np.uint64(k))
            some = np.flatnonzero(self.sketch[key & _SKETCH])  # few others have a piece's low bits
            own = key.reshape(-1)[some]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            hit = self.keys[at] == own
            if k == 1:
                score[k], found[k] = np.full(key.shape, self.unknown), -1 - codes.astype(np.int64)
            elif hit.any():
                score[k], found[k] = np.full(key.shape, -np.inf), np.zeros(key.shape, np.int64)
            if hit.any():
                score[k].reshape(-1)[some[hit]], found[k].reshape(-1)[some[hit]] = self.scores[at[hit]], self.ids[at[hit]]
        best, length, last = [np.zeros(n)], np.ones((size + 1, n), np.int16), np.zeros((size + 1, n), np.int64)
        for j in range(1, size + 1):
            most = np.full(n, -np.inf)
            for k in sorted(score, reverse=True):  # the longest first, which ties go to
                if k <= j:
                    own = best[j - k] + score[k][j - k]
                    better = own > most
                    np.copyto(most, own, where=better)
                    np.copyto(last[j], found[k][j - k], where=better)
                    length[j][better] = k
            best.append(most)
        steps, at, row = [], np.full(n, size), np.arange(n)
        while at.any():
            steps.append(np.where(at > 0, last[at, row], np.iinfo(np.int64).min))
            at = at - np.where(at > 0, length[at, row], 0)
        table = np.stack(steps[::-1], axis=1)
        held = table != np.iinfo(np.int64).min
        return table[held], held.sum(1)

    def search_long(self, codes: np.ndarray) -> np.ndarray:
        """The ids of one long unit, as search() gives them: its substrings are looked up some thousand places at a time, those
        that are pieces alone are kept, and what stays of a place is the length and the id of its last piece."""
        size, back = len(codes), self.longest
        length, last = np.ones(size + 1, np.int16), np.zeros(size + 1, np.int64)
        last[1:] = -1 - codes.astype(np.int64)
        best = [-np.inf] * (back - 1) + [0.0]  # of the last `back` places
        for begin in range(0, size, LONG):
            low, high = max(0, begin - back + 1), min(size, begin + LONG)
            sums = self._sums(codes[low:high, None].astype(np.uint64))[:, 0]
            ends: list[list[tuple[int, float, int]]] = [[] for _ in range(high - begin)]
            for k in range(min(back, high - low), 0, -1):
                key = mix(sums[k:] - sums[:-k] * self._power(k) + np.uint64(k))[max(0, begin - low - k + 1) :]
                some = np.flatnonzero(self.sketch[key & _SKETCH])
                at = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
                hit = self.keys[at] == key[some]
                first = max(0, k - 1 - (begin - low))  # the first end that has k characters before it here
                for end, score, i in zip((some[hit] + first).tolist(), self.scores[at[hit]].tolist(), self.ids[at[hit]].tolist(), strict=True):
                    ends[end].append((k, score, i))
            for j, found in enumerate(ends, begin + 1):
                most, alone = -np.inf, True
                for k, score, i in found:  # the longest first, which ties go to
                    own = best[-k] + score
                    alone = alone and k > 1
                    if own > most:
                        most, length[j], last[j] = own, k, i
                if alone and best[-1] + self.unknown > most:
                    most, length[j], last[j] = best[-1] + self.unknown, 1, -1 - int(codes[j - 1])
                best.append(most)
                del best[0]
        out, at = [], size
        while at:
            out.append(last[at])
            at -= int(length[at])
        return np.array(out[::-1], np.int64)

    def _covered(self, ids: np.ndarray) -> bytes:
        """Packed ids, with byte pieces in the place of uncovered characters."""
        out = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in chr(-1 - i).encode("utf-8")]
            elif not (out and out[-1] == self.unknown_id):  # neighbours are one unknown piece
                out.append(self.unknown_id)
        return array("i", out).tobytes()

    def _searched(self, units: set[str]) -> dict[str, bytes]:
        """Packed ids of units, those of equal length together."""
        by_length, out = sorted(units, key=len), {}
        for size, own in groupby(by_length, len):
            own = list(own)
            if size > LONG:
                for unit in own:
                    ids = self.search_long(np.frombuffer(unit.encode("utf-32-le"), np.uint32))
                    out[unit] = self._covered(ids) if (ids < 0).any() else ids.astype("<i4").tobytes()
                continue
            for at in range(0, len(own), max(1, 200_000 // size)):
                part = own[at : at + max(1, 200_000 // size)]
                ids, n = self.search(np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(len(part), size))
                cut = np.append(0, np.cumsum(n))
                data, ends = ids.astype("<i4").tobytes(), (4 * cut).tolist()
                out.update(zip(part, (data[x:y] for x, y in pairwise(ends)), strict=True))
                for k in np.unique(np.searchsorted(cut, np.flatnonzero(ids < 0), "right") - 1).tolist():
                    out[part[k]] = self._covered(ids[cut[k] : cut[k + 1]])
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the space mark that the format puts before it; none for a null or empty text."""
        if len(self.known) > self.most_known:
            self.known.clear()
        get = self.known.get
        # Where no two space marks meet, what follows one is a chunk; other texts are split into units as a whole.
        split = [[] if not t else t.split(" ") if "  " not in t and t[0] != " " and SPACE_MARK not in t else None for t in texts]
        found = [list(map(get, own)) if own is not None else None for own in split]
        units = {t: self.unit.findall(SPACE_MARK + t.replace(" ", SPACE_MARK)) for t, own in zip(texts, split, strict=True) if own is None}
        lacking = [i for i, own in enumerate(found) if own is not None and None in own]
        new = {c: self.unit.findall(SPACE_MARK + c) for c in {c for i in lacking for c, ids in zip(split[i], found[i], strict=True) if ids is None}}
        ids = self._searched({u for own in (*units.values(), *new.values()) for u in own})
        self.known.update((c, ids[own[0]] if len(own) == 1 else b"".join([ids[u] for u in own])) for c, own in new.items())
        for i in lacking:
            found[i] = [get(c) if x is None else x for c, x in zip(split[i], found[i], strict=True)]
        return [np.frombuffer(b"".join(own if own is not None else [ids[u] for u in units[t]]), "<i4") for t, own in zip(texts, found, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: their bytes, less the first space. Space marks in a text come back as spaces."""
        size = self.raw_size[ids]
        start = np.cumsum(size) - size
        raw = self.raw[np.repeat(self.raw_at[ids] - start, size) + np.arange(size.sum())].tobytes()
        return raw.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    """The pieces of a file, read once by each Python worker."""
    return Pieces(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chars, n_tokens, ids and decoded (the text that the ids give back) of docs (doc_id, text). A null text is empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for at in pieces(texts):
                ids = own.encode(texts[at])
                size = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                chars = pa.array([len(t) for t in texts[at]], pa.int64())
                back = pa.array([own.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at.start, at.stop - at.start), chars, pa.array(size), lists, back], names=["doc_id", "n_chars", "n_tokens", "ids", "decoded"])
            trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_chars long, n_tokens long, ids array<int>, decoded string")


def query(docs: DataFrame) -> DataFrame:
    """Each document's ids, and whether they decode to its text."""
    import public_tokenizers

    found = encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    # Length and hash stand for the decoded text here: the operator itself returns it.
    return found.select("doc_id", "n_chars", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the hash of what they decode to. Repeated rows are encoded as often as they come."""
    return query(spark.read.parquet(f"{sf_dir}/documents.parquet"))
