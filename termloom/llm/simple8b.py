"""Simple-8b: unsigned numbers, as many to a 64-bit word as their widths allow, in blocks that decode as arrays.

A word's top four bits select how many numbers of which width its other sixty bits hold. Selector 1 is an escape: the number
(2 ** 60 or more) stands among the raw values at the end of its block. A file holds the token ids of whole documents:

    magic "S8BTOK1\\0", then as little-endian 64-bit numbers: ids, documents, blocks
    doc_id of each document (the least signed number: null), ids of each document
    of each block: offset of its first word (in words, from the first block's), words, raw values, ids
    the words of the blocks, each followed by the block's raw values
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

MAGIC = b"S8BTOK1\0"
BLOCK = 4096
#: Numbers in a word and bits of each, by selector: fixed values of the format.
COUNT = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 1
_SELECTOR = {int(n): s for s, n in enumerate(COUNT) if s != ESCAPE}
_SHORT = [(n, int(BITS[_SELECTOR[n]])) for n in range(1, 9)]
_LONG = [(n, int(BITS[_SELECTOR[n]])) for n in (10, 12, 15, 20, 30, 60, 240)]


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits of each number, 0 to 64."""
    if not len(v):
        return np.zeros(0, np.uint8)
    if int(v.max()) < 1 << 24:
        return np.maximum((v.astype(np.float32).view(np.int32) >> 23) - 126, 0).astype(np.uint8)  # a float's exponent
    high = v >> np.uint64(32)
    low = np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], low).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words with raw values, table): a row of table for each block of 4096 numbers: offset, words, raw values, numbers."""
    v = values.astype(np.uint64)
    blocks = -(-len(v) // BLOCK)
    widths = np.full((blocks, BLOCK + 240), 255, np.uint8)  # what lies beyond a block fits no word
    padded = np.full(blocks * BLOCK, 255, np.uint8)
    padded[: len(v)] = _widths(v)
    widths[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    most, short = widths[:, :BLOCK].copy(), np.zeros((blocks, BLOCK), np.uint8)
    for n, bits in _SHORT:  # most: the largest width among the next n
        if n > 1:
            np.maximum(most, widths[:, n - 1 : n - 1 + BLOCK], out=most)
        short += most <= bits
    take = short.astype(np.int16)
    some = np.flatnonzero((most <= 6).any(axis=1))  # blocks with words of ten numbers or more
    for at in range(0, len(some), 256):
        rows = some[at : at + 256]
        own, place, longer = widths[rows], np.arange(BLOCK + 240, dtype=np.int16), take[rows]
        for n, bits in _LONG:
            stop = np.minimum.accumulate(np.where(own > bits, place, np.int16(BLOCK + 240))[:, ::-1], axis=1)[:, ::-1]
            longer[(stop - place)[:, :BLOCK] >= n] = n
        take[rows] = longer
    # All blocks step from word to word together.
    size = np.minimum(BLOCK, len(v) - np.arange(blocks) * BLOCK)
    at, live, starts = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        starts.append(live * BLOCK + at[live])
        at[live] += np.maximum(take[live, at[live]], 1)
        live = live[at[live] < size[live]]
    first = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
    held = take.reshape(-1)[first]
    words = np.zeros(len(first), np.uint64)
    for n in np.unique(held):
        own = np.flatnonzero(held == n)
        s = ESCAPE if n == 0 else _SELECTOR[int(n)]
        word = np.full(len(own), s << 60, np.uint64)
        for j in range(int(n) if BITS[s] else 0):
            word |= v[first[own] + j] << np.uint64(j * int(BITS[s]))
        words[own] = word
    block = first // BLOCK
    raw = first[held == 0]
    n_words, n_raw = np.bincount(block, minlength=blocks), np.bincount(raw // BLOCK, minlength=blocks)
    offset = np.concatenate([[0], np.cumsum(n_words + n_raw)])
    out = np.zeros(offset[-1], np.uint64)
    out[np.arange(len(words)) + np.concatenate([[0], np.cumsum(n_raw)])[block]] = words
    out[np.arange(len(raw)) + np.cumsum(n_words)[raw // BLOCK]] = v[raw]
    return out, np.stack([offset[:-1], n_words, n_raw, size], axis=1).astype(np.uint64)


def decode(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The numbers of these blocks (rows of table, with all words of the file), in order."""
    if not len(table):
        return np.zeros(0, np.uint64)
    offset, n_words, n_raw, size = table.astype(np.int64).T
    block = np.repeat(np.arange(len(table)), n_words)
    where = np.arange(len(block)) + (offset - np.concatenate([[0], np.cumsum(n_words)[:-1]]))[block]
    raws = np.repeat(np.arange(len(table)), n_raw)
    raw_at = np.arange(len(raws)) + (offset + n_words - np.concatenate([[0], np.cumsum(n_raw)[:-1]]))[raws]
    own = words[where]
    selector = (own >> np.uint64(60)).astype(np.int64)
    count = COUNT[selector]
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(selector):
        k = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[first[k]] = words[raw_at]
        elif BITS[s]:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for j in range(int(COUNT[s])):
                out[first[k] + j] = (own[k] >> np.uint64(j * int(BITS[s]))) & mask
    if len(out) != size.sum():
        raise ValueError("a block doesn't hold as many numbers as its table says")
    return out


def pack(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file's bytes."""
    words, table = encode(np.concatenate(ids) if ids else np.zeros(0, np.uint64))
    named = np.array([-(2**63) if x is None else x for x in doc_ids], "<i8")
    sizes = np.array([len(x) for x in ids], "<u8")
    head = np.array([sizes.sum(), len(named), len(table)], "<u8")
    return b"".join([MAGIC, *(x.tobytes() for x in (head, named, sizes, table.astype("<u8"), words.astype("<u8")))])


def unpack(data: bytes, blocks_at_once: int = 256) -> Iterator[tuple[int | None, np.ndarray]]:
    """Of each document, its doc_id and ids. Blocks are decoded some hundred at a time."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    n_ids, n_docs, n_blocks = map(int, np.frombuffer(data, "<u8", 3, 8))
    at = 32
    named = np.frombuffer(data, "<i8", n_docs, at)
    sizes = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    table = np.frombuffer(data, "<u8", 4 * n_blocks, at + 16 * n_docs).reshape(n_blocks, 4)
    words = np.frombuffer(data, "<u8", -1, at + 16 * n_docs + 32 * n_blocks)
    ready, block = np.zeros(0, np.uint64), 0
    for doc_id, size in zip(named.tolist(), sizes.tolist(), strict=True):
        parts, have = [ready], len(ready)
        while have < size:
            parts.append(decode(words, table[block : block + blocks_at_once]))
            block, have = block + blocks_at_once, have + len(parts[-1])
        ready = np.concatenate(parts) if len(parts) > 1 else ready
        yield None if doc_id == -(2**63) else doc_id, ready[:size]
        ready = ready[size:]
