"""Words of a build that fools polynomial hashes modulo a power of two: nothing takes one for another."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from termloom.llm import ngram_join, token_files
from termloom.llm.common import Words, span_hashes

SIZES = [64, 128, 256, 512, 1024, 2048, 8192]


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", SIZES)
def test_hashes_differ(n):
    a, b = thue_morse(n, "ab"), thue_morse(n, "ba")
    assert len(set(Words([a, b, f"x {a}"]).hash.tolist())) == 3
    raw = np.frombuffer((a + b).encode(), np.uint8)
    at = np.array([0, n])
    for second in (False, True):
        x, y = span_hashes(raw, at, at + n, second)
        assert x != y


def test_queries_tell_them_apart(spark, folder):
    texts = [f"one two {thue_morse(n, letters)} three four" for n in SIZES for letters in ("ab", "ba")]
    rows = list(enumerate(texts))
    sf = folder(documents=(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in ngram_join.op6(spark, sf).collect()) == [(i, i) for i, _ in rows]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: zlib.crc32(np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, x in rows}
    assert {r.doc_id: r.ids_crc32 for r in token_files.op10(spark, sf).collect()} == want
