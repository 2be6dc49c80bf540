import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termloom.llm import simple8b, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, start string, part int"
TEXTS = ["", "a", "Hello, world's end", "two  spaces", " lead", "trail ", "a\n b", "a\n  b", "a \n b\n", "x  y  z", "   ", "<|endoftext|> here", "é\U0001f600 日本語", "a \t b", "q\n \nr", "don't  'll 12 3"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.just(0), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=300), st.integers(1, 60))
def test_round_trip(values, times):
    v = np.array(values * times, np.uint64)
    assert (simple8b.decode(*simple8b.encode(v)) == v).all()


def test_files_hold_documents():
    ids = [np.arange(n, dtype=np.uint64) * 7 for n in (0, 5, 9000, 1)]
    got = list(simple8b.unpack(simple8b.pack([3, None, 5, 9], ids), blocks_at_once=1))
    assert [k for k, _ in got] == [3, None, 5, 9] and all((a == b).all() for a, (_, b) in zip(ids, got, strict=True))
    assert list(simple8b.unpack(simple8b.pack([], []))) == []


def test_zeros_and_small_numbers_share_words():
    assert len(simple8b.encode(np.zeros(4096))[0]) < 25
    assert len(simple8b.encode(np.full(4096, 32767))[0]) == 1024


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t ab'sé1.", max_size=30))
def test_chunks_equal_the_library(text):
    if not hasattr(test_chunks_equal_the_library, "both"):
        small = type("Small", (token_files.ChunkEncoder,), {"SLOTS": 1 << 4, "MOST_IDS": 50, "TOGETHER": 3})
        test_chunks_equal_the_library.both = small(PATH), Tokenizer.from_file(PATH)
    mine, whole = test_chunks_equal_the_library.both
    assert mine([text])[0].tolist() == whole.encode(text, add_special_tokens=False).ids


def test_query(spark, folder):
    rows = [(i * 3 % 17, t, "s", 1) for i, t in enumerate(TEXTS)] + [(100, "word " * 20000, "s", 1), (None, None, "s", 1), (101, "twice", "s", 1), (101, "twice", "s", 1)]
    got = sorted(token_files.op10(spark, folder(documents=(rows, DOCS))).collect(), key=lambda r: r.start)
    t, start = Tokenizer.from_file(PATH), 0
    for r, (doc_id, text, *_) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_no_rows(spark, folder):
    assert token_files.op10(spark, folder(documents=([], DOCS))).count() == 0
