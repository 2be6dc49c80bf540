import hashlib
import random
import struct
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import sentencepieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, ids string, n_tokens int"


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The file as a unigram model, which the library searches for the largest sum of scores. Its runs of spaces score
    -1e9, beside which the library's single precision loses small differences; here they score -40000."""
    with open(PATH, "rb") as f:
        data = f.read()
    head, mark, tail = data.partition(b"tok_v0\x18\x02")  # type 2 follows the model's name
    assert mark
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    path.write_bytes((head + b"tok_v0\x18\x01" + tail).replace(struct.pack("<f", -1e9), struct.pack("<f", -40000.0)))
    return str(path)


def brute(pieces, unit):
    """The best segmentation of a unit by trying every last piece."""
    known = {pieces.text[i]: (pieces.score[i], i) for i, k in enumerate(pieces.kind) if k == sentencepieces.NORMAL}
    best = [(0.0, [])]
    for j in range(1, len(unit) + 1):
        options = [(best[i][0] + known[unit[i:j]][0], best[i][1] + [known[unit[i:j]][1]]) for i in range(j) if unit[i:j] in known]
        if unit[j - 1] not in known:
            options.append((best[j - 1][0] + pieces.unknown, best[j - 1][1] + [pieces.byte_id[b] for b in unit[j - 1].encode()]))
        best.append(max(options, key=lambda x: x[0]))
    return best[-1][1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdefghilmnorstu ▁\né.,T\U0001f600", min_size=1, max_size=24))
def test_against_every_segmentation(text):
    own = sentencepieces.model(PATH)
    assert own.encode([text])[0].tolist() == brute(own, "▁" + text.replace(" ", "▁"))
    assert own.decode(own.encode([text])[0]) == text.replace("▁", " ")


def test_against_the_library(spark, unigram):
    own, library, n = sentencepieces.Pieces(unigram), sentencepiece.SentencePieceProcessor(model_file=unigram), 0
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        for line in r.text.split("\n"):
            for part in (line[i : i + 400] for i in range(0, len(line), 400)):
                n += 1
                ids = own.encode([part])[0]
                assert ids.tolist() == library.encode(part) and own.decode(ids) == part
    assert n > 1000


def test_query(spark, folder):
    texts = ["Hello world", "", None, "  two  spaces ", "x" * 3000, "tab\there\r\n\n日本語 \U0001f600", "word " * 20000, "Hello world"]
    rows = [(i if i < 7 else None, t, "s", 1) for i, t in enumerate(texts)]
    got = sentencepieces.op3(spark, folder(documents=(rows, DOCS))).collect()
    by_id = {r.doc_id: r for r in got}
    for doc_id, text, *_ in rows:
        r = by_id[doc_id]
        assert r.n_tokens == len(r.ids) and r.n_chars == len(text or "")
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert by_id[None].ids == by_id[0].ids and by_id[1].ids == []


def test_no_rows(spark, folder):
    assert sentencepieces.op3(spark, folder(documents=([], DOCS))).count() == 0


def test_long_units_are_searched_alike(monkeypatch):
    own = sentencepieces.Pieces(PATH)
    rng = random.Random(5)
    for size, alphabet in ((1, "a"), (7, "ab"), (900, "the\U0001f600 日e"), (1200, "aaaaab"), (700, "ionatdx.é")):
        codes = np.frombuffer("".join(rng.choice(alphabet) for _ in range(size)).encode("utf-32-le"), np.uint32)
        want = own.search(codes[None, :])[0].tolist()
        for block in (1, 16, 37, 5000):
            monkeypatch.setattr(sentencepieces, "LONG", block)
            assert own.search_long(codes).tolist() == want


def test_a_very_long_text_without_spaces():
    own = sentencepieces.Pieces(PATH)
    text = "abcdéf日" * 40_000
    began = time.process_time()
    ids = own.encode([text])[0]
    assert own.decode(ids) == text and time.process_time() - began < 60
