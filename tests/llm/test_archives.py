import hashlib

import pytest

from termloom.llm import archives

PAGES = "page_id long, url string, html string, id string, digest string"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    blocks = [("http://a/b", b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\n\n\nx\r\n\r\nWARC/1.1\r\n"), ("urn:none", b""), ("http://c/", b"\n" * 5)]
    got = list(archives.arc_records(archives.arc_file("f.arc.gz", version, "20200102030405", blocks)))
    assert [(r.fields["url"], r.block) for r in got] == blocks
    assert set(got[0].fields) == {x.lower() for x in archives.ARC_FIELDS[version]}
    assert archives.warc_date(got[0].fields["archive-date"]) == "2020-01-02T03:04:05Z"


def test_short_records_are_errors():
    whole = archives.plain(archives.arc_file("f", 1, "20200101000000", [("u", b"abcdef")]))
    with pytest.raises(ValueError):
        list(archives.arc_records(whole[:-4]))


def test_warc_payload_may_hold_record_marks():
    block = b"HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (got,) = archives.warc_records(archives.warc_record([("WARC-Type", "response")], block))
    assert got.block == block and got.http()[1] == block[19:]


def test_query_edges(spark, folder):
    big, small = "<p>é\r\n\r\nWARC/1.1</p>" * 20, "x" * 99
    rows = [(5, "http://a b/\n", big, "i", "d"), (3, None, big, "i", "d"), (9, "", big, "i", "d"), (4, "u", small, "i", "d"), (2, "u", small, "i", "d"), (7, "u", None, "i", "d"), (8, "u", "", None, None), (None, "u", big, "i", "d"), (11, "u", "z" * 300_000, "i", "d"), (12, "u", big + " ", "i", "d"), (12, "u", big + " ", "i", "d")]
    got = archives.op5(spark, folder(pages=(rows, PAGES))).collect()
    want = []
    for page_id, _, html, *_ in rows:
        data = (html or "").encode()
        first = min((r[0] for r in rows if r[2] == html and r[0] is not None), default=None) if len(data) >= 100 else page_id
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), *(("response", None) if first == page_id else ("revisit", first))))
    twin = want.pop()
    want.append((*twin[:3], "revisit", 12))  # of two equal rows one is the response
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_no_rows(spark, folder):
    assert archives.op5(spark, folder(pages=([], PAGES))).count() == 0
