"""WARC archives: exact round trip, offsets, other writers' files."""

import gzip
import hashlib
import io
import zlib

import pytest

from lendwell.llm import warc
from lendwell.session import scratch_path

BIG = "x" * 150
PAGES = [
    (5, "http://a/ b\r\nc", BIG, "one"),
    (3, None, BIG, "two"),
    (9, "http://c", BIG, "two"),
    (9, "http://c", BIG, "two"),
    (7, "http://d", "short é", None),
    (8, "http://e", "short é", None),
    (1, "http://f", None, None),
    (2, "http://g", "", None),
    (None, "http://h", BIG, None),
    (11, "http://i", "\r\n\r\nWARC/1.1\r\n" + "ü" * 70_000, None),
]


def expected():
    out = []
    for page, _, html, _ in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h, _ in PAGES if p is not None and (h or "") == (html or "")]
        later = len(payload) >= 100 and page is not None and page > min(same)
        out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if later else "response", min(same) if later else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")
    rows = warc.archive_round_trip(df).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows]
    assert sorted(got, key=str) == expected()
    html = {p: h for p, _, h, _ in PAGES}
    assert all(bytes(r.payload).decode() == (html[r.page_id] or "") for r in rows if r.record_type == "response")


def test_members_stand_alone(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string")
    whole, single = scratch_path(spark, "t"), scratch_path(spark, "t")
    warc.write_archives(df, whole)
    index = warc.normalise(spark, whole, single).collect()
    assert len(index) == len(PAGES)
    for file in {r.file for r in index}:
        rows = sorted((r.start, r.length) for r in index if r.file == file)
        data = open(file.removeprefix("file://"), "rb").read()
        at = 0
        for start, length in rows:
            assert start == at
            box = zlib.decompressobj(31)
            assert box.decompress(data[start : start + length]).startswith(b"WARC/1.1\r\n") and box.eof
            at += length
        assert at == len(data)
        listed = open(file.removeprefix("file://") + ".idx").read().splitlines()
        assert len(listed) == len(rows) + 1


def record(body: bytes) -> bytes:
    return b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)


@pytest.mark.parametrize("members", [1, 3])
def test_streams_of_one_or_many_members(members):
    bodies = [b"a" * n for n in (0, 1, 5_000_000)]
    raw = [record(b) for b in bodies]
    data = gzip.compress(b"".join(raw)) if members == 1 else b"".join(map(gzip.compress, raw))
    assert [block for _, _, block in warc.records(io.BytesIO(data))] == bodies


def test_broken_streams_are_refused():
    data = gzip.compress(record(b"a" * 1000))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-20])))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(b"no record at all"))))


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_round_trip(df).count() == 0
