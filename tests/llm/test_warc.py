import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from siftlog.llm import common, warc

PAGES = "page_id long, url string, html string, payload string, record_id string"
ROWS = [
    (5, "http://a.example/x y", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"), (9, None, "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"),
    (3, "u", None), (4, "u", ""), (6, "v", "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nfiledesc://x\n1 0"), (7, "w\n ", "é\U0001f600" * 20_000), (None, "z", "<p>same</p>"), (None, "z", "alone"),
]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows):
    first = {}
    for page, _, text in rows:
        if page is not None:
            first[text or ""] = min(page, first.get(text or "", page))
    out = []
    for page, _, text in rows:
        least = first.get(text or "")
        revisit = page != least
        out.append((page, len((text or "").encode()), digest(text), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4_000)
    pages = spark.createDataFrame([(*row, "own", "own") for row in ROWS], PAGES)
    found = warc.convert_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=str) == expected(ROWS)


def test_small_payloads_are_left(spark):
    pages = spark.createDataFrame([(*row, "own", "own") for row in ROWS[:2]], PAGES)
    assert {row.record_type for row in warc.convert_pages(pages, least_bytes=100).collect()} == {"response"}


def test_empty(spark):
    assert warc.convert_pages(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_versions_of_arc(version):
    body = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nhello\n\nhttp://next 1.1.1.1 2000 text/html 5\n"
    line = {1: "http://a b/ 10.0.0.1 20010203040506 text/html {n}", 2: "http://a b/ 10.0.0.1 20010203040506 text/html 200 - - 12 name {n}"}[version].format(n=len(body)).encode()
    data = warc._version_block(version, "n.arc") + b"\n" + line + b"\n" + body + b"\n" + line + b"\n" + body
    records = list(warc.parse_arc(data))
    assert [record.fields["URL"] for record in records] == ["filedesc://n.arc", "http://a b/", "http://a b/"]
    assert records[1].body == records[2].body == body
    assert warc.split_http(body)[1] == body[body.index(b"hello") :]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse_arc(data[:-1]))


def test_dates():
    assert warc.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert warc.warc_date("200102030405") == "2001-02-03T04:05:00Z"
    assert warc.warc_date("2001") == "2001-01-01T00:00:00Z"


def test_archives_are_plain_warc(spark):
    """The files hold nothing but records; identifiers are unique and revisits point to one."""
    common.ready(spark)
    pages = spark.createDataFrame([(*row, "own", "own") for row in ROWS], PAGES)
    path = warc.write_arc(pages)
    records = warc.with_revisits(spark, path, warc.revisits_of(warc.read_arc(spark, path)))
    folder = Path(warc.write_warc(records).removeprefix("file://"))
    found = [record for path in folder.glob("part-*") for record in warc.parse_warc(gzip.decompress(path.read_bytes()))]
    headers = [head for head, _ in found]
    ids = [head["warc-record-id"] for head in headers]
    assert len(set(ids)) == len(ids)
    assert {head["warc-type"] for head in headers} == {"warcinfo", "response", "revisit"}
    assert all(head["warc-refers-to"] in ids and head["warc-profile"] == warc.PROFILE for head in headers if head["warc-type"] == "revisit")
    assert all(head["warc-date"] == "2000-01-01T00:00:00Z" for head in headers)
    for head, block in found:
        if head["warc-type"] == "response":
            assert head["warc-block-digest"] == "sha1:" + warc.sha1_base32(block)
