"""Legacy ARC archives to WARC.

An ARC file begins with a version block; the version tells which fields the line
before each record has, the last of them the length of what follows. From that
line and the record the converter makes a WARC record: identifier, time, type and
digests. Archives are written by Spark's text writer: a WARC record ends with
CRLF CRLF, which is the line separator here, and the bytes are written as they are.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm.common import ready
from siftlog.session import stage, stage_path

# The fields of a record's line in each version of ARC.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
# An archive is closed from this many bytes on.
ARCHIVE_BYTES = 8 << 20
CAPTURED = "20000101000000"
CRLF = "\r\n"
PAGE_HEADER = "X-Page-Id"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _url_field(url: str | None) -> str:
    """A URL as one field of a line: white space and control signs are percent-encoded; "-" for none."""
    return re.sub(r"[\x00-\x20\x7f\x85\xa0  ]", lambda sign: "".join(f"%{byte:02X}" for byte in sign[0].encode()), url or "-")


def _version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 Origin\n{' '.join(ARC_FIELDS[version])}\n"
    facts = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/plain", "Archive-length": str(len(body))}
    rest = {"Result-code": "200", "Offset": "0", "Filename": name}
    return (" ".join((facts | rest).get(field, "-") for field in ARC_FIELDS[version]) + "\n" + body).encode()


def write_arc(pages: DataFrame) -> str:
    """Write `pages` (page_id, url, html) as gzipped ARC files, of both versions, and return their folder.

    Each task writes what it reads, without a shuffle. A row of the output is a
    whole archive of about ARCHIVE_BYTES and a file of its own.
    """
    narrow = pages.select("page_id", "url", "html")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                version, name = 1 + (part + number) % 2, f"pages-{part:05d}-{number:05d}.arc"
                if not held:
                    held.append(_version_block(version, name))
                payload = (html or "").encode()
                own = "" if page is None else f"{PAGE_HEADER}: {page}{CRLF}"
                http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{own}{CRLF}".encode()
                facts = {"URL": _url_field(url), "IP-address": "0.0.0.0", "Archive-date": CAPTURED, "Content-type": "text/html", "Result-code": "200", "Offset": str(size), "Filename": name, "Archive-length": str(len(http) + len(payload))}
                line = " ".join(facts.get(field, "-") for field in ARC_FIELDS[version])
                held.append(line.encode() + b"\n" + http + payload)
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], ["archive"])
                    number, held, size = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], ["archive"])

    path = stage_path(pages.sparkSession, "arc")
    rows = narrow.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string"))
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)
    return path


@dataclass(frozen=True)
class ArcRecord:
    """One record of an ARC file with the fields of its line."""

    fields: dict[str, str]
    body: bytes
    offset: int


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first; by declared lengths."""
    at, names = 0, ARC_FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"no end of the line at byte {at}")
        line = data[at:stop].rstrip(b"\r").decode("utf-8", "replace")
        body_at = stop + 1
        if line.startswith("filedesc://"):
            # The block says which fields its own line has, so its length is the last one in any version.
            length = int(line.rsplit(" ", 1)[1])
            version = int(data[body_at : body_at + length].split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"version {version} of ARC")
            names = ARC_FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)
        if len(parts) != len(names):
            raise ValueError(f"{len(parts)} fields at byte {at}")
        fields = dict(zip(names, parts))
        length = int(fields["Archive-length"])
        body = data[body_at : body_at + length]
        if len(body) != length:
            raise ValueError(f"the record at byte {at} is cut off")
        yield ArcRecord(fields, body, at)
        at = body_at + length


def warc_date(stamp: str) -> str:
    """An ARC time, of 4 to 14 digits, in ISO form."""
    digits = re.sub(r"\D", "", stamp)[:14]
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP headers with the empty line, and the payload."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if block.startswith(b"HTTP/") and at >= 0 else (b"", block)


def _header(block: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", block)
    return found[1].decode("utf-8", "replace") if found else None


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _plain(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


_FACTS = {
    "archive": pa.string(), "offset": pa.int64(), "record_id": pa.string(), "kind": pa.string(), "uri": pa.string(), "date": pa.string(), "ip": pa.string(), "mime": pa.string(),
    "payload_digest": pa.string(), "block_digest": pa.string(), "page_id": pa.int64(), "payload_bytes": pa.int64(),
}
_BYTES = {"http": pa.binary(), "payload": pa.binary()}
_LINKS = {"revisits": pa.string(), "refers_to": pa.int64()}
_KINDS = {pa.string(): "string", pa.binary(): "binary", pa.int64(): "long"}


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds.values())], list(kinds))


def _ddl(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{name} {_KINDS[kind]}" for name, kind in kinds.items())


def _converted(archive: str, data: bytes) -> Iterator[tuple[tuple, tuple[bytes, bytes]]]:
    """The facts of each record in the form of WARC, and its HTTP headers and payload."""
    for record in parse_arc(_plain(data)):
        http, payload = split_http(record.body)
        block_digest = sha1_base32(record.body)
        made = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{record.offset}:{block_digest}")
        uri = record.fields["URL"]
        kind = "warcinfo" if uri.startswith("filedesc://") else "response" if http else "resource"
        page = _header(http, PAGE_HEADER)
        when, ip, mime = warc_date(record.fields["Archive-date"]), record.fields["IP-address"], record.fields["Content-type"]
        yield (archive, record.offset, f"<urn:uuid:{made}>", kind, uri, when, ip, mime, sha1_base32(payload), block_digest, int(page) if page else None, len(payload)), (http, payload)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files in the form of WARC: place, identifier, type, time and digests.

    The identifier is derived from archive, place and content, so that a task that
    runs again gives the same one. Version blocks become `warcinfo`, HTTP messages
    `response`, anything else `resource`.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                yield _batch([facts for facts, _ in _converted(name.as_py(), content.as_py())], _FACTS)

    return _files(spark, path).mapInArrow(convert, _ddl(_FACTS))


def revisits_of(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`archive`, `offset`, `revisits` and `refers_to` of every response whose payload an earlier one has.

    The first is the one with the smallest page_id, null last; rows that share it
    are all first. Payloads under `least_bytes` are left as they are.
    """
    pages = records.filter((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "record_id")
    firsts = pages.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = pages.join(firsts.select("payload_digest", "first"), "payload_digest")
    later = joined.filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    return later.select("archive", "offset", F.col("first.record_id").alias("revisits"), F.col("first.page_id").alias("refers_to"))


def with_revisits(spark: SparkSession, path: str, revisits: DataFrame) -> DataFrame:
    """The records of ARC files with headers and payload, and what they revisit.

    The revisits of an archive go to it as one list, no longer than the archive, so
    that archives move compressed, if at all.
    """
    lists = revisits.groupBy("archive").agg(F.collect_list(F.struct("offset", "revisits", "refers_to")).alias("links"))
    kinds = {**_FACTS, **_BYTES, **_LINKS}

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (name, content) in enumerate(zip(batch.column("path"), batch.column("content"))):
                links = {link["offset"]: (link["revisits"], link["refers_to"]) for link in batch.column("links")[i].as_py() or []}
                rows, held = [], 0
                for facts, body in _converted(name.as_py(), content.as_py()):
                    rows.append((*facts, *body, *links.get(facts[1], (None, None))))
                    held += len(body[1])
                    if held > 4 << 20:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                yield _batch(rows, kinds)

    joined = _files(spark, path).join(lists, F.col("path") == F.col("archive"), "left").select("path", "content", "links")
    return joined.mapInArrow(convert, _ddl(kinds))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def write_warc(records: DataFrame) -> str:
    """Write records as gzipped WARC files and return their folder. Revisits keep the HTTP headers only."""
    revisit = F.col("revisits").isNotNull()
    body = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    mime = F.when(F.col("kind") == "response", F.lit("application/http;msgtype=response")).when(F.col("kind") == "warcinfo", F.lit("application/warc-fields")).otherwise(F.col("mime"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("kind"))),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.when(F.col("kind") != "warcinfo", F.col("uri"))),
        _line("WARC-IP-Address", F.col("ip")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Block-Digest", F.when(~revisit, F.concat(F.lit("sha1:"), "block_digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.col("revisits")),
        _line("WARC-Refers-To-Page-Id", F.col("refers_to")),
        _line("Content-Type", mime),
        _line("Content-Length", F.octet_length("_body")),
        F.lit(CRLF),
    )
    path = stage_path(records.sparkSession, "warc")
    rows = records.withColumn("_body", body).select(F.concat(head.cast("binary"), "_body").cast("string").alias("record"))
    rows.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
    return path


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        stop = data.index(b"\r\n\r\n", at)
        pairs = (line.split(":", 1) for line in data[at:stop].decode("utf-8", "replace").split(CRLF)[1:])
        headers = {name.strip().lower(): value.strip() for name, value in pairs}
        length = int(headers["content-length"])
        block = data[stop + 4 : stop + 4 + length]
        at = stop + 4 + length
        if len(block) != length or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} is cut off")
        at += 4
        yield headers, block


_READ = {"page_id": pa.int64(), "uri": pa.string(), "record_id": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64()}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What WARC files hold of pages: a row per response or revisit, digests checked against the bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for headers, block in parse_warc(_plain(content.as_py())):
                    kind = headers["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    http, payload = split_http(block)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and sha1_base32(payload) != digest:
                        raise ValueError(f"the digest of {headers['warc-record-id']} is wrong")
                    page, refers = _header(http, PAGE_HEADER), headers.get("warc-refers-to-page-id")
                    size = len(payload) if kind == "response" else int(_header(http, "Content-Length") or 0)
                    rows.append((int(page) if page else None, headers.get("warc-target-uri"), headers["warc-record-id"], kind, size, digest, int(refers) if refers else None))
                yield _batch(rows, _READ)

    return _files(spark, path).mapInArrow(read, _ddl(_READ))


def convert_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write `pages` as ARC, convert the archives to WARC, and read these back: a row per page.

    A null html is empty, a null url "-", a null page_id stays null and sorts last.
    Equal payloads: the smallest page_id is the response, others revisit it; rows
    that repeat that page_id are responses too. Other columns are not read. An
    empty table gives no archive and no rows.
    """
    spark = ready(pages.sparkSession)
    path = write_arc(pages)
    records = stage(read_arc(spark, path).select("archive", "offset", "kind", "record_id", "page_id", "payload_digest", "payload_bytes"), "records")
    return read_warc(spark, write_warc(with_revisits(spark, path, revisits_of(records, least_bytes))))
