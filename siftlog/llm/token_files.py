"""Token ids of documents in binary files whose parts can be read alone.

A shard is one file in the public seekable format of zstandard: independent frames,
then skippable frames with the table of its documents and, last, the seek table with
the sizes and checksum of every frame. All numbers are little-endian.

    frame ...             ids of about FRAME_IDS, 2 or 4 bytes each; short documents whole
    skippable, documents  head (version, bytes of an id, partition, piece, documents), then
                          doc_id, whether it is null, and the number of ids of each
    skippable, seek table compressed size, size and checksum of each frame; frames, flags, magic

A reader takes the seek table from the end of the file, finds the frames of a document
by the running sums of the sizes, and decompresses and checks these alone.
"""

from __future__ import annotations

import os
import string
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlog.llm.common import ready, text_buffers, text_key
from siftlog.session import stage, stage_path

# Ids of a frame and of a shard, about; a longer document has frames, or a shard, of its own.
FRAME_IDS, SHARD_IDS = 1 << 16, 1 << 22
LEVEL = 3
# Magic numbers and flags of the seekable format, and the version of the table of documents.
SEEK_FRAME, DOCUMENT_FRAME, SEEK_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
VERSION = 1
_HEAD = "<HHIIQ"
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
# Parts of words whose ids a worker keeps, and ids of them; both start anew beyond that. Text bytes encoded at once.
MOST_PARTS, MOST_IDS, CHUNK_BYTES = 350_000, 1 << 21, 2 << 20
PARTS_AT_ONCE = 256
MARKS = string.punctuation
# Kinds of bytes, and bytes with A-Z read as a-z.
OTHER, SPACE, MARK, LETTER = range(4)
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = SPACE
_KIND[[*MARKS.encode()]] = MARK
_KIND[[*string.ascii_letters.encode()]] = LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NUL, _NON_ASCII = "\x00", "\x80"


class WordEncoder:
    """Ids of whole texts, from the ids of their words.

    The tokenizer must never join what white space separates, must split between a
    letter and final marks, and must read A-Z as a-z; this is tried at the start, and
    what does not hold is not used. A chunk with a special token in it is only cut at white
    space. The ids of parts are kept.
    """

    def __init__(self, spec: str) -> None:
        # Spark has a worker on each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.spec = spec
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        pairs = [(a, b) for a in ("ab", "x.", "1", "é") for b in ("cd", "'s", "2", "\u0301c", ".")]
        self.by_words = all(self._is_sum(f"{a}{gap}{b}", a, b) for a, b in pairs for gap in " \t\n\v\f\r")
        letters = [chr(i) for i in range(0x100) if _is_letter(chr(i))]
        tails = [*MARKS, *(a + b for a in MARKS for b in MARKS), MARKS, MARKS[::-1]]
        self.by_cores = self.by_words and all(self._is_sum(f"a{sign}{tail}", f"a{sign.lower() if sign < _NON_ASCII else sign}", tail) for tail in tails for sign in (letters if len(tail) == 1 else "aZé"))
        self.added = [token.content.encode() for token in self.tokenizer.get_added_tokens_decoder().values()]
        nul = self.plain([_NUL])[0]
        self.nul = nul[0] if self.by_words and len(nul) == 1 else None
        self.clear()

    def __reduce__(self) -> tuple:
        """A worker that gets this by broadcast makes its own, and keeps it from task to task."""
        return WordEncoder, (self.spec,)

    def _is_sum(self, whole: str, *parts: str) -> bool:
        return self.plain([whole])[0] == sum(self.plain(list(parts)), [])

    def clear(self) -> None:
        # Number of each part; the empty one is the first.
        self.parts: dict[str, int] = {"": 0}
        self.starts, self.lengths, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.pool = np.zeros(1 << 16, np.uint32)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, parts: list[str]) -> list[list[int]]:
        """Ids of some parts: they are encoded as one text with NULs between, which no other sign's ids hold."""
        if self.nul is None or any(_NUL in part for part in parts):
            return self.plain(parts)
        ids = self.plain([f" {_NUL} ".join(parts)])[0]
        cuts = [-1, *(i for i, value in enumerate(ids) if value == self.nul), len(ids)]
        own = [ids[a + 1 : b] for a, b in zip(cuts[:-1], cuts[1:])]
        return own if len(own) == len(parts) else self.plain(parts)

    def _learn(self, parts: list[str]) -> None:
        found = [ids for first in range(0, len(parts), PARTS_AT_ONCE) for ids in self._ids_of(parts[first : first + PARTS_AT_ONCE])]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        have = len(self.parts)
        count, total = have + len(found), self.used + int(lengths.sum())
        if count > len(self.starts):
            self.starts, self.lengths = (np.concatenate([old, np.zeros(count, np.int64)]) for old in (self.starts, self.lengths))
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(total, np.uint32)])
        self.lengths[have:count] = lengths
        self.starts[have:count] = self.used + np.cumsum(lengths) - lengths
        self.pool[self.used : total] = np.fromiter(chain.from_iterable(found), np.uint32, total - self.used)
        self.used = total
        self.parts.update(zip(parts, range(have, count)))

    def _parts_of(self, data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Words, cut before their final marks, and the number of parts before each text."""
        lower = _LOWER[data]
        plain = lower.tobytes()
        cuts = self.by_cores and not any(token in plain for token in self.added)
        data = lower if cuts else data
        kind = _KIND[data]
        inside = kind != SPACE
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        if cuts:
            # Of words with a mark at the end, the last byte that is no mark; if a letter ends there, the marks behind it are a part.
            first = np.flatnonzero(begins)
            ends = inside.copy()
            ends[:-1] &= ~inside[1:] | edge[1:-1]
            last = np.flatnonzero(ends)
            marked = kind[last] == MARK
            first, last = first[marked], last[marked]
            waiting = np.arange(len(last))
            while len(waiting):
                last[waiting] -= 1
                waiting = waiting[last[waiting] >= first[waiting]]
                waiting = waiting[kind[last[waiting]] == MARK]
            last = last[last >= first]
            sign, before = data[last], data[np.maximum(last - 1, 0)]
            letter = (kind[last] == LETTER) | ((before == 0xC3) & (sign >= 0x80) & (sign != 0x97) & (sign != 0xB7))
            begins[last[letter] + 1] = True
        starts = np.flatnonzero(begins)
        kept = np.concatenate(([0], np.cumsum(inside, dtype=np.int64)))
        offsets = np.concatenate((kept[starts], kept[-1:]))
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
        return parts, np.searchsorted(starts, bounds)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, given as bytes and where each begins, in order, and where each text's ids begin."""
        if not self.by_words:
            own = self.plain([data[a:b].tobytes().decode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
            upto = np.concatenate(([0], np.cumsum([len(ids) for ids in own], dtype=np.int64)))
            return np.fromiter(chain.from_iterable(own), np.uint32, int(upto[-1])), upto
        if len(self.parts) > MOST_PARTS or self.used > MOST_IDS:
            self.clear()
        parts, before = self._parts_of(data, bounds)
        coded = parts.dictionary_encode()
        listed = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [part for part in listed if part not in self.parts]
        if new:
            self._learn(new)
        codes = np.fromiter(map(self.parts.__getitem__, listed), np.int64, len(listed))[coded.indices.to_numpy()]
        upto = np.concatenate(([0], np.cumsum(self.lengths[codes])))
        places = np.repeat(self.starts[codes] - upto[:-1], np.diff(upto))
        places += np.arange(upto[-1])
        return self.pool[places], upto[before]


def _is_letter(sign: str) -> bool:
    return sign.isalpha() and (sign < _NON_ASCII or "\xc0" <= sign <= "\xff")


def _some_rows(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about CHUNK_BYTES each; a longer text is alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, last
        first = last


class ShardWriter:
    """Collects documents and gives the bytes of a shard, without the last number of the seek table."""

    def __init__(self, width: int, partition: int, piece: int) -> None:
        self.width, self.partition, self.piece = width, partition, piece
        self.frames: list[bytes] = []
        self.entries: list[tuple[int, int, int]] = []
        self.held, self.held_bytes, self.ids = [], 0, 0
        self.docs: list[tuple[int | None, int]] = []

    def _frame(self, data: bytes) -> None:
        packed = zstandard.ZstdCompressor(level=LEVEL).compress(data)
        self.frames.append(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.held_bytes = [], 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        most = FRAME_IDS * self.width
        if self.held_bytes + len(data) > most:
            self._flush()
        if len(data) > most:
            for at in range(0, len(data), most):
                self._frame(data[at : at + most])
        else:
            self.held.append(data)
            self.held_bytes += len(data)
        self.docs.append((doc_id, len(data) // self.width))
        self.ids += len(data) // self.width

    def finish(self) -> bytes:
        self._flush()
        head = struct.pack(_HEAD, VERSION, self.width, self.partition, self.piece, len(self.docs))
        ids = np.array([0 if doc is None else doc for doc, _ in self.docs], "<i8")
        nulls = np.array([doc is None for doc, _ in self.docs], np.uint8)
        table = head + ids.tobytes() + nulls.tobytes() + np.array([n for _, n in self.docs], "<u8").tobytes()
        listed = struct.pack("<II", DOCUMENT_FRAME, len(table)) + table
        entries = np.array([*self.entries, (len(listed), 0, 0)], _ENTRY).tobytes()
        seek = struct.pack("<II", SEEK_FRAME, len(entries) + 9) + entries + struct.pack("<IB", len(self.entries) + 1, HAS_CHECKSUMS)
        return b"".join([*self.frames, listed, seek])


class Shard:
    """A shard, by a function that reads `n` bytes from a place and the size of the file."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read = read
        frames, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        length = frames * _ENTRY.itemsize
        kind, stated = struct.unpack("<II", read(size - 17 - length, 8))
        if kind != SEEK_FRAME or stated != length + 9:
            raise ValueError("the seek table is damaged")
        entries = np.frombuffer(read(size - 9 - length, length), _ENTRY)
        self.entries = entries[:-1]
        self.places = np.concatenate(([0], np.cumsum(entries["packed"], dtype=np.int64)))
        listed = read(int(self.places[-2]), int(entries["packed"][-1]))
        version, self.width, self.partition, self.piece, n = struct.unpack_from(_HEAD, listed, 8)
        if struct.unpack_from("<I", listed)[0] != DOCUMENT_FRAME or version != VERSION:
            raise ValueError("the table of documents is damaged")
        at = 8 + struct.calcsize(_HEAD)
        self.doc_ids = np.frombuffer(listed, "<i8", n, at)
        self.is_null = np.frombuffer(listed, np.uint8, n, at + 8 * n).astype(bool)
        self.lengths = np.frombuffer(listed, "<u8", n, at + 9 * n).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.upto = np.concatenate(([0], np.cumsum(self.entries["size"], dtype=np.int64)))
        if self.upto[-1] != self.starts[-1] * self.width:
            raise ValueError("frames and documents differ in size")
        self._last: tuple[int, bytes] = (-1, b"")

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n], len(data))

    def frame(self, number: int) -> bytes:
        """A frame, decompressed and held against its checksum; the last one is kept."""
        if self._last[0] != number:
            packed, size, checksum = (int(x) for x in self.entries[number])
            data = zstandard.ZstdDecompressor().decompress(self.read(int(self.places[number]), packed), max_output_size=size)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
                raise ValueError(f"frame {number} is damaged")
            self._last = number, data
        return self._last[1]

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at a place of the table."""
        a, b = int(self.starts[place]) * self.width, int(self.starts[place + 1]) * self.width
        parts, number = [], int(np.searchsorted(self.upto, a, "right")) - 1
        while a < b:
            base, end = int(self.upto[number]), int(self.upto[number + 1])
            parts.append(self.frame(number)[a - base : min(b, end) - base])
            a, number = min(b, end), number + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int) -> str:
    """Encode `docs`, write shards in ascending order of doc_id, and return their folder.

    A null text is empty and so has `end_id` alone. A null doc_id comes last, rows with
    one id follow a hash of their text; rows equal in both are interchangeable. Ids must
    be integers. Other columns are not read. An empty table gives no shard.

    `tokenizer` is the place of a JSON file on the driver; its content goes to the workers.
    `end_id` closes each document. Tasks encode and write ranges of ids, so none holds more
    than a shard of about SHARD_IDS and the document that closes it.
    """
    spark = ready(docs.sparkSession)
    path = stage_path(spark, "tokens")
    encoder = WordEncoder(Path(tokenizer).read_text(encoding="utf-8"))
    width = 2 if max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
    shared = spark.sparkContext.broadcast(encoder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    order = [F.asc_nulls_last("doc_id"), F.asc("text_key")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, piece = None, 0
        for batch in batches:
            docs, (text, offsets) = batch.column("doc_id").to_pylist(), text_buffers(batch.column("text"))
            for first, last in _some_rows(offsets):
                a, b = int(offsets[first]), int(offsets[last])
                ids, bounds = shared.value.encode(text[a:b], offsets[first : last + 1] - a)
                data = np.insert(ids, bounds[1:], end_id).astype(f"<u{width}").tobytes()
                ends = ((bounds + np.arange(len(bounds))) * width).tolist()
                for doc, a, b in zip(docs[first:last], ends[:-1], ends[1:]):
                    writer = writer or ShardWriter(width, TaskContext.get().partitionId(), piece)
                    writer.add(doc, data[a:b])
                    if writer.ids >= SHARD_IDS:
                        yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], ["shard"])
                        writer, piece = None, piece + 1
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([writer.finish()], pa.binary())], ["shard"])

    shards = ranged.mapInArrow(pack, "shard binary").select(F.col("shard").cast("string"))
    # A shard is a row and a file of its own; the line separator is the number that ends a seek table.
    ending = struct.pack("<I", SEEK_MAGIC).decode("latin-1")
    shards.write.option("lineSep", ending).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)
    return path


_ROWS = "path string, partition int, piece int, place long, doc_id long, start long, n_tokens long, ids binary"


def _documents(files: DataFrame, chosen: bool) -> DataFrame:
    """The documents of shards; those at `places` alone if `chosen`."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _ROWS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for row, (path, content) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content"))):
                shard = Shard.of(memoryview(content.as_buffer()))
                rows, held = [], 0
                for place in sorted(batch.column("places")[row].as_py()) if chosen else range(len(shard.lengths)):
                    doc = None if shard.is_null[place] else int(shard.doc_ids[place])
                    data = shard.document(place).tobytes()
                    rows.append((path, shard.partition, shard.piece, place, doc, int(shard.starts[place]), int(shard.lengths[place]), data))
                    held += len(data)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)

    return files.mapInArrow(read, _ROWS)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """All documents of the shards of a folder: `path`, `partition`, `piece`, `place`, `doc_id`, `start` in the shard, `n_tokens` and the `ids` as 4 bytes each.

    Every frame is held against its checksum.
    """
    return _documents(_files(ready(spark), path), False)


def document_table(spark: SparkSession, path: str) -> DataFrame:
    """What the tables of documents say: the columns of `read_shards` without ids. No frame is decompressed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                shard = Shard.of(memoryview(content.as_buffer()))
                n = len(shard.lengths)
                ids = pa.array(shard.doc_ids, pa.int64(), mask=shard.is_null)
                columns = [pa.array([path] * n), pa.array([shard.partition] * n, pa.int32()), pa.array([shard.piece] * n, pa.int32()), pa.array(np.arange(n)), ids, pa.array(shard.starts[:-1]), pa.array(shard.lengths)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "partition", "piece", "place", "doc_id", "start", "n_tokens"])

    return _files(ready(spark), path).mapInArrow(read, _ROWS.removesuffix(", ids binary"))


def fetch(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The documents whose doc_id is in `wanted`, as `read_shards` gives them; only their frames are decompressed.

    Ids without a document give no row; a null id is never found; repeats in `wanted` count once.
    """
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    found = document_table(spark, path).join(asked, "doc_id", "left_semi")
    places = found.groupBy(F.col("path").alias("_path")).agg(F.collect_list("place").alias("places"))
    return _documents(_files(spark, path).join(places, F.col("path") == F.col("_path")).select("path", "content", "places"), True)


def with_starts(rows: DataFrame) -> DataFrame:
    """Turn `start` in the shard into the number of ids of all documents before.

    Shards are summed inside their partition; one row per partition carries sums on.
    """
    totals = stage(rows.groupBy("partition", "piece").agg(F.sum("n_tokens").alias("ids")), "shard-ids")
    inside = Window.partitionBy("partition").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.groupBy("partition").agg(F.sum("ids").alias("ids")).select("partition", F.coalesce(F.sum("ids").over(across), F.lit(0)).alias("before"))
    pieces = totals.select("partition", "piece", F.coalesce(F.sum("ids").over(inside), F.lit(0)).alias("within"))
    bases = pieces.join(before, "partition").select("partition", "piece", (F.col("within") + F.col("before")).alias("base"))
    return rows.join(bases, ["partition", "piece"]).withColumn("start", F.col("start") + F.col("base")).drop("base")


def with_checksums(rows: DataFrame) -> DataFrame:
    """Replace `ids` by `ids_crc32`, the CRC-32 of their bytes."""
    rest = [name for name in rows.columns if name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(data.as_buffer()) for data in batch.column("ids")], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in rest), sums], [*rest, "ids_crc32"])

    return rows.mapInArrow(run, ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in rest) + ", ids_crc32 long")
