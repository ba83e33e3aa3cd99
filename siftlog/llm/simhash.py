"""SimHash near-duplicates by covering locality-sensitive hashing.

The 64 bits get one of the seven non-zero vectors of three bits each. For each of
those vectors v, a mask holds the bits whose vector has an odd product with v. Two
fingerprints that differ in at most two bits agree on at least one of the seven
masks, for any two bits: some v is orthogonal to both of their vectors. So every
pair within the radius meets in some table, not just a likely one.

Inside a table nothing is compared pair by pair. A fingerprint is listed under
itself and under each fingerprint one free bit away; two that share a listing
differ in at most two bits, and two that differ in at most two bits share one. A
listing holds at most one member per free bit, so no group is large, and the links
to its smallest member keep all that is connected connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from xxhash import xxh64_intdigest

from siftlog.llm.common import long_array, ready, text_key
from siftlog.session import stage

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
# Shingles of one document that are held at once.
SHINGLES_AT_ONCE = 1 << 17
_LANES = np.uint64(0x0101010101010101)


def bit_vector(bit: int) -> int:
    """The vector of RADIUS + 1 bits of a bit of the fingerprint; never zero."""
    return bit % (2 ** (RADIUS + 1) - 1) + 1


def masks() -> list[int]:
    """The covering family, one mask for each non-zero vector."""
    return [
        sum(1 << bit for bit in range(BITS) if (bit_vector(bit) & vector).bit_count() % 2)
        for vector in range(1, 2 ** (RADIUS + 1))
    ]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def shingle_hashes(words: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a document, some at a time."""
    size = min(SHINGLE, len(words))
    for first in range(0, len(words) - size + 1, SHINGLES_AT_ONCE):
        part = words[first : first + SHINGLES_AT_ONCE + size - 1]
        joined = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())]
        yield np.fromiter(map(xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def bit_counts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each bit is set in hashes[bounds[i]:bounds[i + 1]]; none of these is empty.

    Eight bits are counted in one go, a byte each, over runs of at most 255.
    """
    runs = [np.arange(a, b, 255) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    cuts = np.concatenate(runs)
    owner = np.concatenate(([0], np.cumsum([len(run) for run in runs])[:-1]))
    counts = np.empty((len(cuts), 8, 8), dtype=np.int64)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, cuts)
        counts[:, :, shift] = sums.view(np.uint8).reshape(-1, 8)
    return np.add.reduceat(counts.reshape(-1, BITS), owner, axis=0)


def _majority(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    bits = (2 * counts > totals[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def text_fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text; zero where there is no word."""
    out = np.zeros(len(texts), dtype=np.uint64)
    rows: list[int] = []
    parts: list[np.ndarray] = []

    def flush() -> None:
        if rows:
            bounds = np.concatenate(([0], np.cumsum([len(part) for part in parts])))
            out[rows] = _majority(bit_counts(np.concatenate(parts), bounds), np.diff(bounds))
            rows.clear()
            parts.clear()

    held = 0
    for i, text in enumerate(texts):
        words = (text.as_py() or "").encode().lower().split()
        if not words:
            continue
        found = shingle_hashes(words)
        if len(words) > SHINGLES_AT_ONCE:
            counts, total = np.zeros(BITS, dtype=np.int64), 0
            for part in found:
                counts += bit_counts(part, np.array([0, len(part)]))[0]
                total += len(part)
            out[i] = _majority(counts[None, :], np.array([total]))[0]
            continue
        rows.append(i)
        parts.append(np.concatenate(list(found)))
        held += len(parts[-1])
        if held > SHINGLES_AT_ONCE:
            flush()
            held = 0
    flush()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text_key` and the `fingerprint` of each row as a long."""
    narrow = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    fields = [field for field in narrow.schema.fields if field.name != "text"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = long_array(text_fingerprints(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), values], ["doc_id", "text_key", "fingerprint"])

    return narrow.mapInArrow(add, StructType([*fields, StructField("fingerprint", LongType())]))


def _free_flips(mask: int) -> Column:
    free = [0, *(_signed(1 << bit) for bit in range(BITS) if not mask >> bit & 1)]
    return F.array(*[F.lit(flip).cast("long") for flip in free])


def links(values: DataFrame) -> DataFrame:
    """Edges (`a`, `b`), b < a, that connect what is connected by steps of at most two bits.

    `values` has distinct longs in `fingerprint`.
    """
    tables = F.explode(
        F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask)).cast("long")).alias("key")) for i, mask in enumerate(masks())])
    )
    hashed = values.select("fingerprint", tables.alias("table")).select("fingerprint", "table.*")
    shared = hashed.groupBy("mask", "key").agg(F.count("*").alias("members")).filter("members > 1").drop("members")
    meeting = hashed.join(shared, ["mask", "key"], "left_semi")
    flips = F.element_at(F.array(*[_free_flips(mask) for mask in masks()]), F.col("mask") + 1)
    listed = meeting.select("mask", "fingerprint", F.explode(flips).alias("flip"))
    listed = listed.select("mask", "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("listing"))
    # At most one member per free bit and one for itself.
    groups = listed.groupBy("mask", "listing").agg(F.collect_list("fingerprint").alias("members")).filter(F.size("members") > 1)
    edges = groups.select(F.explode("members").alias("a"), F.array_min("members").alias("b"))
    return edges.filter("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`node` and the smallest node it is connected to, `root`, for all nodes of the edges.

    Alternates two steps until nothing changes: every node links its larger
    neighbours to its smallest one, then its smaller ones. Each round is written
    to the shared folder, and the number of rounds grows with the logarithm of
    the longest path.
    """

    def starred(pairs: DataFrame) -> DataFrame:
        """Edges (node, other) with the least of all others and the node itself."""
        least = pairs.groupBy("node").agg(F.min("other").alias("least"))
        return pairs.join(least, "node").withColumn("least", F.least("least", "node"))

    now, before = stage(edges.select("a", "b"), "links"), None
    while True:
        facts = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if facts == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = facts
        both = now.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))))
        large = starred(both).filter("other > node").select(F.col("other").alias("node"), F.col("least").alias("other")).distinct()
        small = starred(large).select(F.inline(F.array(F.struct(F.col("other").alias("a"), F.col("least").alias("b")), F.struct(F.col("node").alias("a"), F.col("least").alias("b")))))
        now = stage(small.filter("a > b").distinct(), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Every row's `doc_id`, `text_key`, `fingerprint`, `group` and `component_id`.

    Texts are taken whole, A-Z in lower case, in shingles of three words. Rows
    link at two or fewer differing bits; `group` is the least fingerprint that is
    reached, `component_id` the least doc_id. Null and empty texts have the
    fingerprint zero and link like any other. A null doc_id is never the least
    unless the group has no other; a repeated row appears as often as it is there.
    Other columns are not read, whatever their names. An empty table gives none.
    """
    ready(docs.sparkSession)
    rows = stage(fingerprints(docs), "fingerprints")
    values = stage(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "values")
    roots = components(links(values.select("fingerprint")))
    grouped = values.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("group"))
    grouped = stage(grouped, "groups")
    firsts = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    named = grouped.select("fingerprint", "group").join(firsts, "group")
    return rows.join(named, "fingerprint").select("doc_id", "text_key", "fingerprint", "group", "component_id")


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without all but one of each group; the row of the least doc_id stays.

    Ties go to the smaller text key; of rows equal in id and text one stays.
    """
    found = near_duplicates(docs)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    stays = found.groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.text_key").alias("_key"))
    whole = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_text"))
    kept = whole.join(stays.distinct(), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi")
    return kept.dropDuplicates(["_doc", "_text"]).select("_row.*")
