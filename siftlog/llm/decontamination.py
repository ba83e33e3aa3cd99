"""Benchmark decontamination: shared word pairs find passages, alignment scores them.

Words are compared in plain form (ASCII letters in lower case, other ASCII signs
part words). An alignment of score S has S - 1 or more pairs of neighbouring words
in common: M matches and E differences lie in at most E + 1 runs, which hold
M - E - 1 pairs. So of all pairs of an item but S - 1 - K, whichever they are, K
are among them. Those are the seeds of the item, the rarest ones in the documents
for speed. They are looked for in all documents through a bit field of fixed size
and an exact join. The diagonals (place in the document less place in the item) of
an alignment differ by at most its gaps, so it lies in two neighbouring blocks of
diagonals. Smith-Waterman alignment scores all two blocks that have K seeds: none
that reaches the least score is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from siftlog.llm.common import chunks, long_array, mix, ready, rolled, text_key
from siftlog.session import stage

SEED_WORDS = 2
# Items of fewer words hold nothing.
LEAST_WORDS = 4
# Size of the bit field: 2 MB, whatever the size of the benchmark.
FIELD_BITS = 24
# Seeds that propose a passage, where an alignment must have so many: K above.
ENOUGH_SEEDS = 3
MATCH, MISMATCH, GAP = 1, -1, -1
# Least score as a share of the words of the item, which is the score of an exact copy.
LEAST_SCORE = 0.5
# Cells of alignment matrices that are held at once.
CELLS = 1 << 20


def _word_lists(batch_column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for chunk in chunks(batch_column, plain=True):
        hashes, bounds = chunk.word_hashes(), chunk.word_bounds()
        for i in range(chunk.rows):
            yield chunk.first + i, hashes[bounds[i] : bounds[i + 1]]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(part) for part in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), long_array(flat))


def item_words(benchmark: DataFrame) -> DataFrame:
    """`item_id`, `item_key` and `item`: the word hashes of each distinct item that is long enough."""
    narrow = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), _lists([words for _, words in _word_lists(batch.column("text"))])], ["item_id", "item"])

    read_items = narrow.mapInArrow(read, StructType([narrow.schema["item_id"], StructField("item", ArrayType(LongType()))]))
    return read_items.filter(F.size("item") >= LEAST_WORDS).distinct().select("item_id", F.xxhash64("item").alias("item_key"), "item")


def seeds_of(items: DataFrame) -> DataFrame:
    """`seed`, `item_id`, `item_key`, `place` and the number of words of its item `length`: all word pairs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(words, dtype=np.int64).view(np.uint64) for words in batch.column("item").to_pylist()]
            lengths = np.array([len(words) for words in lists], dtype=np.int64)
            counts = np.maximum(lengths - SEED_WORDS + 1, 0)
            row = np.repeat(np.arange(len(lists)), counts)
            found = np.concatenate([rolled(words, SEED_WORDS) for words in lists]) if lists else np.zeros(0, np.uint64)
            place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            keys = [batch.column(name).take(pa.array(row, pa.int64())) for name in ("item_id", "item_key")]
            yield pa.RecordBatch.from_arrays([long_array(found), *keys, long_array(place), long_array(lengths[row])], ["seed", "item_id", "item_key", "place", "length"])

    kinds = [StructField("seed", LongType()), items.schema["item_id"], items.schema["item_key"], StructField("place", LongType()), StructField("length", LongType())]
    return items.mapInArrow(cut, StructType(kinds))


def _probes(seeds: np.ndarray) -> list[np.ndarray]:
    """Two places of the bit field for each seed."""
    again = mix(seeds + np.uint64(1))
    return [(value >> np.uint64(64 - FIELD_BITS)).astype(np.int64) for value in (seeds, again)]


def bit_field(seeds: DataFrame) -> np.ndarray:
    """Bytes of the bit field that has every seed; only bytes with a bit set come to the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.unique(np.concatenate(_probes(batch.column("seed").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([long_array(places >> 3), long_array(1 << (places & 7))], ["slot", "bit"])

    found = seeds.select("seed").mapInArrow(bits, "slot long, bit long").groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(1 << (FIELD_BITS - 3), dtype=np.uint8)
    field[found["slot"].to_numpy()] = found["bits"].to_numpy()
    return field


def _seen(texts: pa.Array, bits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows at a time: the first row; row, place and value of what may be a seed."""
    for chunk in chunks(texts, plain=True):
        found = rolled(chunk.word_hashes(), SEED_WORDS)
        hit = chunk.row[: len(found)] == chunk.row[SEED_WORDS - 1 :]
        for probe in _probes(found):
            hit &= (bits[probe >> 3] >> (probe & 7).astype(np.uint8) & 1).astype(bool)
        at = np.flatnonzero(hit)
        owner = chunk.row[at]
        yield chunk.first, owner, at - chunk.word_bounds()[owner], found[at]


def seed_counts(docs: DataFrame, field: np.ndarray) -> DataFrame:
    """`seed` and how many `hits` it has in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [found for *_, found in _seen(batch.column("text"), shared.value)]
            values, hits = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([long_array(values), long_array(hits)], ["seed", "hits"])

    return docs.select("text").mapInArrow(count, "seed long, hits long").groupBy("seed").agg(F.sum("hits").alias("hits"))


def seed_places(docs: DataFrame, field: np.ndarray) -> DataFrame:
    """`doc_id`, `text_key`, `seed` and its place `at` in the document, for all that may be seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    narrow = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, owner, at, found in _seen(batch.column("text"), shared.value):
                keys = [batch.column(name).take(pa.array(first + owner, pa.int64())) for name in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*keys, long_array(found), long_array(at)], ["doc_id", "text_key", "seed", "at"])

    return narrow.mapInArrow(scan, StructType([narrow.schema["doc_id"], narrow.schema["text_key"], StructField("seed", LongType()), StructField("at", LongType())]))


def windows(docs: DataFrame, spots: DataFrame) -> DataFrame:
    """`doc_id`, `text_key`, `item_id`, `item_key` and the `window` of word hashes of each spot (`begin`, `end`) of a document."""
    wanted = spots.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text"), "spots")
    narrow = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    joined = narrow.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_text"))).select("doc_id", "text_key", "text", "spots")
    kinds = {field.name: field for field in joined.schema["spots"].dataType.elementType.fields}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, held = batch.column("spots").offsets.to_numpy(), batch.column("spots").values
            begins, ends = held.field("begin").to_numpy(), held.field("end").to_numpy()
            for chunk in chunks(batch.column("text"), plain=True):
                hashes, bounds = chunk.word_hashes(), chunk.word_bounds()
                a, b = int(offsets[chunk.first]), int(offsets[chunk.first + chunk.rows])
                row = np.repeat(np.arange(chunk.rows), np.diff(offsets[chunk.first : chunk.first + chunk.rows + 1]))
                low, high = bounds[row] + begins[a:b], np.minimum(bounds[row] + ends[a:b], bounds[row + 1])
                keys = [batch.column(name).take(pa.array(chunk.first + row, pa.int64())) for name in ("doc_id", "text_key")]
                items = [held.field(name).slice(a, b - a) for name in ("item_id", "item_key")]
                yield pa.RecordBatch.from_arrays([*keys, *items, _lists([hashes[i:j] for i, j in zip(low, high)])], ["doc_id", "text_key", "item_id", "item_key", "window"])

    fields = [narrow.schema["doc_id"], narrow.schema["text_key"], kinds["item_id"], kinds["item_key"], StructField("window", ArrayType(LongType()))]
    return joined.mapInArrow(cut, StructType(fields))


def align(windows: list[np.ndarray], items: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman scores of pairs of word lists, many at once; a row of all matrices in one go."""
    scores = np.zeros(len(items), dtype=np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(windows[i])))
    first = 0
    while first < len(order):
        last, wide = first, 0
        while last < len(order) and (last == first or max(wide, len(windows[order[last]])) * (last - first + 1) <= CELLS):
            wide = max(wide, len(windows[order[last]]))
            last += 1
        part = order[first:last]
        n, long = len(part), max(len(items[i]) for i in part)
        left = np.zeros((n, wide), dtype=np.uint64)
        used = np.zeros((n, wide), dtype=bool)
        for k, i in enumerate(part):
            left[k, : len(windows[i])] = windows[i]
            used[k, : len(windows[i])] = True
        slope = -GAP * np.arange(wide + 1, dtype=np.int32)
        row, best = np.zeros((n, wide + 1), dtype=np.int32), np.zeros(n, dtype=np.int32)
        lengths = np.array([len(items[i]) for i in part])
        for j in range(long):
            word = np.array([items[i][j] if j < len(items[i]) else 0 for i in part], dtype=np.uint64)
            same = (left == word[:, None]) & used & (j < lengths)[:, None]
            new = np.zeros_like(row)
            new[:, 1:] = np.maximum(row[:, :-1] + np.where(same, np.int32(MATCH), np.int32(MISMATCH)), row[:, 1:] + np.int32(GAP))
            np.maximum(new, 0, out=new)
            # A gap in the item: the best cell to the left, less its distance.
            row = np.maximum.accumulate(new + slope, axis=1) - slope
            best = np.maximum(best, row.max(axis=1))
        scores[part] = best
        first = last
    return scores


def contaminated(docs: DataFrame, benchmark: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """`doc_id`, `text_key`, `item_id`, `score` (0 to 1) and `n_words` of each document and item it holds.

    Whole texts are searched. `score` is the best local alignment, a word in common
    counting 1 and a difference -1, over the words of the item; `n_words` those
    words. All pairs that reach `least_score` are found, as long as it is two words
    or more of the item. Null or empty texts and items hold nothing, nor do items of
    fewer than four words; repeated rows of documents count as one, and items with equal
    words each get their pairs. Ties can't arise: there is one row per pair. Other
    columns are not read. Empty tables give none.
    """
    ready(docs.sparkSession)
    items = stage(item_words(benchmark), "items")
    pairs = stage(seeds_of(items), "pairs")
    counts = seed_counts(docs, bit_field(pairs))
    # Least score in words; pairs that an alignment has at least; how many of them propose a passage.
    least = F.ceil(F.col("length") * F.lit(least_score) - F.lit(1e-9))
    have = F.greatest(least - 1, F.lit(1))
    enough = F.least(have, F.lit(ENOUGH_SEEDS))
    rarest = Window.partitionBy("item_id", "item_key").orderBy(F.coalesce("hits", F.lit(0)), "place")
    ranked = pairs.join(counts, "seed", "left").select(*pairs.columns, F.row_number().over(rarest).alias("rank"), enough.alias("enough"), (F.col("length") - least + 1).alias("width"))
    seeds = stage(ranked.filter(F.col("rank") <= F.col("length") - 1 - have + F.col("enough")).drop("rank"), "seeds")
    hits = seed_places(docs, bit_field(seeds))
    block = F.floor((F.col("at") - F.col("place")) / F.col("width"))
    meeting = hits.join(seeds, "seed").withColumn("block", F.explode(F.array(block - 1, block)))
    keys = ("doc_id", "text_key", "item_id", "item_key", "length", "width", "enough", "block")
    proposed = meeting.groupBy(*keys).agg(F.count_distinct("place").alias("n")).filter(F.col("n") >= F.col("enough"))
    begin = F.greatest(F.col("block") * F.col("width"), F.lit(0)).alias("begin")
    end = ((F.col("block") + 2) * F.col("width") + F.col("length")).alias("end")
    spots = proposed.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "item_key", begin, end)).alias("spots"))
    found = windows(docs, stage(spots, "spots"))
    ready_pairs = found.join(items, ["item_id", "item_key"]).select("doc_id", "text_key", "item_id", "window", "item")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(column: pa.Array) -> list[np.ndarray]:
            flat, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
            return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]

        for batch in batches:
            items = lists(batch.column("item"))
            scores = align(lists(batch.column("window")), items)
            lengths = np.array([len(words) for words in items], dtype=np.int64)
            keys = [batch.column(name) for name in ("doc_id", "text_key", "item_id")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(scores / (MATCH * np.maximum(lengths, 1))), pa.array(lengths)], ["doc_id", "text_key", "item_id", "score", "n_words"])

    kinds = StructType([*(ready_pairs.schema[name] for name in ("doc_id", "text_key", "item_id")), *StructType.fromDDL("score double, n_words long").fields])
    rated = ready_pairs.mapInArrow(rate, kinds).filter(F.col("score") >= least_score)
    return rated.groupBy("doc_id", "text_key", "item_id").agg(F.max("score").alias("score"), F.max("n_words").alias("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no test item, all columns as they are."""
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    whole = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_text"))
    return whole.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_key")), "left_anti").select("_row.*")
