"""Quality rules: a likelihood ratio of hashed n-grams between trusted documents and the whole corpus.

Words and pairs of neighbouring words are hashed to a fixed number of buckets. One
pass counts them over all documents and over the trusted ones; a second one gives
every document the mean of log(trusted / corpus) over its n-grams and holds it
against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from siftlog.llm.common import Chunk, chunks, hash_ranges, long_array, ready, rolled, text_key

BUCKETS = 1 << 14
# Trusted rows that are used, expected; chosen by the hash of their id.
TRUSTED_ROWS = 50_000
# A document stays from this mean log ratio on.
LEAST_RATIO = -0.12
# Weight of the corpus in the trusted distribution, in n-grams for each bucket.
PRIOR = 1.0
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def ngram_buckets(chunk: Chunk, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word, then of each pair of words of a row."""
    pairs = rolled(hashes, 2)
    inside = chunk.row[: len(pairs)] == chunk.row[len(chunk.row) - len(pairs) :]
    found = np.concatenate((hashes, pairs[inside])) % np.uint64(BUCKETS)
    return found.astype(np.int64), np.concatenate((chunk.row, chunk.row[: len(pairs)][inside]))


def trusted_ids(labels: DataFrame, most: int = TRUSTED_ROWS) -> DataFrame:
    """Ids of documents whose labels all say good and not toxic; about `most` at the most."""
    good = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good = good.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
    share = min(1.0, most / max(good.count(), 1))
    return good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))


def corpus_counts(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in the corpus, and in the trusted documents.

    Every task counts what it reads, a row per bucket; two numbers per bucket
    come to the driver.
    """
    # At most about TRUSTED_ROWS ids.
    trusted = F.broadcast(trusted_ids(labels).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good")))
    rows = docs.select("doc_id", "text").join(trusted, F.col("doc_id") == F.col("_id"), "left")
    rows = rows.select("text", F.col("_good").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for chunk in chunks(batch.column("text")):
                found, row = ngram_buckets(chunk, chunk.word_hashes())
                counts[0] += np.bincount(found, minlength=BUCKETS)
                counts[1] += np.bincount(found[good[chunk.first + row]], minlength=BUCKETS)
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([long_array(seen), long_array(counts[0][seen]), long_array(counts[1][seen])], ["bucket", "corpus", "trusted"])

    counted = rows.mapInArrow(count, "bucket long, corpus long, trusted long").groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted"))
    found = counted.toArrow()
    corpus, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    places = found["bucket"].to_numpy()
    corpus[places], good[places] = found["corpus"].to_numpy(), found["trusted"].to_numpy()
    return corpus, good


def log_ratios(corpus: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """log(trusted / corpus) for each bucket; zeros where there is nothing to learn from."""
    if not corpus.sum() or not trusted.sum():
        return np.zeros(BUCKETS)
    share = (corpus + 0.5) / (corpus.sum() + 0.5 * BUCKETS)
    prior = PRIOR * BUCKETS
    good = (trusted + prior * share) / (trusted.sum() + prior)
    return np.log(good / share)


def _repeats(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries share row and hash with another one; and which with an earlier one."""
    order = np.lexsort((hashes, rows))
    same = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    any_, later = np.zeros(len(rows), dtype=bool), np.zeros(len(rows), dtype=bool)
    any_[order[1:]] |= same
    any_[order[:-1]] |= same
    later[order[1:]] = same
    return np.stack((any_, later))


def features(chunk: Chunk, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of FEATURES for each row of a chunk."""
    n, bounds = chunk.rows, chunk.word_bounds()
    in_word = np.zeros(len(chunk.data) + 1, dtype=np.int8)
    in_word[chunk.starts] += 1
    in_word[chunk.ends] -= 1
    # A word may begin where the last one of the row before ends.
    inside = np.cumsum(in_word[:-1], dtype=np.int8).astype(bool)
    first_bytes = (chunk.data & 0xC0) != 0x80
    out = {"n_words": np.diff(bounds), "word_chars": chunk.per_row(inside & first_bytes), "n_symbols": chunk.per_row(_SYMBOL[chunk.data])}

    breaks = np.flatnonzero(chunk.data == 10)
    begins = np.sort(np.concatenate((chunk.bounds[:-1], breaks + 1)), kind="stable")
    row = np.concatenate((np.arange(n), np.searchsorted(chunk.bounds, breaks, "right") - 1))
    row = row[np.argsort(np.concatenate((chunk.bounds[:-1], breaks + 1)), kind="stable")]
    order = np.lexsort((begins, row))
    begins, row = begins[order], row[order]
    stops = np.concatenate((begins[1:] - 1, [len(chunk.data)]))
    last = np.concatenate((row[1:] != row[:-1], [True]))
    stops[last] = chunk.bounds[row[last] + 1]
    with_word = np.searchsorted(chunk.starts, begins) < np.searchsorted(chunk.starts, stops)
    begins, stops, row = begins[with_word], stops[with_word], row[with_word]
    out["n_dup_lines"] = np.bincount(row[_repeats(row, hash_ranges(chunk.data, begins, stops))[1]], minlength=n)

    windows = rolled(hashes, REPEAT_WINDOW)
    whole = chunk.row[: len(windows)] == chunk.row[len(chunk.row) - len(windows) :]
    places = np.flatnonzero(whole)
    places = places[_repeats(chunk.row[places], windows[places])[0]]
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(chunk.row[covered], minlength=n)
    return out


def score(docs: DataFrame, labels: DataFrame, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """`doc_id`, `text_key`, the counts of FEATURES, `base_failed`, `ratio` and `kept` of every row.

    Corpus counts are taken over all of `docs`. `base_failed`: fewer than MIN_WORDS
    words, or more than MAX_REPEAT_PERCENT of them in repeated windows. `ratio` is
    the mean log ratio of the row's n-grams, 0 without words; `kept` needs
    `least_ratio` and that the base rules hold. A null or empty text has no words
    and fails the base rules; repeated rows get equal results; without a trusted
    document every ratio is 0. Labels that contradict each other don't count as
    trust. An empty table gives none. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    weights = spark.sparkContext.broadcast(log_ratios(*corpus_counts(docs, labels)))
    narrow = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
    names = [*FEATURES, "base_failed", "ratio", "kept"]
    kinds = [*(LongType() for _ in FEATURES), BooleanType(), DoubleType(), BooleanType()]
    fields = [field for field in narrow.schema.fields if field.name != "text"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                hashes = chunk.word_hashes()
                found, row = ngram_buckets(chunk, hashes)
                counted = features(chunk, hashes)
                total = np.bincount(row, weights.value[found], minlength=chunk.rows)
                ratio = np.round(total / np.maximum(np.bincount(row, minlength=chunk.rows), 1), 9)
                words, repeats = counted["n_words"], counted["n_repeat_words"]
                failed = (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)
                kept = ~failed & (ratio >= least_ratio)
                keys = [batch.column(name).slice(chunk.first, chunk.rows) for name in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*keys, *(long_array(counted[name]) for name in FEATURES), pa.array(failed), pa.array(ratio), pa.array(kept)], ["doc_id", "text_key", *names])

    return narrow.mapInArrow(rate, StructType([*fields, *map(StructField, names, kinds)]))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, all columns as they are."""
    rated = score(docs, labels).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    whole = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_text"))
    return whole.join(rated, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left_semi").select("_row.*")
