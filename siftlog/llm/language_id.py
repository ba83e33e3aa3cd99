"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probabilities form one matrix, a row per bucket and a column per language,
that is broadcast; texts are scored in batches, as sums of the rows their n-grams
point to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from siftlog.llm.common import long_array, mix, ready, text_key

BUCKETS, LONGEST = 1 << 16, 3
# Labelled rows for each language that the model learns from, expected; chosen by the hash of id and text.
ROWS_PER_LANGUAGE = 5_000
# More would make a matrix of over 130 MB.
MOST_LANGUAGES = 500
SMOOTHING = 0.1
UNKNOWN = "und"
HELD_OUT = 2
# Characters that are worked on at once.
PIECE = 1 << 18
_tables: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: its id's remainder is HELD_OUT. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == HELD_OUT


def letters() -> np.ndarray:
    """The lower-case letter of each code point; a space for all that isn't a letter."""
    if not _tables:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for code in range(0x110000):
            char = chr(code)
            if char.isalpha():
                lower = char.lower()
                table[code] = ord(lower) if len(lower) == 1 else code
        _tables.append(table)
    return _tables[0]


def pieces(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """Codes of the letters of a text, each run of other characters as one space, and how many the piece before had too."""
    rest, shared = np.array([32], dtype=np.uint32), 0
    for first in range(0, len(text), PIECE):
        codes = letters()[np.frombuffer(text[first : first + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)]
        codes = np.concatenate((rest, codes))
        gap = codes == 32
        gap[0] = False
        gap[1:] &= codes[:-1] == 32
        codes = codes[~gap]
        yield codes, shared
        rest = codes[-(LONGEST - 1) :]
        shared = len(rest)


def gram_buckets(codes: np.ndarray, shared: int = 0) -> np.ndarray:
    """Buckets of the n-grams of 1 to LONGEST characters that end after the shared ones; single spaces are left out."""
    wide = codes.astype(np.uint64)
    single = wide[shared:]
    found, grams = [mix(single[single != 32] + np.uint64(1 << 60)) & np.uint64(BUCKETS - 1)], wide
    for n in range(2, LONGEST + 1):
        grams = (grams[:-1] << np.uint64(21)) | wide[n - 1 :]
        found.append(mix(grams[max(shared - n + 1, 0) :] + np.uint64(n << 60)) & np.uint64(BUCKETS - 1))
    return np.concatenate(found).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Languages in order, log-probabilities (bucket, language), log priors."""

    languages: list[str]
    weights: np.ndarray
    priors: np.ndarray


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from rows that are not held out and have text and language.

    Of each language about `rows_per_language` rows are used. Counts are made per
    task and added up in Spark; a number per language and bucket comes to the
    driver.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), "text", "doc_id").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    languages = sorted(sizes)
    place = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int") - 1
    share = F.array(*[F.lit(min(1.0, rows_per_language / sizes[name])) for name in languages])[place]
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = known.select(place.alias("place"), "text", share.alias("share"), draw.alias("draw")).filter("draw < share").select("place", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, text in zip(batch.column("place").to_pylist(), batch.column("text")):
                own = counts.setdefault(place, np.zeros(BUCKETS, dtype=np.int64))
                for codes, shared in pieces(text.as_py()):
                    own += np.bincount(gram_buckets(codes, shared), minlength=BUCKETS)
        for place, own in counts.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([long_array(np.full(len(seen), place)), long_array(seen), long_array(own[seen])], ["place", "bucket", "n"])

    found = sample.mapInArrow(count, "place long, bucket long, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS, len(languages)))
    counts[found["bucket"].to_numpy(), found["place"].to_numpy()] = found["n"].to_numpy()
    weights = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * BUCKETS))
    rows = np.array([sizes[name] for name in languages], dtype=float)
    return Model(languages, weights.astype(np.float32), np.log(rows / rows.sum()))


def text_scores(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each text and its posterior probability."""
    names, scores = [], np.zeros(len(texts))
    most = max(1, (1 << 22) // max(len(model.languages), 1))
    totals = np.zeros((len(texts), len(model.languages)))
    has_letter = np.zeros(len(texts), dtype=bool)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def flush() -> None:
        if held:
            buckets = np.concatenate(held)
            starts = np.concatenate(([0], np.cumsum([len(part) for part in held])[:-1]))
            np.add.at(totals, owners, np.add.reduceat(model.weights[buckets], starts, axis=0, dtype=np.float64))
            held.clear()
            owners.clear()

    size = 0
    for i, text in enumerate(texts):
        for codes, shared in pieces(text or ""):
            has_letter[i] |= bool((codes != 32).any())
            buckets = gram_buckets(codes, shared)
            for first in range(0, len(buckets), most):
                held.append(buckets[first : first + most])
                owners.append(i)
                size += len(held[-1])
                if size >= most:
                    flush()
                    size = 0
    flush()
    for i in range(len(texts)):
        if not has_letter[i] or not model.languages:
            names.append(UNKNOWN)
            continue
        total = totals[i] + model.priors
        best = int(np.argmax(total))
        names.append(model.languages[best])
        scores[i] = 1.0 / np.exp(total - total[best]).sum()
    return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `text_key`, `held_out`, `lang_pred` and `score` of every row.

    Whole texts are scored; language, source and id play no part. `und` with
    score 0 where the text is null or has no letter, or nothing was learnt. Ties
    go to the language that comes first by code point. Repeated rows get equal
    results, an empty table gives none. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    narrow = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), held_out(F.col("doc_id")).alias("held_out"), "text")
    keys = ["doc_id", "text_key", "held_out"]
    fields = [narrow.schema[name] for name in keys]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = text_scores(batch.column("text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keys), pa.array(names, pa.string()), pa.array(scores)], [*keys, "lang_pred", "score"])

    return narrow.mapInArrow(add, StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
