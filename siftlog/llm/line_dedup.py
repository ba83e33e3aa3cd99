"""Repeated passages of lines, found by overlapping windows of three lines.

The lines with a word are numbered within their document, and each three
consecutive ones are hashed. A window that occurs before, in the order of doc_id,
text and position over all documents, covers its three lines; covered lines of
overlapping windows merge, and go.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siftlog.llm.common import ready, text_key
from siftlog.session import stage

WINDOW = 3


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """One row per window: two hashes of its trimmed lines, its document and place."""
    lines = F.filter(F.transform(split_lines(F.col("text")), lambda line: F.regexp_replace(line, "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")), lambda line: line != "")
    numbered = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), lines.alias("lines")).filter(F.size("lines") >= WINDOW)

    def hashed(i: Column) -> Column:
        parts = [F.col("lines")[i + k] for k in range(WINDOW)]
        return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(*parts[::-1], F.lit(1)).alias("h2"), i.alias("place"))

    found = F.transform(F.sequence(F.lit(0), F.size("lines") - WINDOW), hashed)
    return numbered.select("doc_id", "text_key", F.explode(found).alias("window")).select("window.*", "doc_id", "text_key")


def later_windows(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text_key` and the sorted `places` of windows that occurred before."""
    found = stage(windows(docs), "windows")
    # The place of an occurrence in the order of all; null ids come last.
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "place")
    firsts = found.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.select("h1", "h2", "first")
    later = found.withColumn("at", at).join(firsts, ["h1", "h2"]).filter(F.col("at") != F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("place")).alias("places"))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("removed", LongType())]))
def without_lines(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
    """The text without the lines that windows at these places cover; null where nothing goes."""

    def shorten(text: str | None, found) -> tuple[str | None, int]:
        if text is None or found is None or not len(found):
            return None, 0
        covered = {int(place) + k for place in found for k in range(WINDOW)}
        kept, number, lines = [], -1, text.split("\n")
        for line in lines:
            has_word = bool(line.strip(" \t\n\v\f\r"))
            number += has_word
            if not (has_word and number in covered):
                kept.append(line)
        return "\n".join(kept), len(lines) - len(kept)

    return pd.DataFrame([shorten(text, found) for text, found in zip(texts, places)], columns=["text", "removed"])


def counts_name(docs: DataFrame) -> str:
    """The name of the column that `dedup_lines` adds: `_lines`, with more underscores if `docs` has that."""
    name = "_lines"
    while name.lower() in [own.lower() for own in docs.columns]:
        name = f"_{name}"
    return name


def dedup_lines(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`; `text` without its repeated lines, and the numbers
    of lines `before` and `removed` in a struct named by `counts_name`.

    Lines end at \\n; white space around a line doesn't count, lines without a word
    are never removed and don't part neighbours. Documents of fewer than three
    such lines have no window and stay as they are. The first occurrence stays:
    the least doc_id (null last), then text key, then place. Rows equal in id and
    text are one document stored twice and stay alike. A null text stays null;
    an empty table gives an empty one.
    """
    ready(docs.sparkSession)
    later = later_windows(docs).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "places")
    whole = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), text_key(F.col("text")).alias("_text_key"))
    joined = whole.join(later, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left")
    shorter = without_lines(F.when(F.col("places").isNotNull(), F.col("_row.text")), F.col("places"))
    out = joined.select("_row", shorter.alias("_shorter"))
    before = F.when(F.col("_row.text").isNull(), 0).otherwise(F.size(split_lines(F.col("_row.text"))))
    lines = F.struct(before.cast("long").alias("before"), F.coalesce("_shorter.removed", F.lit(0)).cast("long").alias("removed"))
    text = F.coalesce("_shorter.text", F.col("_row.text"))
    values = [(text if name == "text" else F.col("_row")[name]).alias(name) for name in docs.columns]
    return out.select(*values, lines.alias(counts_name(docs)))


def with_char_counts(docs: DataFrame) -> DataFrame:
    """`docs` with `n_chars`, if there is such a column, as the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
