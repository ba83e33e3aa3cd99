"""Profile of a JSONL source before it is loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.session import stage
from siftlog.sources.jsonl import REQUIRED_FIELDS, STRICT, resolve_source

ABSENT = "MISSING"


def read_lines(spark: SparkSession, path: str | None = None) -> DataFrame:
    return spark.read.text(resolve_source(path))


def _field(name: str) -> Column:
    """The value of a key; an absent key counts as `MISSING`, a null one as null."""
    return F.when(F.map_contains_key("record", name), F.element_at("record", name)).otherwise(ABSENT)


def tally(lines: DataFrame) -> DataFrame:
    """Lines counted by what the reports ask for: validity, component, type, absent fields.

    One scan, one parse per line; every report reads the small result.
    """
    not_blank = lines.filter(F.col("value").rlike(r"(?U)[^\s\x1c-\x1f]"))
    whole = F.col("value").rlike(r"(?s)^\s*\{.*\}\s*$")
    parsed = not_blank.select(F.when(whole, F.from_json("value", "map<string,string>", STRICT)).alias("record"))
    required = F.array(*[F.lit(name) for name in REQUIRED_FIELDS])
    counted = (
        parsed.select(
            F.col("record").isNotNull().alias("valid"),
            _field("component").alias("component"),
            _field("parsed_message_type").alias("parsed_message_type"),
            F.array_except(required, F.map_keys("record")).alias("absent"),
        )
        .groupBy("valid", "component", "parsed_message_type", "absent")
        .agg(F.count("*").alias("lines"))
    )
    return stage(counted, "tally")


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("lines"))), F.lit(0))


def line_counts(tallied: DataFrame) -> DataFrame:
    """Records, lines that are not records, and distinct components."""
    component = F.when(F.col("valid"), F.struct("component"))
    return tallied.agg(
        _total(F.col("valid")).alias("records"),
        _total(~F.col("valid")).alias("invalid_lines"),
        F.count_distinct(component).alias("components"),
    )


def top_values(tallied: DataFrame, field: str, limit: int = 10) -> DataFrame:
    """The most frequent values of `component` or `parsed_message_type`."""
    counted = tallied.filter("valid").groupBy(F.col(field).alias("value")).agg(F.sum("lines").alias("records"))
    return counted.orderBy(F.desc("records"), "value").limit(limit)


def absent_fields(tallied: DataFrame) -> DataFrame:
    """Per required field, the number of records without its key, where there are any."""
    absent = tallied.filter("valid").select(F.explode("absent").alias("field"), "lines")
    return absent.groupBy("field").agg(F.sum("lines").alias("records"))
