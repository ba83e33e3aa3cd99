"""Log records: the JSONL scan, its checks, canonical columns and the sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlog.functions.text import time_text
from siftlog.session import prepare, spread

# The fields a record needs, and where records come from by default.
REQUIRED_FIELDS = ("event_id", "normalized_timestamp", "component", "message", "parsed_message_type")
SOURCE_SETTING = "LOG_FILE"
DEFAULT_SOURCE = "data/processed_logs.jsonl"

OPTIONAL_FIELDS = {
    "timestamp": T.StringType(),
    "ingestion_timestamp": T.StringType(),
    "process_id": T.StringType(),
    # An object arrives as its JSON text, without spaces between tokens and in the order of its keys.
    "extracted_metrics": T.StringType(),
    "source": T.StringType(),
    "line_number": T.LongType(),
    "raw_message": T.StringType(),
    "quality_flags": T.VariantType(),
    "metadata": T.VariantType(),
}
CORRUPT = "_corrupt_record"
# The keys of a record that are none of the above, with their values.
OTHERS = "other_fields"
# Text in single quotes is no JSON.
STRICT = {"allowSingleQuotes": "false"}


def record_schema(corrupt: bool = False) -> T.StructType:
    """The fields of a record, all nullable."""
    schema = T.StructType()
    for name in REQUIRED_FIELDS:
        schema.add(name, T.StringType())
    for name, kind in OPTIONAL_FIELDS.items():
        schema.add(name, kind)
    return schema.add(CORRUPT, T.StringType()) if corrupt else schema


def resolve_source(path: str | None = None) -> str:
    """The given path, else the configured one, else the default."""
    return path or os.environ.get(SOURCE_SETTING) or DEFAULT_SOURCE


def read_lines(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The lines of a file, folder or glob as `value`; blank ones are skipped."""
    return spark.read.text(resolve_source(path)).filter(F.col("value").rlike(r"\S"))


def parse_lines(lines: DataFrame, tolerant: bool = False) -> DataFrame:
    """One record per line: the known fields, and every other key in the map `other_fields`.

    A bad line fails the job. The tolerant form keeps it as text in
    `_corrupt_record` instead. The map is parsed only where it is used.
    """
    options = {"mode": "PERMISSIVE" if tolerant else "FAILFAST", **STRICT}
    if tolerant:
        options["columnNameOfCorruptRecord"] = CORRUPT
    schema = record_schema(corrupt=tolerant)
    known = [field.name for field in schema.fields]
    keys = F.from_json("value", "map<string,variant>", {"mode": "PERMISSIVE", **STRICT})
    others = F.map_filter(keys, lambda key, _: ~key.isin(*known))
    parsed = lines.select(F.from_json("value", schema, options).alias("_record"), others.alias(OTHERS))
    return parsed.select("_record.*", OTHERS)


def scan_jsonl(spark: SparkSession, path: str | None = None, tolerant: bool = False) -> DataFrame:
    """Read and parse a file, folder or glob of JSON lines."""
    return parse_lines(read_lines(spark, path), tolerant)


def field_counts(lines: DataFrame) -> DataFrame:
    """Per required field, the number of lines whose record has the key, null or not; one aggregation."""
    keys = F.json_object_keys("value")
    counts = lines.agg(*[F.count_if(F.array_contains(keys, field)).alias(field) for field in REQUIRED_FIELDS])
    pairs = [F.struct(F.lit(field).alias("field"), F.col(field).alias("records")) for field in REQUIRED_FIELDS]
    return counts.select(F.inline(F.array(*pairs)))


def present_fields(spark: SparkSession, path: str | None = None) -> set[str]:
    """The required keys that occur in at least one record."""
    return {row.field for row in field_counts(read_lines(spark, path)).filter("records > 0").collect()}


def missing_fields(names: set[str] | list[str]) -> list[str]:
    """Required fields that are not among `names`."""
    return [field for field in REQUIRED_FIELDS if field not in names]


def emptiness(df: DataFrame, source: str) -> DataFrame:
    """One row: the name of a source and whether it holds no row; reads one row at most."""
    return df.limit(1).agg(F.lit(source).alias("source"), (F.count("*") == 0).alias("is_empty"))


def check_not_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the log source holds no records")
    return df


def check_required(names: set[str] | list[str]) -> None:
    missing = missing_fields(names)
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def parse_time(text: F.Column) -> F.Column:
    """An instant from ISO-8601 text; null where it cannot be read."""
    return F.try_to_timestamp(text)


def canonical(df: DataFrame) -> DataFrame:
    """Typed times, and text columns without nulls."""
    kind = df.schema["normalized_timestamp"].dataType
    time = F.col("normalized_timestamp")
    return df.withColumns(
        {
            "event_id": F.col("event_id").cast("string"),
            "normalized_timestamp": parse_time(time) if isinstance(kind, T.StringType) else time.cast("timestamp"),
            "message": F.coalesce(F.col("message").cast("string"), F.lit("")),
            "component": F.coalesce(F.col("component").cast("string"), F.lit("unknown")),
            "parsed_message_type": F.coalesce(F.col("parsed_message_type").cast("string"), F.lit("unknown")),
        }
    )


def in_time_order(df: DataFrame) -> DataFrame:
    """Sorted for output: by time, nulls last, then by id."""
    return df.orderBy(F.asc_nulls_last("normalized_timestamp"), "event_id")


def load_logs(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Scan, check and type the log records of a source.

    Rows come in no order; sort with `in_time_order` where a report needs it.
    """
    source = resolve_source(path)
    records = check_not_empty(scan_jsonl(prepare(spark), source))
    check_required(present_fields(spark, source))
    return canonical(spread(records))


def logs_from_table(df: DataFrame) -> DataFrame:
    """The same checks and types for records that are a table already."""
    check_required(df.columns)
    return canonical(check_not_empty(df))


def export_records(df: DataFrame) -> DataFrame:
    """Times as text, ready for JSON."""
    times = [field.name for field in df.schema.fields if isinstance(field.dataType, T.TimestampType)]
    return df.withColumns({name: time_text(F.col(name)) for name in times})


def write_jsonl(df: DataFrame, path: str) -> None:
    export_records(df).write.json(path)


def write_table(df: DataFrame, path: str, by_day: bool = True) -> None:
    """Write Parquet, one folder per day, so that time filters skip whole days.

    The rebalance splits a day too large for one file and joins small ones.
    """
    if not by_day:
        df.write.parquet(path)
        return
    daily = df.withColumn("log_date", F.to_date("normalized_timestamp"))
    daily.hint("rebalance", "log_date").write.partitionBy("log_date").parquet(path)
