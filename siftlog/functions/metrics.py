"""Open-ended numeric metrics: discovery of their leaves, and flat columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_COLUMN = "extracted_metrics"
PREFIX = "metric_"


@dataclass(frozen=True)
class Leaf:
    """One value inside the metrics objects."""

    keys: tuple[str, ...]
    type: T.DataType

    @property
    def column(self) -> str:
        return PREFIX + ".".join(self.keys)

    @property
    def is_numeric(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_boolean(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    def value(self, metrics: Column) -> Column:
        """The leaf of a variant column: a double, or text for anything not numeric."""
        holder, path = metrics, "$"
        for key in self.keys:
            if _has_path(key):
                path += _step(key)
            else:
                holder, path = F.try_element_at(F.try_variant_get(holder, path, "map<string,variant>"), F.lit(key)), "$"
        if self.is_numeric:
            return F.try_variant_get(holder, path, "double")
        if self.is_boolean:
            return F.try_variant_get(holder, path, "boolean").cast("double")
        return F.try_variant_get(holder, path, "string")


def _has_path(key: str) -> bool:
    """No path can name a key that holds both kinds of quotes; it is looked up in a map."""
    return not ("'" in key and '"' in key)


def _step(key: str) -> str:
    return f"[\"{key}\"]" if "'" in key else f"['{key}']"


def metrics_text(df: DataFrame, column: str = METRICS_COLUMN) -> Column:
    """The metrics column as JSON text, whatever type it is kept in."""
    if column not in df.columns:
        return F.lit(None).cast("string")
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.col(column)
    return F.to_json(F.col(column))


def metrics_variant(df: DataFrame, column: str = METRICS_COLUMN) -> Column:
    """The metrics column as a variant; anything but an object counts as no metrics."""
    text = metrics_text(df, column)
    return F.when(F.json_object_keys(text).isNotNull(), F.try_parse_json(text))


def has_metric(text: Column) -> Column:
    """True for an object with at least one key."""
    return F.coalesce(F.size(F.json_object_keys(text)) > 0, F.lit(False))


def _leaves(fields: T.StructType, above: tuple[str, ...] = ()) -> list[Leaf]:
    found = []
    for field in fields.fields:
        keys = (*above, field.name)
        if isinstance(field.dataType, T.StructType):
            found.extend(_leaves(field.dataType, keys))
        else:
            found.append(Leaf(keys, field.dataType))
    return found


def discover_leaves(df: DataFrame, column: str = METRICS_COLUMN) -> list[Leaf]:
    """Every leaf of the metrics objects with its type over all rows, in one pass."""
    if column not in df.columns:
        return []
    merged = df.agg(F.schema_of_variant_agg(metrics_variant(df, column))).first()[0]
    if merged is None or not merged.startswith("OBJECT<"):
        return []
    # Objects are structs in a schema text; names in back quotes stay as they are.
    schema = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda part: "STRUCT<" if part[0] == "OBJECT<" else part[0], merged)
    return _leaves(T.DataType.fromDDL(schema))


def flatten_metrics(df: DataFrame, leaves: list[Leaf], column: str = METRICS_COLUMN) -> DataFrame:
    """Add one `metric_*` column per leaf."""
    if not leaves:
        return df
    # A column of its own, so that a record is parsed once for all its leaves.
    parsed = df.withColumn("_metrics", metrics_variant(df, column))
    return parsed.withColumns({leaf.column: leaf.value(F.col("_metrics")) for leaf in leaves}).drop("_metrics")


def _place(text: Column, leaf: Leaf) -> list[Column]:
    """The position of each key of a leaf inside its object."""
    places, holder = [], text
    for key in leaf.keys:
        places.append(F.array_position(F.json_object_keys(holder), key).cast("int"))
        if _has_path(key):
            holder = F.get_json_object(holder, "$" + _step(key))
        else:
            holder = F.try_element_at(F.from_json(holder, "map<string,string>"), F.lit(key))
    return places


def numeric_leaves(df: DataFrame, limit: int = 8, column: str = METRICS_COLUMN) -> list[Leaf]:
    """The first `limit` numeric leaves, in the order in which the records, by time, bring them.

    A leaf is numeric if all its values are; a boolean one also needs a value in
    every row. The order is the same for any number of leaves; within a record,
    top-level values come before nested ones. One pass after that of `discover_leaves`.
    """
    candidates = [leaf for leaf in discover_leaves(df, column) if leaf.is_numeric or leaf.is_boolean]
    if not candidates:
        return []
    text, metrics = metrics_text(df, column), metrics_variant(df, column)
    time, event_id = F.col("normalized_timestamp"), F.col("event_id")
    firsts, gaps = [], []
    for leaf in candidates:
        places = _place(text, leaf)
        seen = F.struct(time.isNull(), time, event_id, F.array(F.lit(int(len(leaf.keys) > 1)), *places))
        firsts.append(F.min(F.when(places[-1] > 0, seen)))
        gaps.append(F.count_if(leaf.value(metrics).isNull()) if leaf.is_boolean else F.lit(0))
    found = df.agg(*[column.alias(f"c{i}") for i, column in enumerate(firsts + gaps)]).first()
    facts = [(found[i], found[len(candidates) + i], leaf) for i, leaf in enumerate(candidates)]
    facts.sort(key=lambda fact: (fact[0] is None, fact[0] and tuple(fact[0])))
    return [leaf for _, missing, leaf in facts if not missing][:limit]
