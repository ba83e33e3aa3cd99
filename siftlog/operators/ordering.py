"""Exact global order without a global window.

Values are cut into ranges of about equal size, windows run inside the ranges,
and a table with one row per range carries totals from one range to the next.
A value that many rows share never fills a range: callers reduce their input to
one row per value first, or such a value, which the cuts show, is counted alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from operator import or_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"
# Rows that a range holds, about; there are as many ranges as partitions at the least.
RANGE_ROWS = 2_000_000
MOST_RANGES = 4_096
# Parts that the rows of one frequent value are spread over.
SALTS = 256


def find_cuts(df: DataFrame, values: dict[str, Column], range_rows: int | None = None, least: int | None = None) -> dict[str, list[float]]:
    """The inner borders of ranges with about as many rows each, for several values in one job.

    A border that is there twice is a value of at least one range's share of the rows.
    There are `least` ranges or more, as many as partitions if that is not given.
    """
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, min(MOST_RANGES, math.ceil(df.count() / (range_rows or RANGE_ROWS))))
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    accuracy = max(10_000, 4 * ranges)
    found = df.agg(*[F.percentile_approx(value, shares, accuracy).alias(name) for name, value in values.items()]).first()
    # Minus zero is zero.
    return {name: [cut + 0.0 for cut in found[name] or []] for name in values}


def with_range(df: DataFrame, value: Column, cuts: list[float]) -> DataFrame:
    """Add the number of the range that holds `value`; nulls form the last range."""
    borders = [-math.inf, *sorted(set(cuts or [0.0])), math.inf]
    ranges = Bucketizer(splits=borders, inputCol="_position", outputCol=RANGE, handleInvalid="keep")
    position = F.coalesce(value, F.lit(math.nan))
    return ranges.transform(df.withColumn("_position", position)).drop("_position")


def by_range() -> Window:
    """A window over the few range rows; its size is the number of ranges."""
    return Window.orderBy(RANGE)


def running_total(df: DataFrame, order: str, amount: str, out: str) -> DataFrame:
    """Add the running sum of `amount` in the order of the unique column `order`.

    Needs the range column of `with_range`.
    """
    inside = Window.partitionBy(RANGE).orderBy(F.asc_nulls_last(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = by_range().rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(RANGE).agg(F.sum(amount).alias("_total"))
    offsets = totals.select(RANGE, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    # One row per range: bounded by the number of ranges, whatever the data.
    joined = df.withColumn(out, F.sum(amount).over(inside)).join(F.broadcast(offsets), RANGE)
    return joined.withColumn(out, F.col(out) + F.col("_offset")).drop("_offset")


def _per_range(numbers: list, kind: str) -> Column:
    """One number per range, as a constant in the plan, for the range of the row."""
    known = F.split(F.lit(",".join(map(str, numbers))), ",").cast(f"array<{kind}>")
    return known[F.col(RANGE).cast("int")]


def _numbers(columns: Iterable[str]) -> dict[str, Column]:
    """Columns as doubles; minus zero is zero, as both have one rank."""
    values = {name: F.col(name).cast("double") for name in columns}
    return {name: F.when(value == 0, F.lit(0.0)).otherwise(value) for name, value in values.items()}


@dataclass(frozen=True)
class Placed:
    """Values of several columns, each a row of `long` with its `series` and range; nulls are left out.

    `is_hot` marks a value of a range's share of the rows or more: it is a border
    twice, and so the least value of its range. `rows` and `hot` count the values
    of each range, and those that are hot.
    """

    long: DataFrame
    rows: dict[str, dict[int, int]]
    hot: dict[str, dict[int, int]]

    def total(self, name: str) -> int:
        return sum(self.rows[name].values())

    def before(self, name: str) -> dict[int, int]:
        """The rows before each range."""
        ranges = sorted(self.rows[name])
        return dict(zip(ranges, accumulate((self.rows[name][number] for number in ranges), initial=0)))

    def of_range(self, counts: Callable[[str], dict[int, int]]) -> Column:
        """One number per series and range, as a constant in the plan."""
        found = F.lit(None).cast("long")
        for name in self.rows:
            known = counts(name)
            listed = [known.get(i, 0) for i in range(int(max(known, default=0)) + 1)]
            found = F.when(F.col("series") == name, _per_range(listed, "long")).otherwise(found)
        return found


def place(df: DataFrame, columns: list[str], *keys: str) -> Placed:
    """Find ranges of several columns and place all values, with `keys`; `df` is read three times, so it should be a table."""
    values = _numbers(columns)
    cuts = find_cuts(df, values)
    inputs, outputs = [f"_value{i}" for i in range(len(columns))], [f"_range{i}" for i in range(len(columns))]
    borders = [[-math.inf, *sorted(set(cuts[name] or [0.0])), math.inf] for name in columns]
    ranges = Bucketizer(splitsArray=borders, inputCols=inputs, outputCols=outputs, handleInvalid="keep")
    plain = df.select(*keys, *[F.coalesce(value, F.lit(math.nan)).alias(out) for value, out in zip(values.values(), inputs)], *[value.isNotNull().alias(f"{out}_is") for value, out in zip(values.values(), inputs)])
    items = [
        F.struct(F.lit(name).alias("series"), F.when(F.col(f"{value}_is"), F.col(value)).alias("value"), F.col(out).alias(RANGE))
        for name, value, out in zip(columns, inputs, outputs)
    ]
    long = ranges.transform(plain).select(*keys, F.inline(F.array(*items))).filter(F.col("value").isNotNull())
    known = F.lit(None).cast("double")
    for name, own in zip(columns, borders):
        times = Counter(cuts[name])
        listed = [border if times[border] > 1 else math.nan for border in own[:-1]]
        known = F.when(F.col("series") == name, _per_range([*listed, math.nan], "double")).otherwise(known)
    long = long.withColumn("is_hot", F.coalesce((F.col("value") == known) & ~F.isnan("value"), F.lit(False)))
    rows: dict[str, dict[int, int]] = {name: {} for name in columns}
    hot: dict[str, dict[int, int]] = {name: {} for name in columns}
    # One row per range.
    for row in long.groupBy("series", RANGE).agg(F.count("*").alias("rows"), F.count_if("is_hot").alias("hot")).collect():
        rows[row["series"]][int(row[RANGE])], hot[row["series"]][int(row[RANGE])] = row["rows"], row["hot"]
    return Placed(long, rows, hot)


def exact_quantiles(placed: Placed, wanted: dict[str, list[float]]) -> dict[str, list[float]]:
    """Exact quantiles with linear interpolation between neighbours; NaN without a value.

    Only the ranges that hold the neighbours are counted by value and sorted, in
    one job for all columns: nearly nothing is shuffled.
    """
    places = {name: [share * (placed.total(name) - 1) for share in shares] for name, shares in wanted.items() if placed.total(name)}
    ends = {name: [end for at in found for end in (math.floor(at), math.ceil(at))] for name, found in places.items()}
    out = {name: [math.nan] * len(shares) for name, shares in wanted.items()}
    if not places:
        return out
    tests = []
    for name, own in ends.items():
        before = placed.before(name)
        holding = {max(number for number, rows in before.items() if rows <= end) for end in own}
        tests.append((F.col("series") == name) & F.col(RANGE).isin(*map(float, holding)))
    counted = placed.long.filter(reduce(or_, tests)).groupBy("series", RANGE, "value").agg(F.count("*").alias("ties"))
    inside = Window.partitionBy("series", RANGE).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("ties").over(inside) + placed.of_range(placed.before))
    values = [F.min(F.when((F.col("series") == name) & (F.col("upto") > end), F.col("value"))) for name, own in ends.items() for end in own]
    found = iter(upto.agg(*[value.alias(f"v{i}") for i, value in enumerate(values)]).first())
    for name, own in places.items():
        for i, at in enumerate(own):
            low, high = next(found), next(found)
            out[name][i] = low + (high - low) * (at - math.floor(at))
    return out


def column_quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> dict[str, list[float]]:
    """Exact quantiles of several columns."""
    return exact_quantiles(place(df, list(wanted)), wanted) if wanted else {}


def percentile_ranks(placed: Placed, row_key: str, ranks: dict[str, str]) -> DataFrame:
    """`row_key`, which `placed` must hold, and a column for each of `ranks`: the percentile rank of the value.

    Ties share their average. Values are ranked inside their ranges, all columns in
    one shuffle; hot ones are counted, and spread over `SALTS` windows that do nothing.
    """
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64(row_key), F.lit(SALTS)) + 1).otherwise(0)
    inside = Window.partitionBy("series", RANGE, "_salt").orderBy("value")
    hot = placed.of_range(placed.hot.get)
    middle = (F.rank().over(inside) + F.count("*").over(inside)) / F.lit(2.0)
    long = placed.long.withColumn("_salt", salt).withColumn("_place", middle)
    within = F.when(F.col("is_hot"), (hot + 1) / F.lit(2.0)).otherwise(hot + F.col("_place"))
    total = F.lit(None).cast("double")
    for name in ranks:
        total = F.when(F.col("series") == name, F.lit(float(placed.total(name)))).otherwise(total)
    long = long.select(row_key, "series", ((placed.of_range(placed.before) + within) / total).alias("rank"))
    return long.groupBy(row_key).agg(*[F.max(F.when(F.col("series") == name, F.col("rank"))).alias(out) for name, out in ranks.items()])


def add_percentile_ranks(df: DataFrame, row_key: str, ranks: dict[str, str], placed: Placed | None = None) -> DataFrame:
    """Add the percentile rank of each row's value for several columns, by one join on the unique `row_key`.

    A null has no rank.
    """
    found = percentile_ranks(placed or place(df, list(ranks), row_key), row_key, ranks).withColumnRenamed(row_key, "_key")
    return df.join(found, F.col(row_key) == F.col("_key"), "left").drop("_key")
