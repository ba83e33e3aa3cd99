"""The feature matrix of the detectors: selection, cleaning, scaling, sampling."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlog.functions.metrics import Leaf, numeric_leaves
from siftlog.operators.features import BASE_FEATURES
from siftlog.session import stage

# The seed of every draw and the number of metric features.
SEED = 42
METRIC_FEATURES = 8


@dataclass(frozen=True)
class FeatureChoice:
    """The features of a fit; kept with the model to score new data alike."""

    names: tuple[str, ...]
    leaves: tuple[Leaf, ...]


def flat_metrics(df: DataFrame) -> list[str]:
    """The numeric `metric_*` columns that a table has already, in their order; boolean ones if they have a value in every row."""
    flat = [field for field in df.schema.fields if field.name.startswith("metric_") and isinstance(field.dataType, (T.NumericType, T.BooleanType))]
    booleans = [field.name for field in flat if isinstance(field.dataType, T.BooleanType)]
    gaps = df.agg(*[F.count_if(column(name).isNull()) for name in booleans]).first() if booleans else ()
    missing = {name for name, n in zip(booleans, gaps) if n}
    return [field.name for field in flat if field.name not in missing]


def choose_features(logs: DataFrame, metric_features: int = METRIC_FEATURES) -> FeatureChoice:
    """The base features and the first `metric_features` numeric metrics.

    Metrics that are columns already come first; then those of the metrics objects,
    in the order in which records bring them, without any that has the name of such a column.
    """
    flat = flat_metrics(logs)[:metric_features]
    # As many more as could have a name that is taken.
    found = numeric_leaves(logs, metric_features + len(flat)) if len(flat) < metric_features else []
    leaves = tuple(leaf for leaf in found if leaf.column not in flat)[: metric_features - len(flat)]
    return FeatureChoice((*BASE_FEATURES, *flat, *(leaf.column for leaf in leaves)), leaves)


def feature_columns(df: DataFrame) -> list[str]:
    """The same choice for a table without metrics objects, which may lack base features."""
    names = [name for name in BASE_FEATURES if name in df.columns] + flat_metrics(df)[:METRIC_FEATURES]
    if not names:
        raise ValueError("no numeric feature is available")
    return names


def vector_width(df: DataFrame, vector: str = "features") -> int:
    """The one length of all vectors; 0 without any."""
    least, most = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if least != most:
        raise ValueError(f"vectors of {least} to {most} values")
    return most or 0


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def clean(value: Column) -> Column:
    """A finite double; 0 for null, NaN, infinities and anything not a number."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < F.lit(math.inf), number).otherwise(F.lit(0.0))


def matrix(names: list[str] | tuple[str, ...]) -> Column:
    """The cleaned features as one array column."""
    return F.array(*[clean(column(name)) for name in names])


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation of each feature over the full table."""

    names: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    rows: int

    def scaled(self) -> Column:
        """The standardised features as one array column; 0 where there is no spread."""
        return F.array(
            *[
                (clean(column(name)) - F.lit(mean)) / F.lit(spread) if spread else F.lit(0.0)
                for name, mean, spread in zip(self.names, self.means, self.deviations)
            ]
        )


def fit_scaling(df: DataFrame, names: list[str] | tuple[str, ...]) -> Scaling:
    """One aggregation over the full table."""
    values = [clean(column(name)) for name in names]
    found = df.agg(F.count("*"), *[F.avg(v) for v in values], *[F.stddev_pop(v) for v in values]).first()
    if not found[0]:
        raise ValueError("no rows to scale")
    return Scaling(tuple(names), tuple(found[1 : 1 + len(names)]), tuple(found[1 + len(names) :]), found[0])


def draw_samples(df: DataFrame, draws: list[tuple[int, int]], key: str = "event_id", rows: int | None = None) -> list[DataFrame]:
    """A sample per (size, seed): exactly `min(size, rows)` rows, the same ones for the same seed.

    Rows are drawn by the hash of their key. A bound on the hash that all but
    surely leaves enough rows keeps each sort to about `size` rows, and one scan
    serves all samples. Should a bound leave too few, that sample is sorted out
    of all rows.
    """
    total = df.count() if rows is None else rows
    hashes = {f"_draw{seed}": F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))) for _, seed in draws}
    drawn = df.withColumns(hashes)
    near, counts = drawn, [total] * len(draws)
    shares = [(size + 8 * math.sqrt(size) + 64) / max(total, 1) for size, _ in draws]
    if max(shares) < 0.5:
        bounds = [format(math.ceil(share * 16**15), "015x") for share in shares]
        within = [F.col(name) < bound for name, bound in zip(hashes, bounds)]
        near = stage(drawn.filter(reduce(or_, within)), "draw")
        counts = near.agg(*[F.count_if(test) for test in within]).first()
    samples = []
    for (size, _), name, count in zip(draws, hashes, counts):
        source = near if count >= size else drawn
        samples.append(source.orderBy(name, key).limit(size).drop(*hashes))
    return samples


def sample_rows(df: DataFrame, size: int, seed: int = SEED, key: str = "event_id", rows: int | None = None) -> DataFrame:
    """One sample of `draw_samples`."""
    return draw_samples(df, [(size, seed)], key, rows)[0]
