import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftlog.operators import ordering


def values(name):
    rng = np.random.default_rng(5)
    if name == "spread":
        return rng.normal(size=3_000)
    if name == "hot":
        # A third of the rows share one value.
        return np.concatenate([np.full(1_000, 0.25), rng.integers(0, 50, 2_000) / 10])
    if name == "constant":
        return np.full(400, 7.0)
    return np.array([3.5])


@pytest.mark.parametrize("name", ["spread", "hot", "constant", "single"])
@pytest.mark.parametrize("range_rows", [2_000_000, 40])
def test_ranks_and_quantiles(spark, monkeypatch, name, range_rows):
    monkeypatch.setattr(ordering, "RANGE_ROWS", range_rows)
    data = values(name)
    frame = spark.createDataFrame(pd.DataFrame({"id": range(len(data)), "score": data})).repartition(5)
    ranked = ordering.add_percentile_ranks(frame, "id", {"score": "rank"}).toPandas().sort_values("id")
    expected = pd.Series(data).rank(method="average", pct=True)
    assert ranked["rank"].to_numpy() == pytest.approx(expected.to_numpy(), abs=1e-12)
    shares = [0.0, 0.01, 0.5, 0.985, 1.0]
    assert ordering.column_quantiles(frame, {"score": shares})["score"] == pytest.approx(np.quantile(data, shares), abs=1e-12)


def test_several_columns_share_a_pass(spark):
    frame = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 5.0), (3, 3.0, 5.0), (4, None, None)], "id long, a double, b double")
    assert ordering.column_quantiles(frame, {"a": [0.5], "b": [0.5]}) == {"a": [2.0], "b": [5.0]}
    found = ordering.add_percentile_ranks(frame, "id", {"a": "ra", "b": "rb"}).orderBy("id").collect()
    assert [row.ra for row in found] == [pytest.approx(1 / 3), pytest.approx(2 / 3), 1.0, None]
    assert [row.rb for row in found] == [None, 0.75, 0.75, None]


def test_zero_has_one_rank(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([0.0, -0.0, -1.0, 0.0, -0.0, 2.0])], "id long, a double")
    found = ordering.add_percentile_ranks(frame, "id", {"a": "rank"}).orderBy("id").collect()
    assert [row["rank"] for row in found] == pytest.approx([3.5 / 6, 3.5 / 6, 1 / 6, 3.5 / 6, 3.5 / 6, 1.0])


def test_a_frequent_value_is_not_sorted(spark):
    """The rows of a value that a third of all share are spread over many windows."""
    frame = spark.createDataFrame(pd.DataFrame({"id": range(3_000), "score": values("hot")}))
    cuts = ordering.find_cuts(frame, {"score": F.col("score")})["score"]
    assert cuts.count(0.25) > 1
    assert ordering.add_percentile_ranks(frame, "id", {"score": "rank"}).filter("score = 0.25").agg(F.count_distinct("rank")).first()[0] == 1


def test_ranges_follow_the_rows(spark, monkeypatch):
    frame = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    assert len(ordering.find_cuts(frame, {"v": F.col("v")})["v"]) == 7
    monkeypatch.setattr(ordering, "RANGE_ROWS", 100)
    assert len(ordering.find_cuts(frame, {"v": F.col("v")})["v"]) == 99


def test_nothing_to_rank(spark):
    empty = spark.createDataFrame([], "id long, a double")
    assert ordering.add_percentile_ranks(empty, "id", {"a": "rank"}).count() == 0
    assert np.isnan(ordering.column_quantiles(empty, {"a": [0.5]})["a"][0])
    assert ordering.column_quantiles(empty, {}) == {}


@pytest.mark.parametrize("cuts", [[], [3.0], [1.0, 2.0, 50.0, 51.0, 99.0]])
def test_running_total(spark, cuts):
    frame = spark.range(100).select(F.col("id").cast("double").alias("v"), (F.col("id") % 3).alias("amount"))
    placed = ordering.with_range(frame, F.col("v"), cuts)
    found = ordering.running_total(placed, "v", "amount", "total").orderBy("v").collect()
    assert [row.total for row in found] == list(np.cumsum([i % 3 for i in range(100)]))
