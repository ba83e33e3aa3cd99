"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target over
size. Its whole part is taken; the fractional parts are rounded in pairs: of two
documents one gets mass from the other, in words, until one of them has no fraction
left. The direction is drawn so that each keeps its expected value, and the words
of the pair stay the same. What is left of one group of documents, a single
fraction, meets what is left of other groups one level up, until one is left per
source. Of that one document the mix takes a part, so that each source's words
meet its target to the word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlog.llm.common import ready, words_in
from siftlog.session import stage

WEIGHTS = (3, 1, 2)
BUDGET_SHARE, MOST_COPIES = 1.5, 2
# Documents that are rounded in one group; groups of groups have as many.
GROUP = 64
SEED = 42


def source_table(narrow: DataFrame) -> DataFrame:
    """`source`, `words`, `rows` and the `weight` of each source.

    The number of a source is its place by code point, null last. Places are
    counted inside ranges of sources and carried on from range to range.
    """
    sums = stage(narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "sources")
    parts = int(sums.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(sums.repartitionByRange(parts, F.asc_nulls_last("source")).withColumn("_range", F.spark_partition_id()), "sources")
    counts = {row["_range"]: row["n"] for row in placed.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # one row per range
    before, total = [], 0
    for i in range(parts):
        before.append(total)
        total += counts.get(i, 0)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last("source")))
    # One number per range, as a constant.
    place = inside - 1 + F.array(*[F.lit(n).cast("long") for n in before])[F.col("_range")]
    weights = F.array(*[F.lit(float(weight)) for weight in WEIGHTS])
    return placed.withColumn("weight", weights[F.pmod(place, F.lit(len(WEIGHTS))).cast("int")]).drop("_range")


def with_targets(sources: DataFrame, share: float = BUDGET_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """Add `target`: `share` of all words by weight, at most `most` times the source's own.

    A level per unit of weight is raised until the words are given out: sources that
    would be above their bound are fixed there, and the rest is shared again.
    One row of sums comes to the driver for each round.
    """
    sources = stage(sources, "weights")
    bound = F.col("words") * F.lit(float(most))
    level = -1.0
    while True:
        full = F.col("weight") * F.lit(level) >= bound
        sums = sources.agg(
            (F.sum("words") * F.lit(share)).alias("all"),
            F.coalesce(F.sum(F.when(full, bound)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if not sums["open"] or not sums["all"]:
            return sources.withColumn("target", F.when(full, bound).otherwise(0.0))
        raised = (sums["all"] - sums["fixed"]) / sums["open"]
        if raised <= level:
            return sources.withColumn("target", F.least(F.when(full, bound).otherwise(F.col("weight") * F.lit(level)), bound))
        level = raised


def _attach(narrow: DataFrame, sources: DataFrame) -> DataFrame:
    """Add the columns of its source to each row.

    Sources with more rows than an average partition are fewer than there are
    partitions, so they are broadcast; the rest join by a shuffle without a hot key.
    """
    parts = int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sources.agg(F.sum("rows")).first()[0] or 0
    large = F.col("rows") > F.lit(rows / parts)
    facts = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    flagged = narrow.join(F.broadcast(facts.filter(large)), same, "left")
    hot = flagged.filter(F.col("rows").isNotNull())
    cold = flagged.filter(F.col("rows").isNull()).select(*narrow.columns)
    return hot.unionByName(cold.join(facts.filter(~large), same)).drop("_source")


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _pivot(carry: Column, item: Column) -> tuple[Column, Column]:
    """The two documents after a transfer of words between them; one is integral."""
    to_carry = F.least((1 - carry["p"]) * carry["left"], item["p"] * item["left"])
    to_item = F.least(carry["p"] * carry["left"], (1 - item["p"]) * item["left"])
    up = _uniform(carry["id"], item["id"], carry["left"], item["left"], F.lit(1)) * (to_carry + to_item) < to_item
    fills = (1 - carry["p"]) * carry["left"] <= item["p"] * item["left"]
    drains = carry["p"] * carry["left"] <= (1 - item["p"]) * item["left"]
    carry_p = F.when(up, F.when(fills, 1.0).otherwise(carry["p"] + to_carry / carry["left"])).otherwise(F.when(drains, 0.0).otherwise(carry["p"] - to_item / carry["left"]))
    item_p = F.when(up, F.when(fills, item["p"] - to_carry / item["left"]).otherwise(0.0)).otherwise(F.when(drains, item["p"] + to_item / item["left"]).otherwise(1.0))
    clean = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    return carry.withField("p", clean(carry_p)), item.withField("p", clean(item_p))


def _open(item: Column) -> Column:
    return (item["p"] > 0) & (item["p"] < 1)


def _round_group(items: Column, kind: str) -> Column:
    """Fold the sorted items of one group: `done` ones, and the `carry` with what is left."""
    empty = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("carry"))

    def add(state: Column, item: Column) -> Column:
        carry, done = state["carry"], state["done"]
        first, second = _pivot(carry, item)
        second_open = _open(second)
        pivoted = F.struct(
            F.concat(done, F.array(F.when(second_open, first).otherwise(second))).alias("done"),
            F.when(second_open, second).otherwise(first).alias("carry"),
        )
        closed = F.struct(F.concat(done, F.array(carry)).alias("done"), item.alias("carry"))
        begun = F.struct(done.alias("done"), item.alias("carry"))
        return F.when(carry.isNull(), begun).when(~_open(carry), closed).otherwise(pivoted)

    return F.aggregate(items, empty, add)


def mix(docs: DataFrame, share: float = BUDGET_SHARE, most: float = MOST_COPIES) -> DataFrame:
    """`doc_id`, `source`, `size`, `source_size`, `target`, `copies` and `taken` of every row.

    `size` counts words, 0 for a null text. `copies` is the whole number below or
    above target over source size, `taken` the size times the copies; one document
    of a source gives a part of a copy besides, its first words, so that the
    words taken differ from the target by less than one. A null source is
    one of its own. Rows equal in doc_id, source and size are one item with that
    many rows, so that a repeated row has a defined result: the copies are dealt
    to the rows as evenly as they go. Documents and sources without a word get 0.
    The draws depend on the rows alone, so reruns agree. An empty table gives none.
    Other columns are not read.
    """
    ready(docs.sparkSession)
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    narrow = stage(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    whole = narrow.select("source", (F.col("size") * F.col("n")).alias("size"))
    sources = stage(with_targets(source_table(whole), share, most), "targets")
    kind = f"struct<id:{narrow.schema['doc_id'].dataType.simpleString()},source:string,source_size:bigint,target:double,size:bigint,rows:bigint,whole:bigint,left:bigint,p:double>"

    each = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    joined = _attach(narrow.withColumnRenamed("n", "n_rows"), sources)
    base = F.floor(each)
    # Of `n_rows` equal rows, some whole ones get a copy more; one fraction is left.
    extra = (each - base) * F.col("n_rows")
    more = F.floor(extra)
    item = F.struct(
        F.col("doc_id").alias("id"), "source", F.col("words").alias("source_size"), "target", "size", F.col("n_rows").alias("rows"),
        (base * F.col("n_rows") + more).cast("long").alias("whole"), F.col("size").alias("left"),
        F.when(F.col("size") > 0, extra - more).otherwise(0.0).alias("p"),
    ).cast(kind)
    groups = F.greatest(F.ceil(F.col("rows") / GROUP), F.lit(1))
    member = F.pmod(F.xxhash64("doc_id", "source", "size", F.lit(SEED)), groups)
    level = joined.select("source", member.alias("member"), groups.alias("groups"), item.alias("item"))
    # Items without a fraction are done before the first level.
    level = stage(level, "level")
    done = [level.filter(~_open(F.col("item"))).select("item")]
    rest = level.filter(_open(F.col("item")))
    while True:
        # Large documents first; ties by id.
        order = lambda a, b: F.when(a["left"] > b["left"], -1).when(a["left"] < b["left"], 1).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)
        gathered = rest.groupBy("source", "member", "groups").agg(F.collect_list("item").alias("items"))
        rounded = stage(gathered.select("source", "member", "groups", _round_group(F.array_sort("items", order), kind).alias("state")), "level")
        done.append(rounded.select(F.explode("state.done").alias("item")))
        most_groups = rounded.agg(F.max("groups")).first()[0] or 1
        above = F.greatest(F.ceil(F.col("groups") / GROUP), F.lit(1))
        rest = rounded.select("source", F.floor(F.col("member") / GROUP).alias("member"), above.alias("groups"), F.col("state.carry").alias("item"))
        if most_groups == 1:
            break
        done.append(rest.filter(~_open(F.col("item"))).select("item"))
        rest = rest.filter(_open(F.col("item")))
    done.append(rest.select("item"))
    items = reduce(DataFrame.union, done).select("item.*").withColumn("total", (F.col("whole") + F.floor("p")).cast("long"))
    # What the one open item of a source takes of a copy, in words.
    items = items.withColumn("part", F.when(_open(F.struct("p")), F.round(F.col("p") * F.col("size"))).otherwise(0).cast("long"))
    least = F.floor(F.col("total") / F.col("rows")).cast("long")
    more = F.col("total") - least * F.col("rows")
    rows = items.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    rows = rows.withColumn("copies", least + (F.col("place") <= more).cast("long"))
    taken = F.col("copies") * F.col("size") + F.when(F.col("place") == more + 1, F.col("part")).otherwise(0)
    return rows.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies", taken.cast("long").alias("taken"))
