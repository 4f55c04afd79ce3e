"""One ranking from several scores on different scales, by leximin over percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.scores import score_bin
from quillmark.operators.places import range_places
from quillmark.session import fits_broadcast

#: Items of a list beyond which its query's lists are worked on by many tasks.
LONG = 20_000


def _percentile(below: Column, upto: Column, size: Column) -> Column:
    return (below + (upto - below + 1) / F.lit(2.0)) / size


def short_percentiles(rows: DataFrame) -> DataFrame:
    """Adds ``pct`` and ``_systems`` to rows (system, query_id, ord, score) that are in one place by query_id."""
    each = Window.partitionBy("query_id", "system")
    order = each.orderBy("score")
    upto = F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.withColumn("_below", F.rank().over(order) - 1).withColumn("_upto", upto).withColumn("_n", F.count(F.lit(1)).over(each))
    systems = F.size(F.collect_set("system").over(Window.partitionBy("query_id")))
    return ranked.select("system", "query_id", "ord", _percentile(F.col("_below"), F.col("_upto"), F.col("_n")).alias("pct")).withColumn("_systems", systems)


def long_percentiles(rows: DataFrame) -> DataFrame:
    """The same for lists of any length: ranks are prefix sums over distinct scores in two steps, over monotone bins and
    inside a bin, so that the scores of a long list are never sorted in one task."""
    list_ = ["system", "query_id"]
    distinct = rows.groupBy(*list_, "score").agg(F.count(F.lit(1)).alias("_equal")).withColumn("_bin", score_bin(F.col("score"), 256))
    bins = distinct.groupBy(*list_, "_bin").agg(F.sum("_equal").alias("_n"))
    every = Window.partitionBy(*list_)
    before = every.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*list_, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(every).alias("_size"))
    inside = Window.partitionBy(*list_, "_bin").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranks = distinct.withColumn("_less", F.coalesce(F.sum("_equal").over(inside), F.lit(0))).join(bins, [*list_, "_bin"])
    below = F.col("_base") + F.col("_less")
    ranks = ranks.select(*list_, "score", _percentile(below, below + F.col("_equal"), F.col("_size")).alias("pct"))
    systems = rows.groupBy("query_id").agg(F.count_distinct("system").alias("_systems"))
    return rows.join(ranks, [*list_, "score"]).select(*list_, "ord", "pct").join(systems, "query_id").select(*list_, "ord", "pct", "_systems")


def _vectors(pct: DataFrame, systems: int) -> DataFrame:
    items = pct.where(F.col("_systems") == systems).groupBy("query_id", "ord").agg(F.collect_list("pct").alias("_p"))
    missing = F.array_repeat(F.lit(0.0), (F.lit(systems) - F.size("_p")).cast("int"))
    return items.select("query_id", "ord", F.sort_array(F.concat(missing, F.col("_p"))).alias("weakest"))


def leximin_vectors(pairs: DataFrame, sizes: DataFrame, systems: int, long: int = LONG) -> DataFrame:
    """(query_id, ord, weakest): every item's percentiles in ascending order, 0 where a system doesn't list it.

    ``pairs`` has (system, query_id, ord, score), ``sizes`` upper bounds (system, query_id, n) of the lists' lengths. An
    item's percentile is the share of the list below it, equal scores taking the middle of their places; an item that comes
    more than once counts once, with its highest score. Only queries with rows in all ``systems`` systems are kept; null
    queries and systems are left out. The array has ``systems`` entries and compares entry by entry, which is the leximin
    order.

    A query whose lists are all short moves to one task, once, and everything is worked out there. Queries with a list
    beyond ``long`` items are spread by item and score instead.
    """
    known = pairs.where(F.col("query_id").isNotNull() & F.col("system").isNotNull())
    hot = sizes.where((F.col("n") > long) & F.col("query_id").isNotNull()).select("query_id").distinct()
    hot = F.broadcast(hot) if fits_broadcast(hot, 64) else hot
    highest = F.max("score").alias("score")
    short = known.join(hot, "query_id", "left_anti").repartition("query_id").groupBy("query_id", "system", "ord").agg(highest)
    long_ = known.join(hot, "query_id", "left_semi").groupBy("query_id", "system", "ord").agg(highest)
    return _vectors(short_percentiles(short), systems).unionByName(_vectors(long_percentiles(long_), systems))


def leximin_rank(vectors: DataFrame, top: int | None = None) -> DataFrame:
    """(query_id, ord, weakest, place): items of each query by leximin, place 1 first; ties by smaller ord.

    ``top=1`` is a plain maximum with partial aggregation; other ``top`` keep the first places, cut per task before rows
    meet. Without ``top`` items are range-sorted into tasks by query and vector, and a place is the place in the task after
    those of the query in earlier tasks, so that a query of any length is ranked by many tasks.
    """
    if top == 1:
        best = vectors.groupBy("query_id").agg(F.max(F.struct("weakest", (-F.col("ord").cast("long")).alias("o"))).alias("b"))
        return best.select("query_id", (-F.col("b.o")).cast("int").alias("ord"), F.col("b.weakest").alias("weakest"), F.lit(1).alias("place"))
    if top:
        w = Window.partitionBy("query_id").orderBy(F.desc("weakest"), F.asc("ord"))
        return vectors.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)
    placed = range_places(vectors, ["query_id"], [F.desc("weakest"), F.asc("ord")])
    return placed.withColumn("place", F.col("place").cast("int"))
