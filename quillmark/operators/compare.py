"""Comparing systems over the same questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.operators.places import range_places


def paired(rows: DataFrame, system: str, a: str, value: str, keys: list[str]) -> DataFrame:
    """(system, keys, diff): every other system's value less that of ``a``, over the questions both answered."""
    base = rows.where(F.col(system) == a).select(*keys, F.col(value).alias("_a"))
    other = rows.where(F.col(system) != a).select(system, *keys, F.col(value).alias("_b"))
    return other.join(base, keys).select(system, *keys, (F.col("_b") - F.col("_a")).alias("diff"))


def kept_gained_lost(rows: DataFrame, system: str, base: str, key: str, hit: str = "hit1") -> DataFrame:
    """(system, kept, gained, lost): first-place hits compared with the base system's."""
    a = rows.where(F.col(system) == base).select(key, F.col(hit).alias("_a"))
    b = rows.where(F.col(system) != base).select(system, key, F.col(hit).alias("_b"))
    yes = lambda c: F.count(F.when(c, 1))
    x, y = F.col("_a") == 1, F.col("_b") == 1
    return b.join(a, key).groupBy(system).agg(yes(x & y).alias("kept"), yes(~x & y).alias("gained"), yes(x & ~y).alias("lost"))


def overlap(rows: DataFrame, system: str, a: str, b: str, key: str, found: Column) -> DataFrame:
    """One row (in_both, only_a, only_b, neither) over the questions both systems have."""
    one = rows.where(F.col(system) == a).select(key, found.alias("_a"))
    two = rows.where(F.col(system) == b).select(key, found.alias("_b"))
    yes = lambda c: F.count(F.when(c, 1))
    x, y = F.col("_a"), F.col("_b")
    return one.join(two, key).agg(yes(x & y).alias("in_both"), yes(x & ~y).alias("only_a"), yes(~x & y).alias("only_b"), yes(~x & ~y).alias("neither"))


def near_median(pool: DataFrame, value: str, text: str, key: str, plain: Column) -> DataFrame:
    """The plain questions of a pool, those nearest the pool's lower median first, then shorter text, then key.

    (key, value, median, place). The median is the pool's, plain or not.
    """
    from quillmark.operators.stats import order_statistics

    n = pool.agg(F.count(value).alias("n"))
    # The lower median is order statistic floor((n - 1) / 2): a nearest rank just below one half.
    low = order_statistics(pool.crossJoin(F.broadcast(n)).withColumn("_k", F.lit(1)), ["_k"], value, {"m": 0.5 - 1e-12}, nearest=True)
    mid = low.select(F.col("value").alias("median"))
    rows = pool.where(plain).crossJoin(F.broadcast(mid)).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    placed = range_places(rows.withColumn("_l", F.length(text)), [], [F.asc("_d"), F.asc("_l"), F.asc(key)])
    return placed.select(key, value, "median", F.col("place").cast("int").alias("place"))


def judged_status(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """Adds ``judged``: not judged, relevant, or judged not relevant."""
    j = judged.select("query", "doc", F.col("grade").alias("_g"))
    status = F.when(F.col("_g").isNull(), "not judged").when(F.col("_g") > 0, "relevant").otherwise("judged not relevant")
    return rows.join(j, ["query", "doc"], "left").withColumn("judged", status).drop("_g")


def rankable(candidates: DataFrame, judged: DataFrame) -> DataFrame:
    """(query, rankable): whether a relevant document is among a question's candidates."""
    good = judged.where("grade > 0").select("query", "doc").withColumn("_g", F.lit(1))
    return candidates.join(good, ["query", "doc"], "left").groupBy("query").agg(F.max(F.coalesce("_g", F.lit(0))).cast("boolean").alias("rankable"))


def missing(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidates that the corpus lacks; a run's integrity asks for none."""
    return candidates.join(corpus.select("doc").distinct(), "doc", "left_anti")
