"""Joining ranked legs into one ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONSTANT = 60


def ranked_leg(scores: DataFrame, shared: bool = True) -> DataFrame:
    """Adds ``rank`` per query. Shared: equal scores share a rank, one plus the number of strictly better ones; else the
    place in the list, which ``pos`` gives."""
    if not shared:
        return scores.withColumn("rank", F.col("pos") + 1)
    return scores.withColumn("rank", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score"))))


def reciprocal_ranks(legs: list[tuple[DataFrame, float | Column]], by: list[str] | None = None) -> DataFrame:
    """(query, doc, score) of weighted legs with ranks: the sum of weight / (60 + rank). A leg of weight 0 still admits its
    documents, with a score of 0."""
    keys = [*(by or []), "query", "doc"]
    parts = [leg.select(*keys, ((w if isinstance(w, Column) else F.lit(float(w))) / (CONSTANT + F.col("rank"))).alias("s")) for leg, w in legs]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*keys).agg(F.sum("s").alias("score"))


def fused_top(fused: DataFrame, k: int, tie: list[Column] | None = None, by: list[str] | None = None) -> DataFrame:
    """The k best of each query; ties by ascending document, or by the given order."""
    w = Window.partitionBy(*(by or []), "query").orderBy(F.desc("score"), *(tie or [F.asc("doc")]))
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def weight_sweep(keyword: DataFrame, semantic: DataFrame, weights: list[float], k: int) -> DataFrame:
    """(weight, query, doc, score, rank): the fused lists for every weight of the keyword leg."""
    ws = F.explode(F.array(*[F.lit(float(w)) for w in weights])).alias("weight")
    a = keyword.select("*", ws)
    b = semantic.select("*", ws)
    return fused_top(reciprocal_ranks([(a, F.col("weight")), (b, 1.0)], by=["weight"]), k, by=["weight"])


def capped_per_doc(ranked: DataFrame, parent: Column, cap: int = 3, k: int = 8) -> DataFrame:
    """At most ``cap`` passages of a parent first, then the others, up to k: (…, place)."""
    rows = ranked.withColumn("_p", parent)
    nth = F.row_number().over(Window.partitionBy("query", "_p").orderBy("rank"))
    place = F.row_number().over(Window.partitionBy("query").orderBy("_over", "rank"))
    return rows.withColumn("_over", (nth > cap).cast("int")).withColumn("place", place).where(F.col("place") <= k).drop("_p", "_over")
