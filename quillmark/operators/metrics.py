"""Quality of ranked lists against relevance judgements.

Lists have (…, query, doc, rank); judgements (query, doc, grade), relevant above 0. ``by`` names further columns that tell
lists apart, such as the system. Where the reference's parts differ, the variant is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def discount(rank: Column) -> Column:
    return F.log2(rank + F.lit(1.0))


def ideal_gain(judged: DataFrame, k: int) -> DataFrame:
    """(query, ideal, relevant): the best possible discounted gain of all judged relevant documents, and their number."""
    w = Window.partitionBy("query").orderBy(F.desc("grade"), "doc")
    order = judged.where("grade > 0").withColumn("_r", F.row_number().over(w))
    return order.groupBy("query").agg(F.sum(F.when(F.col("_r") <= k, F.col("grade") / discount(F.col("_r")))).alias("ideal"), F.count(F.lit(1)).alias("relevant"))


def ranking_metrics(lists: DataFrame, judged: DataFrame, k: int = 10, recalls: tuple[int, ...] = (24, 100), by: list[str] | None = None) -> DataFrame:
    """Per list: ndcg, recall at the given depths, hit1, first_rank (0 if none is found) and reciprocal rank.

    The ideal counts every judged relevant document of the query, graded. A list of a query without relevant documents
    scores 0.
    """
    keys = [*(by or []), "query"]
    grades = judged.where("grade > 0").select("query", "doc", "grade")
    rows = lists.join(grades, ["query", "doc"], "left")
    good = F.col("grade").isNotNull()
    first = F.coalesce(F.min(F.when(good, F.col("rank"))), F.lit(0))
    per = rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(good & (F.col("rank") <= k), F.col("grade") / discount(F.col("rank")))), F.lit(0.0)).alias("_gain"),
        *[F.count(F.when(good & (F.col("rank") <= n), 1)).alias(f"_found{n}") for n in recalls],
        first.alias("first_rank"),
    )
    per = per.join(ideal_gain(judged, k), "query", "left")
    share = lambda n: F.coalesce(F.try_divide(F.col(f"_found{n}"), F.col("relevant")), F.lit(0.0))
    return per.select(
        *keys,
        F.coalesce(F.try_divide(F.col("_gain"), F.col("ideal")), F.lit(0.0)).alias("ndcg"),
        *[share(n).alias(f"recall{n}") for n in recalls],
        hit_at(F.col("first_rank"), 1).alias("hit1"),
        F.col("first_rank").cast("long").alias("first_rank"),
        reciprocal(F.col("first_rank")).alias("rr"),
    )


def in_list_ndcg(lists: DataFrame, judged: DataFrame, k: int = 10, by: list[str] | None = None) -> DataFrame:
    """Binary nDCG whose ideal counts only the relevant documents inside the list."""
    keys = [*(by or []), "query"]
    rows = lists.join(judged.where("grade > 0").select("query", "doc", F.lit(1).alias("_g")), ["query", "doc"], "left")
    good = F.col("_g").isNotNull()
    per = rows.groupBy(*keys).agg(F.coalesce(F.sum(F.when(good & (F.col("rank") <= k), 1 / discount(F.col("rank")))), F.lit(0.0)).alias("_gain"), F.count("_g").alias("_in"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("_in"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / discount(r))
    return per.select(*keys, F.when(F.col("_in") > 0, F.col("_gain") / ideal).otherwise(0.0).alias("ndcg"))


def hit_at(rank: Column, k: int) -> Column:
    return ((rank > 0) & (rank <= k)).cast("int")


def reciprocal(rank: Column) -> Column:
    return F.when(rank > 0, 1 / rank).otherwise(0.0)


def macro_mean(rows: DataFrame, value: str, stratum: str, by: list[str] | None = None) -> DataFrame:
    """Mean of the strata's means, each stratum weighing the same."""
    inner = rows.groupBy(*(by or []), stratum).agg(F.avg(value).alias("_m"))
    return inner.groupBy(*(by or [])).agg(F.avg("_m").alias(f"macro_{value}"), F.count(F.lit(1)).alias("strata"))


def two_level_mean(rows: DataFrame, value: str, inner: list[str], outer: list[str]) -> DataFrame:
    """Mean over the outer groups' members of each member's mean, as repeats are averaged before questions."""
    return rows.groupBy(*outer, *inner).agg(F.avg(value).alias("_m")).groupBy(*outer).agg(F.avg("_m").alias(value))
