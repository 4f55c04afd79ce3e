"""Ranked lists held as arrays, as long rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exploded(lists: DataFrame, keys: list[Column], ids: str, scores: str) -> DataFrame:
    """(keys, ord, score): the n-th id with the n-th score of a row.

    Pairs with a missing id, a missing score or a NaN score are left out, as are the unmatched ends of arrays of unequal
    length. Null and empty arrays give no rows.
    """
    flat = lists.select(*keys, F.col(ids).alias("_i"), F.col(scores).alias("_s"))
    names = [c for c in flat.columns if c not in ("_i", "_s")]
    flat = flat.select(*names, F.explode(F.arrays_zip("_i", "_s")).alias("_p")).select(*names, F.col("_p._i").alias("ord"), F.col("_p._s").alias("score"))
    return flat.where(F.col("ord").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))


def system_scores(hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """(system, query_id, ord, score), one row per item of a list, with its highest score.

    System is ``bm25`` for hits and the run for ranked lists; rows of one query and system are one list. The
    maximum is taken with partial aggregation and spread by item, so a query with very many items is no hot
    group. Rows with a null query or run are a list of their own.
    """
    return pair_rows(hits, ranked).groupBy("system", "query_id", "ord").agg(F.max("score").alias("score"))


def in_order(scores: DataFrame) -> DataFrame:
    """(system, query, doc, score, rank): lists best first; equal scores by descending document, as trec_eval orders them."""
    w = Window.partitionBy("system", "query").orderBy(F.desc("score"), F.desc("doc"))
    return scores.select("system", F.col("query_id").alias("query"), F.col("ord").alias("doc"), "score").withColumn("rank", F.row_number().over(w))


def pooled_judgements(lists: DataFrame, depth: int = 10) -> DataFrame:
    """(query, doc, grade): documents in the first ``depth`` of some list; the grade is one less than how many systems'
    lists have them there, so what two systems agree on is relevant."""
    return lists.where(F.col("rank") <= depth).groupBy("query", "doc").agg((F.count_distinct("system") - 1).cast("int").alias("grade"))


def list_sizes(hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """(system, query_id, n): an upper bound of each list's items, from the arrays' lengths alone."""
    a = hits.select(F.lit("bm25").alias("system"), "query_id", F.size("ids").alias("n"))
    b = ranked.select(F.col("run").alias("system"), "query_id", F.size("top").alias("n"))
    return a.unionByName(b).groupBy("system", "query_id").agg(F.sum(F.greatest(F.col("n"), F.lit(0))).cast("long").alias("n"))


def pair_rows(hits: DataFrame, ranked: DataFrame) -> DataFrame:
    """(system, query_id, ord, score) of all usable pairs, repeated items and all."""
    a = exploded(hits, [F.lit("bm25").alias("system"), F.col("query_id")], "ids", "scores")
    return a.unionByName(exploded(ranked, [F.col("run").alias("system"), F.col("query_id")], "top", "topsims"))
