"""Test collections in several published layouts, as four long tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.functions.text import titled_text
from quillmark.sources.files import parquet


@dataclass
class Collection:
    """passages (doc, text), queries (query, text), judged (query, doc, grade), excluded (query, doc)."""

    name: str
    language: str
    passages: DataFrame
    queries: DataFrame
    judged: DataFrame
    excluded: DataFrame


def _judged_only(queries: DataFrame, judged: DataFrame) -> DataFrame:
    return queries.join(judged.where("grade > 0").select("query").distinct(), "query", "left_semi")


def _pairs(rows: DataFrame, query: str, doc: str, grade: str) -> DataFrame:
    return rows.select(F.col(f"`{query}`").cast("string").alias("query"), F.col(f"`{doc}`").cast("string").alias("doc"), F.col(f"`{grade}`").cast("int").alias("grade"))


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "query string, doc string")


def titled(spark: SparkSession, root: str, name: str, language: str) -> Collection:
    """corpus with titles, queries and judgements in three parquet folders."""
    corpus = parquet(spark, f"{root}/corpus*", schemas.CORPUS).select(F.col("id").alias("doc"), titled_text(F.col("title"), F.col("text")).alias("text"))
    judged = _pairs(parquet(spark, f"{root}/qrels*", schemas.JUDGEMENTS), "query-id", "corpus-id", "score")
    queries = parquet(spark, f"{root}/queries*", schemas.QUERIES).select(F.col("id").alias("query"), "text")
    return Collection(name, language, corpus, _judged_only(queries, judged), judged, _none(spark))


def plain(spark: SparkSession, root: str, name: str, language: str = "zh") -> Collection:
    """corpus and queries of id and text, judgements of qid, pid and score; ids as text."""
    corpus = parquet(spark, f"{root}/corpus*").select(F.col("id").cast("string").alias("doc"), "text")
    judged = _pairs(parquet(spark, f"{root}/qrels*"), "qid", "pid", "score")
    queries = parquet(spark, f"{root}/queries*").select(F.col("id").cast("string").alias("query"), "text")
    return Collection(name, language, corpus, _judged_only(queries, judged), judged, _none(spark))


def with_lists(spark: SparkSession, root: str, name: str, language: str = "en") -> Collection:
    """documents of id and content, examples that list their gold and excluded ids; "N/A" stands for none."""
    corpus = parquet(spark, f"{root}/documents*", schemas.CORPUS_WITH_LISTS).select(F.col("id").alias("doc"), F.col("content").alias("text"))
    examples = parquet(spark, f"{root}/examples*", schemas.EXAMPLES)
    judged = examples.select(F.col("id").alias("query"), F.explode("gold_ids").alias("doc"), F.lit(1).alias("grade"))
    excluded = examples.select(F.col("id").alias("query"), F.explode("excluded_ids").alias("doc")).where("doc <> 'N/A'")
    return Collection(name, language, corpus, examples.select(F.col("id").alias("query"), F.col("query").alias("text")), judged, excluded)


LAYOUTS: dict[str, Callable[..., Collection]] = {"titled": titled, "plain": plain, "lists": with_lists}


def load(spark: SparkSession, layout: str, root: str, name: str, **more) -> Collection:
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout}; known: {', '.join(LAYOUTS)}")
    return LAYOUTS[layout](spark, root, name, **more)
