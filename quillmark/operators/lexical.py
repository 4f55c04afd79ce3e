"""Keyword search: postings, BM25, and what its scores give away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.functions.numeric import idf


def postings(docs: DataFrame, key: str, text: str, tokenizer: tx.Tokenizer = tx.tokens) -> DataFrame:
    """(doc, term, tf, length): one row per document and distinct term. Null and empty texts have none."""
    words = docs.select(F.col(key).alias("doc"), tokenizer(F.col(text)).alias("_w")).withColumn("length", F.size("_w"))
    return words.select("doc", "length", F.explode("_w").alias("term")).groupBy("doc", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_facts(docs: DataFrame, text: str, tokenizer: tx.Tokenizer = tx.tokens) -> DataFrame:
    """One row (docs, mean_length). Taken over all documents, so no filter on results can shift it."""
    return docs.select(F.size(F.coalesce(tokenizer(F.col(text)), F.array().cast("array<string>"))).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean_length"))


def query_terms(queries: DataFrame, key: str, text: str, tokenizer: tx.Tokenizer = tx.tokens) -> DataFrame:
    return queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(tokenizer(F.col(text)))).alias("term"))


def bm25(index: DataFrame, facts: DataFrame, terms: DataFrame, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """(query, doc, score), summed over the distinct terms of a query.

    The join on terms only touches the postings of asked terms: they are taken out first by a semi-join. Frequencies are
    counted over the whole index before that.
    """
    asked = terms.select("term").distinct()
    held = index.join(asked, "term", "left_semi")
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    f = F.broadcast(facts)
    saturated = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1 - b) + b * F.col("length") / F.col("mean_length")))
    scored = held.join(df, "term").crossJoin(f).select("term", "doc", (idf(F.col("docs"), F.col("df")) * saturated).alias("s"))
    return terms.join(scored, "term").groupBy("query", "doc").agg(F.sum("s").alias("score"))


def best_column(scores: list[DataFrame]) -> DataFrame:
    """Disjunction maximum: a document's score is that of its best column."""
    both = scores[0]
    for s in scores[1:]:
        both = both.unionByName(s)
    return both.groupBy("query", "doc").agg(F.max("score").alias("score"))


def excluding(scores: DataFrame, excluded: DataFrame) -> DataFrame:
    """Without the excluded (query, doc) pairs; taken out before anything is ranked, so no over-fetch is needed."""
    return scores.join(excluded, ["query", "doc"], "left_anti")


def top_k(scores: DataFrame, k: int, group: str = "query", score: str = "score", tie: list[Column] | None = None) -> DataFrame:
    """The k best per group with their rank; Spark limits each task's share before rows meet."""
    w = Window.partitionBy(group).orderBy(F.desc(score), *(tie or [F.asc("doc")]))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- What scores give away ---


def probe(docs: DataFrame, words: list[str], readers: list[str], note: int, steps: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(step, word, score): each word's score of one note, as the corpus grows from step to step.

    ``docs`` has (id, body, readers, added); the corpus of a step are the documents added by then, readable or not. Only
    readable ones come out, but the statistics, and so the scores, count all.
    """
    grown = steps.join(docs, F.col("added") <= F.col("step"))
    words_of = grown.select("step", "id", "readers", tx.tokens(F.col("body")).alias("w"))
    facts = words_of.groupBy("step").agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("w")).alias("mean_length"))
    hits = words_of.select("step", "id", "readers", F.size("w").alias("length"), F.explode("w").alias("word")).where(F.col("word").isin(words))
    hits = hits.groupBy("step", "id", "readers", "length", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("step", "word").agg(F.count(F.lit(1)).alias("df"))
    s = idf(F.col("docs"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1 - b) + b * F.col("length") / F.col("mean_length")))
    scored = hits.join(df, ["step", "word"]).join(facts, "step").where(F.arrays_overlap("readers", F.array(*[F.lit(r) for r in readers])))
    return scored.select("step", "word", "id", s.alias("score")) if note is None else scored.where(F.col("id") == note).select("step", "word", s.alias("score"))


def estimate(spark, scores: DataFrame, word: str, once: str, twice: str, most_docs: int = 100_000, most_df: int = 1000) -> DataFrame:
    """(documents, holding): corpus size and frequency of ``word``, from scores rounded to two places.

    ``once`` and ``twice`` are words known to be in one and two documents. In one note the other factors are equal, so
    ratios of scores are ratios of inverse document frequencies; the counts that fit them best are searched for.
    """
    r = F.round("score", 2)
    s = scores.agg(*[F.max(F.when(F.col("word") == w, r)).alias(n) for w, n in ((word, "k"), (once, "p"), (twice, "w"))])
    n = F.col("n").cast("double")
    fit = F.abs(idf(n, F.lit(2.0)) / idf(n, F.lit(1.0)) - F.col("w") / F.col("p"))
    size = s.crossJoin(spark.range(3, most_docs + 1).toDF("n")).groupBy("k", "p").agg(F.min_by("n", F.struct(fit, "n")).alias("documents"))
    total = F.col("documents").cast("double")
    fit = F.abs(idf(total, n) / idf(total, F.lit(1.0)) - F.col("k") / F.col("p"))
    return size.crossJoin(spark.range(1, most_df + 1).toDF("n")).groupBy("documents").agg(F.min_by("n", F.struct(fit, "n")).alias("holding"))
