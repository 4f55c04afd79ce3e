"""Queries of the operators for training data, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import body, cutoff, leximin, mih, mix, pack, quantile, scores, spans, split, tokens, topn
from quillmark.session import durable, table

Query = Callable[[SparkSession, str], DataFrame]


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = mih.usable(table(spark, sf_dir, "chunks"), "id", "embedding", 384, F.lit("chunks"))
    vectors = mih.usable(table(spark, sf_dir, "vectors"), "ord", "vec", 64, F.col("set_name"))
    return chunks, vectors


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, vectors = _vectors(spark, sf_dir)
    near = mih.nearest(chunks, 384, 5, durable, floor=0.85).unionByName(mih.nearest(vectors, 64, 5, durable, floor=0.85))
    return near.select(F.col("coll").alias("collection"), F.least("key", "other").alias("id_a"), F.greatest("key", "other").alias("id_b")).distinct()


def p1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar vectors of every vector whose key is divisible by 20, among all vectors."""
    near = lambda df, width: mih.nearest(df, width, 10, durable, asked=df.where(F.col("key") % 20 == 0))
    chunks, vectors = _vectors(spark, sf_dir)
    near = near(chunks, 384).unionByName(near(vectors, 64))
    return near.select(F.col("coll").alias("collection"), "key", "place", "other", F.round("cos", 6).alias("similarity"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.body_lines(table(spark, sf_dir, "passages"), durable).select("id", F.explode("outside").alias("line_no"))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return body.body_lines(table(spark, sf_dir, "passages"), durable).select("id", "body")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = quantile.wrong_figures(table(spark, sf_dir, "calls"), table(spark, sf_dir, "summaries"), keep=lambda df: durable(df, "p3"))
    return wrong.select("machine", "ranker", "span", F.date_format("since", "yyyy-MM-dd").alias("since"), "stat").distinct()


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = durable(quantile.sketch(quantile.latencies(table(spark, sf_dir, "calls")), [*quantile.WHO, "since"], "ms"), "p3")
    return quantile.quantiles(quantile.by_span(days), [*quantile.WHO, "span", "since"], quantile.PROBS)


def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the true percentile lies within the bounds of each sketched one."""
    return quantile.outside_bounds(table(spark, sf_dir, "calls"), p3_percentiles(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores.system_scores(table(spark, sf_dir, "hits"), table(spark, sf_dir, "ranked"))
    return topn.top_n(rows, ["system", "query_id"], "score", "ord", 10, durable).select("system", "query_id", "place", "ord")


def _leximin(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "hits"), table(spark, sf_dir, "ranked")
    return leximin.leximin_vectors(scores.pair_rows(*both), scores.list_sizes(*both), 4)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leximin.leximin_rank(_leximin(spark, sf_dir), top=1).select("query_id", "ord")


def p5_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leximin.leximin_rank(_leximin(spark, sf_dir)).select("query_id", "ord", F.round(F.col("weakest")[0], 9).alias("weakest"), "place")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, cut = cutoff.source_cutoffs(table(spark, sf_dir, "setdata"), table(spark, sf_dir, "searchcutoff"), durable)
    return cutoff.kept_elements(items, cut).select("run", "set_name", "probe", "question", "field", "pos")


def p6_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoffs and kept sizes per source and field, beside the distance in force for questions."""
    limits = table(spark, sf_dir, "searchcutoff")
    _, cut = cutoff.source_cutoffs(table(spark, sf_dir, "setdata"), limits, durable)
    force = limits.select("run", F.col("question").alias("in_force")).distinct()
    return cut.join(force, "run", "left").select("run", "set_name", "probe", "field", "share", "cutoff", "kept", "n", "in_force")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = split.split_texts(table(spark, sf_dir, "passages"))
    found = pieces.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("forced").alias("hard"))
    return found.where("n > 1").select("id", F.when(F.col("hard"), "yes").otherwise("no").alias("forced"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_texts(table(spark, sf_dir, "passages")).select("id", "section", "piece_no", "piece")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"])
    out = pack.pack(sizes, "doc_id", "tokens", durable)
    return out.select(F.col("id").alias("doc_id"), "piece_no", "start", F.col("size").alias("tokens"), "container")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id"])
    return pack.fill(pack.pack(sizes, "doc_id", "tokens", durable))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokens.token_counts(table(spark, sf_dir, "documents"), ["doc_id", "source"])
    return mix.mix(sizes, table(spark, sf_dir, "source_weights"), durable)


def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.SharedSpans(_docs(spark, sf_dir), durable).pairs()


def p10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return spans.coverage(spans.SharedSpans(docs, durable).stretches(), docs)


def p10_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return spans.without_repeats(docs, spans.SharedSpans(docs, durable).stretches())


QUERIES: dict[str, Query] = {k: v for k, v in sorted(globals().items()) if k[0] == "p" and k[1:2].isdigit()}
