"""Queries over the tables, one or more per operator, each over whole tables.

Where the tables lack something the operators need, it is derived: query texts are the titles of passages whose ``ord`` is
divisible by 20; a passage is relevant to a query if two systems or more have it among their first ten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import judging
from quillmark.functions import text as tx
from quillmark.functions import vector as vc
from quillmark.functions.numeric import uniform
from quillmark.operators import calibrate, calls, compare, fusion, lexical, lists, metrics, nearest, rankers, sampling, stats
from quillmark.session import durable, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
READERS = ["everyone", "mara"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c) -> F.Column:
    return F.round(c, 6) + F.lit(0.0)


# --- Tables with their repeated rows taken out ---


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "passages").dropDuplicates(["ord"])


def titles(spark: SparkSession, sf: str) -> DataFrame:
    p = passages(spark, sf)
    return p.where((F.col("ord") % 20 == 0) & (F.coalesce("title", F.lit("")) != "")).select(F.col("ord").alias("query"), F.col("title").alias("text"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunks").where(vc.usable(F.col("embedding"), 384)).dropDuplicates(["id"])


def call_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "calls")


def ranked_lists(spark: SparkSession, sf: str) -> DataFrame:
    return lists.in_order(lists.system_scores(table(spark, sf, "hits"), table(spark, sf, "ranked")))


def judged(spark: SparkSession, sf: str) -> DataFrame:
    return durable(lists.pooled_judgements(ranked_lists(spark, sf)), "judged")


def quality(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of every list; lists are stored, as they are ranked for the judgements and again for the metrics."""
    ordered = durable(ranked_lists(spark, sf), "lists")
    pooled = durable(lists.pooled_judgements(ordered), "judged")
    return metrics.ranking_metrics(ordered, pooled, by=["system"])


def run_names(spark: SparkSession, sf: str) -> tuple[str, str]:
    r = table(spark, sf, "ranked").agg(F.min("run").alias("a"), F.max("run").alias("z")).first()
    return r["a"] or "", r["z"] or ""


# --- Keyword search ---


@query
def token_counts(spark, sf):
    t = passages(spark, sf).where("text IS NOT NULL").select("ord", tx.tokens(F.col("text")).alias("t"))
    return t.select("ord", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query
def term_frequencies(spark, sf):
    return lexical.document_frequencies(lexical.postings(passages(spark, sf), "ord", "text"))


def _bm25(spark, sf, column="text", tokenizer=tx.tokens):
    p = passages(spark, sf)
    return lexical.bm25(lexical.postings(p, "ord", column, tokenizer), lexical.corpus_facts(p, column, tokenizer), lexical.query_terms(titles(spark, sf), "query", "text", tokenizer))


def _ranked(scores, k=10):
    rounded = scores.withColumn("score", r6("score"))
    return lexical.top_k(rounded, k).select("query", "doc", "rank", "score")


@query
def bm25_topk(spark, sf):
    return _ranked(_bm25(spark, sf))


@query
def bm25_excluding_own_document(spark, sf):
    ids = passages(spark, sf).select("ord", tx.doc_id(F.col("id")).alias("d"))
    own = ids.select(F.col("ord").alias("query"), "d").where(F.col("query") % 20 == 0).join(ids.select(F.col("ord").alias("doc"), "d"), "d").select("query", "doc")
    return _ranked(lexical.excluding(_bm25(spark, sf), own))


@query
def bm25_best_column(spark, sf):
    return _ranked(lexical.best_column([_bm25(spark, sf), _bm25(spark, sf, "title")]))


@query
def bm25_character_pairs(spark, sf):
    """All passages by words, those of scripts without spaces by character pairs."""
    return _ranked(_bm25(spark, sf, tokenizer=tx.bigrams))


def _leak_corpus(spark):
    many = spark.range(1, 201).select("id", F.concat(F.lit("weekly update on the office move, budget and hiring plan number "), F.col("id").cast("string")).alias("body"), F.array(F.lit("everyone")).alias("readers"), F.lit(1).alias("added"))
    notes = [(201, "layoff marker1 marker2", ["liv"], 1), (202, "marker2", ["liv"], 1), (203, "q2 layoff: restructuring plan, roles affected in q2", ["hr"], 2)]
    notes += [(203 + g, f"layoff notes {g}", ["hr"], 3) for g in range(1, 5)]
    return many.unionByName(spark.createDataFrame(notes, "id long, body string, readers array<string>, added int"))


def _leak(spark):
    steps = spark.createDataFrame([(1,), (2,), (3,)], "step int")
    return lexical.probe(_leak_corpus(spark), ["layoff", "marker1", "marker2"], ["liv", "everyone"], 201, steps)


@query
def bm25_leak_scores(spark, sf):
    return _leak(spark).select("step", "word", F.round("score", 2).alias("score"))


@query
def bm25_leak_estimate(spark, sf):
    found = lexical.estimate(spark, _leak(spark).where("step = 3"), "layoff", "marker1", "marker2")
    docs = _leak_corpus(spark).where(F.array_contains(tx.tokens(F.col("body")), "layoff") & nearest.readable("readers", ["liv", "everyone"]))
    return found.crossJoin(docs.agg(F.count(F.lit(1)).alias("readable")))


@query
def bm25_order_flip(spark, sf):
    many = _leak_corpus(spark).where("id <= 200")
    notes = [(201, "note layoff", ["liv"], 1), (202, "note marker2", ["liv"], 1), (203, "marker2", ["liv"], 1), (204, "q2 layoff: restructuring plan", ["hr"], 2), (205, "layoff notes 2", ["hr"], 3)]
    docs = many.unionByName(spark.createDataFrame(notes, "id long, body string, readers array<string>, added int"))
    steps = spark.createDataFrame([(1,), (2,), (3,)], "step int")
    s = lexical.probe(docs, ["layoff", "marker2"], ["liv", "everyone"], None, steps).groupBy("step", "id").agg(F.sum("score").alias("score")).where(F.col("id").isin(201, 202))
    w = Window.partitionBy("step").orderBy(F.desc(F.round("score", 9)), "id")
    return s.select("step", F.row_number().over(w).alias("pos"), "id")


# --- Vector search ---


@query
def vector_norms(spark, sf):
    c = chunks(spark, sf)
    return c.select("id", r6(vc.norm(F.col("embedding"))).alias("norm"), r6(vc.unit(F.col("embedding"))[0]).alias("first"))


@query
def knn_exact_topk(spark, sf):
    """The ten nearest of every chunk whose id is divisible by 20, among all chunks."""
    c = chunks(spark, sf).select("id", "embedding")
    found = nearest.exact_top_k(c.where("id % 20 = 0"), c, "id", "embedding", 10)
    return found.select("query", "key", "rank", r6("distance").alias("distance"))


def _one_query(spark, sf):
    c = chunks(spark, sf)
    return nearest.distances(c, c.agg(F.min_by("embedding", "id").alias("q"))).select("id", "topic", "readers", F.round("distance", 9).alias("distance"))


def _out(df):
    return df.select("id", "topic", r6("distance").alias("distance"))


@query
def permission_filtered_knn(spark, sf):
    return _out(_one_query(spark, sf).where(nearest.readable("readers", READERS)).orderBy("distance", "id").limit(10))


@query
def knn_cutoff_inside(spark, sf):
    return _out(nearest.inside(_one_query(spark, sf).where(nearest.readable("readers", READERS)), 0.9, 10))


@query
def knn_cutoff_outside(spark, sf):
    return _out(nearest.outside(_one_query(spark, sf).where(nearest.readable("readers", READERS)), 0.9, 10))


@query
def knn_post_filter_budget(spark, sf):
    return _out(nearest.budgeted(_one_query(spark, sf), nearest.readable("readers", READERS), 40, 10))


@query
def knn_scan_budgets(spark, sf):
    return _out(nearest.budgeted(_one_query(spark, sf), nearest.readable("readers", READERS), 20_000, 10, memory_budget=100))


@query
def first_visible_rank(spark, sf):
    return nearest.first_visible(_one_query(spark, sf), nearest.readable("readers", ["mara"]))


@query
def within_cutoff_by_topic(spark, sf):
    return _one_query(spark, sf).where(nearest.readable("readers", READERS) & (F.col("distance") < 1.0)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


# The same for every chunk whose id is divisible by 20; the queries above ask for the smallest id only, as their SQL does.


def _asked(c):
    return c.where("id % 20 = 0").select("id", "embedding")


def _near_all(c, rows, k):
    near = nearest.exact_top_k(_asked(c), rows.select("id", "embedding"), "id", "embedding", k).withColumnRenamed("key", "id")
    return near.join(c.select("id", "topic", "readers"), "id")


def _out_all(df):
    return df.select("query", "id", "topic", r6("distance").alias("distance"))


def _first_readable(near, k):
    w = Window.partitionBy("query").orderBy("distance", "id")
    return near.where(nearest.readable("readers", READERS)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


@query
def permission_filtered_knn_all(spark, sf):
    c = chunks(spark, sf)
    return _out_all(_near_all(c, c.where(nearest.readable("readers", READERS)), 10))


@query
def knn_cutoff_inside_all(spark, sf):
    """The cutoff is on the distance that orders the scan, so the first k within it are those of the first k that lie within."""
    c = chunks(spark, sf)
    return _out_all(_near_all(c, c.where(nearest.readable("readers", READERS)), 10).where(F.col("distance") < 0.9))


@query
def knn_cutoff_outside_all(spark, sf):
    return knn_cutoff_inside_all(spark, sf)


@query
def knn_post_filter_budget_all(spark, sf):
    c = chunks(spark, sf)
    return _out_all(_first_readable(_near_all(c, c, 40), 10))


@query
def knn_scan_budgets_all(spark, sf):
    c = chunks(spark, sf)
    return _out_all(_first_readable(_near_all(c, c, min(20_000, 100)), 10))


@query
def first_visible_rank_all(spark, sf):
    c = chunks(spark, sf)
    best = durable(_near_all(c, c.where(nearest.readable("readers", ["mara"])), 1).select("query", F.col("id").alias("best"), F.col("distance").alias("least")), "visible")
    met = nearest.all_distances(_asked(c), c.select("id", "embedding"), "id", "embedding").join(best, "query")
    return met.where(F.struct("distance", "key") <= F.struct("least", "best")).groupBy("query").agg(F.count(F.lit(1)).alias("rank"))


@query
def within_cutoff_by_topic_all(spark, sf):
    c = chunks(spark, sf)
    may = c.where(nearest.readable("readers", READERS))
    met = nearest.all_distances(_asked(c), may.select("id", "embedding"), "id", "embedding").where(F.col("distance") < 1.0)
    return met.join(may.select(F.col("id").alias("key"), "topic"), "key").groupBy("query", "topic").agg(F.count(F.lit(1)).alias("n"))


@query
def knn_random_projections(spark, sf):
    c = chunks(spark, sf)
    q = c.agg(F.min_by("embedding", "id").alias("q")).first()["q"]
    return nearest.hashed_near(c.select("id", "embedding"), q, "embedding", 10)


# --- Fusion ---


def _legs(spark, sf):
    s = lists.system_scores(table(spark, sf, "hits"), table(spark, sf, "ranked")).select("system", F.col("query_id").alias("query"), F.col("ord").alias("doc"), "score")
    w = Window.partitionBy("system", "query").orderBy(F.desc("score"))
    return s.withColumn("rank", F.rank().over(w))


@query
def rrf_hybrid_topk(spark, sf):
    """The keyword leg fused with every run, 24 passages a question."""
    legs = _legs(spark, sf)
    runs = legs.where("system <> 'bm25'").select(F.col("system").alias("run"), "query", "doc", "rank")
    asked = runs.select("run", "query").distinct()
    keyword = legs.where("system = 'bm25'").select("query", "doc", "rank").join(asked, "query").select("run", "query", "doc", "rank")
    fused = fusion.reciprocal_ranks([(keyword, 1.0), (runs, 1.0)], by=["run"]).withColumn("score", F.round("score", 9))
    return fusion.fused_top(fused, 24, by=["run"])


@query
def rrf_weight_sweep(spark, sf):
    """Mean nDCG@10 of the fusion with the first run, for every weight of the keyword leg."""
    legs = _legs(spark, sf)
    a = legs.where("system = 'bm25'").select("query", "doc", "rank")
    b = legs.where(F.col("system") == run_names(spark, sf)[0]).select("query", "doc", "rank")
    top = fusion.fused_top(fusion.reciprocal_ranks([(a.select("*", ws := F.explode(F.array(*[F.lit(w) for w in (1.0, 0.75, 0.5, 0.25, 0.0)])).alias("weight")), F.col("weight")), (b.select("*", ws), 1.0)], by=["weight"]).withColumn("score", F.round("score", 9)), 24, by=["weight"])
    m = metrics.ranking_metrics(top.select("weight", "query", "doc", "rank"), judged(spark, sf), by=["weight"])
    return m.groupBy("weight").agg(F.count(F.lit(1)).alias("questions"), r6(F.avg("ndcg")).alias("ndcg10"), r6(F.avg("recall24")).alias("recall24"))


@query
def rrf_by_position(spark, sf):
    """Fusion by places in the lists instead of shared ranks, with the first run."""
    l = ranked_lists(spark, sf)
    a = l.where("system = 'bm25'").select("query", "doc", "rank")
    b = l.where(F.col("system") == run_names(spark, sf)[0]).select("query", "doc", "rank")
    fused = fusion.reciprocal_ranks([(a, 1.0), (b, 1.0)]).withColumn("score", F.round("score", 9))
    return fusion.fused_top(fused, 24).select("query", "doc", "rank", "score")


@query
def per_document_cap(spark, sf):
    """Eight keyword hits a question, at most three of a document before others fill up."""
    l = ranked_lists(spark, sf).where("system = 'bm25'").select("query", "doc", "rank")
    p = passages(spark, sf).select(F.col("ord").alias("doc"), tx.doc_id(F.col("id")).alias("parent"))
    return fusion.capped_per_doc(l.join(p, "doc"), F.col("parent")).select("query", "doc", "place")


# --- Quality ---


@query
def ranking_metrics(spark, sf):
    return quality(spark, sf).select("system", "query", *[r6(c).alias(c) for c in ("ndcg", "recall24", "recall100", "rr")], "hit1", "first_rank")


@query
def metrics_by_system(spark, sf):
    m = quality(spark, sf).groupBy("system").agg(F.count(F.lit(1)).alias("questions"), *[r6(F.avg(c)).alias(c) for c in ("ndcg", "recall24", "recall100", "hit1", "rr")])
    return m


def _stratum(spark, sf):
    first = ranked_lists(spark, sf).where("system = 'bm25' AND rank = 1").select("query", "doc")
    return first.join(passages(spark, sf).select(F.col("ord").alias("doc"), "set_name"), "doc").select("query", "set_name")


@query
def macro_mean_by_set(spark, sf):
    m = quality(spark, sf).join(_stratum(spark, sf), "query")
    return metrics.macro_mean(m, "ndcg", "set_name", ["system"]).select("system", r6("macro_ndcg").alias("macro_ndcg"), "strata")


@query
def ndcg_in_list(spark, sf):
    return metrics.in_list_ndcg(ranked_lists(spark, sf), judged(spark, sf), by=["system"]).select("system", "query", r6("ndcg").alias("ndcg"))


@query
def rankable_questions(spark, sf):
    c = ranked_lists(spark, sf).where("system = 'bm25' AND rank <= 24").select("query", "doc")
    return compare.rankable(c, judged(spark, sf))


@query
def candidate_recall(spark, sf):
    c = rankable_questions(spark, sf)
    return c.agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col("rankable"), 1)).alias("rankable"), r6(F.avg(F.col("rankable").cast("double"))).alias("recall"))


@query
def stage_overlap(spark, sf):
    a, z = run_names(spark, sf)
    return compare.overlap(quality(spark, sf), "system", a, z, "query", (F.col("first_rank") > 0) & (F.col("first_rank") <= 3))


@query
def kept_gained_lost(spark, sf):
    return compare.kept_gained_lost(quality(spark, sf), "system", "bm25", "query")


@query
def judged_status(spark, sf):
    l = ranked_lists(spark, sf).where("rank <= 20").select("system", "query", "doc", "rank")
    return compare.judged_status(l, judged(spark, sf)).groupBy("system", "judged").agg(F.count(F.lit(1)).alias("n"))


@query
def recall_by_set(spark, sf):
    """Share of each set's relevant passages that a system's first 24 hold."""
    g = judged(spark, sf).where("grade > 0").join(passages(spark, sf).select(F.col("ord").alias("doc"), "set_name"), "doc")
    l = ranked_lists(spark, sf).where("rank <= 24").select("system", "query", "doc", F.lit(1).alias("f"))
    asked = ranked_lists(spark, sf).select("system", "query").distinct()
    both = asked.join(g, "query").join(l, ["system", "query", "doc"], "left")
    return both.groupBy("system", "set_name").agg(F.count(F.lit(1)).alias("relevant"), r6(F.avg(F.coalesce("f", F.lit(0)))).alias("recall24"))


@query
def questions_without_hits(spark, sf):
    """Questions that runs rank passages for, and how many of them the keyword leg ranks none for."""
    l = ranked_lists(spark, sf).select("system", "query").distinct()
    held = l.where("system = 'bm25'").select("query", F.lit(1).alias("held"))
    return l.where("system <> 'bm25'").join(held, "query", "left").groupBy("system").agg(F.count(F.lit(1)).alias("questions"), F.count(F.when(F.col("held").isNull(), 1)).alias("without_hits"))


@query
def best_other(spark, sf):
    """Score and rank of each list's best passage that isn't relevant."""
    good = judged(spark, sf).where("grade > 0").select("query", "doc")
    rest = ranked_lists(spark, sf).join(good, ["query", "doc"], "left_anti")
    return rest.groupBy("system", "query").agg(F.min(F.struct("rank", "doc", "score")).alias("b")).select("system", "query", "b.doc", "b.rank", r6("b.score").alias("score"))


@query
def rank_rule_pools(spark, sf):
    """Questions whose first relevant passage one run has first and the other third to tenth, and the other way round."""
    a, z = run_names(spark, sf)
    q = quality(spark, sf)
    both = q.where(F.col("system") == a).select("query", F.col("first_rank").alias("ra")).join(q.where(F.col("system") == z).select("query", F.col("first_rank").alias("rz")), "query")
    yes = lambda c: F.count(F.when(c, 1))
    return both.agg(yes((F.col("ra") == 1) & F.col("rz").between(3, 10)).alias("first_better"), yes((F.col("rz") == 1) & F.col("ra").between(3, 10)).alias("last_better"), yes((F.col("ra") == 1) & (F.col("rz") == 1)).alias("both_first"))


@query
def top_examples(spark, sf):
    """The first eight passages of every list with what they say and whether they are relevant."""
    p = passages(spark, sf).select(F.col("ord").alias("doc"), tx.snippet(F.col("text")).alias("snippet"), tx.section_path(F.col("section")).alias("path"))
    l = compare.judged_status(ranked_lists(spark, sf).where("rank <= 8"), judged(spark, sf))
    return l.join(p, "doc", "left").select("system", "query", "rank", "doc", "judged", "path", "snippet")


# --- Statistics ---


def _differences(spark, sf):
    return compare.paired(quality(spark, sf), "system", "bm25", "ndcg", ["query"])


def _interval(df):
    return df.select(*[c for c in df.columns if c not in ("mean", "low", "high")], *[r6(c).alias(c) for c in ("mean", "low", "high")])


@query
def bootstrap_mean_ci(spark, sf):
    return _interval(stats.interval_of_mean(quality(spark, sf).select("system", "query", "hit1"), ["system"], ["query"], "hit1"))


@query
def bootstrap_paired_ci(spark, sf):
    out = _interval(stats.paired_interval(_differences(spark, sf), ["system"], ["query"], "diff"))
    return out.withColumn("verdict", stats.verdict(F.col("low"), F.col("high")))


@query
def bootstrap_bonferroni(spark, sf):
    """Intervals adjusted for three comparisons, from 20,000 draws."""
    return _interval(stats.interval_of_mean(_differences(spark, sf), ["system"], ["query"], "diff", draws=20_000, alpha=0.05 / 3))


@query
def bootstrap_stratified(spark, sf):
    d = _differences(spark, sf).where(F.col("system") == run_names(spark, sf)[0]).join(_stratum(spark, sf), "query")
    return _interval(stats.stratified_interval(d, "set_name", ["query"], "diff"))


@query
def quantile_interpolated(spark, sf):
    rows = call_rows(spark, sf).dropDuplicates(["line_no"])
    return stats.order_statistics(rows, ["ranker"], "ms", {"p50": 0.5, "p95": 0.95}).select("ranker", "n", "stat", r6("value").alias("value"))


@query
def quantile_nearest_rank(spark, sf):
    rows = call_rows(spark, sf).dropDuplicates(["line_no"])
    return stats.order_statistics(rows, ["ranker"], "ms", {"p01": 0.01, "p50": 0.5, "p99": 0.99}, nearest=True).select("ranker", "n", "stat", r6("value").alias("value"))


@query
def random_stream(spark, sf):
    return spark.range(1000).select(F.col("id").alias("draw"), F.round(uniform(F.col("id"), 42), 12).alias("u"))


# --- Calibration ---

SOURCE = ["run", "set_name"]


def _distances(spark, sf, field, keys=SOURCE):
    return calibrate.flattened(table(spark, sf, "setdata"), keys if set(keys) >= {"run", "set_name", "probe"} else ["run", "set_name", "probe"], field).select(*keys, "value")


@query
def distance_histogram(spark, sf):
    return calibrate.histogram(_distances(spark, sf, "random"), SOURCE)


@query
def histogram_modes(spark, sf):
    return calibrate.fullest_bin(distance_histogram(spark, sf), SOURCE)


@query
def noise_floor_levels(spark, sf):
    random = _distances(spark, sf, "random")
    floors = calibrate.floors(random, SOURCE)
    kept = calibrate.share_below(_distances(spark, sf, "relevant"), floors, SOURCE, "keeps")
    return kept.select(*SOURCE, "level", r6("cutoff").alias("cutoff"), r6("keeps").alias("keeps"))


@query
def floor_transfer_loo(spark, sf):
    out = calibrate.leave_one_out(_distances(spark, sf, "random"), _distances(spark, sf, "relevant"), ["run"], "set_name")
    return out.select(*SOURCE, "level", *[r6(c).alias(c) for c in ("cutoff", "keeps", "lets")])


@query
def distance_profile(spark, sf):
    """Quantiles of the questions' median relevant distances, per run: each question weighs the same."""
    rows = table(spark, sf, "setdata").select("run", "set_name", "probe", "question", "random", "relevant").distinct()
    per = rows.withColumn("_q", F.xxhash64("*")).select("run", "_q", F.explode("relevant").alias("value")).where(F.col("value").between(0, 2) & ~F.isnan("value"))
    medians = stats.order_statistics(per, ["run", "_q"], "value", {"m": 0.5}, nearest=True).select("run", "value")
    out = stats.order_statistics(medians, ["run"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}, nearest=True)
    return out.select("run", "n", "stat", r6("value").alias("value"))


@query
def cutoff_in_force(spark, sf):
    """What the distances in force let through and keep, and whether that is half to double the target share."""
    c = table(spark, sf, "searchcutoff").where("question IS NOT NULL AND random_share IS NOT NULL").select("run", F.lit("question").alias("level"), F.col("question").alias("cutoff"), F.col("random_share").alias("aim")).distinct()
    out = calibrate.transfer(_distances(spark, sf, "random", ["run"]), _distances(spark, sf, "relevant", ["run"]), c, ["run"])
    return out.select("run", "level", "aim", "cutoff", r6("lets").alias("lets"), r6("keeps").alias("keeps"), "within")


def _levels(spark, sf, keys):
    """Levels from distances of passages to titles' passages of another site in the same language; ``label`` is the title's
    style."""
    v = table(spark, sf, "vectors").where(vc.usable(F.col("vec"), 64)).dropDuplicates(["ord"]).select("ord", "vec")
    p = passages(spark, sf).select(F.col("ord").alias("key"), F.substring_index("sample", "/", 1).alias("lang"), F.col("sample").alias("site"), "title").join(v.withColumnRenamed("ord", "key"), "key")
    q = p.where((F.col("key") % 20 == 0) & (F.coalesce("title", F.lit("")) != "")).withColumn("label", tx.query_style(F.col("title")))
    probs = {k: calibrate.LEVELS[k] for k in ("balanced", "loose")}
    found = calibrate.levels_of(nearest.unrelated_statistics(q, p, keys, probs, durable), keys)
    return found.select(*[F.col(k).alias("style" if k == "label" else k) for k in keys], *[r6(c).alias(c) for c in ("strict", "balanced", "loose")])


@query
def calibration_levels(spark, sf):
    """Levels by query style."""
    return _levels(spark, sf, ["label"])


@query
def calibration_levels_by_language(spark, sf):
    return _levels(spark, sf, ["lang", "label"])


# --- The call log ---


@query
def latest_calls(spark, sf):
    return calls.counted(call_rows(spark, sf)).select("line_no", *calls.CALL, "error", "attempts")


@query
def latency_percentiles(spark, sf):
    l = calls.latency(calls.counted(call_rows(spark, sf)), ["ranker"])
    return l.select("ranker", "n", r6("p50").alias("p50"), r6("p95").alias("p95"))


@query
def call_totals(spark, sf):
    t = calls.totals(calls.counted(call_rows(spark, sf)), ["ranker"])
    return t.select("ranker", "calls", "failures", "untimed_retries", "coverage_recorded", "models", *[r6(c).alias(c) for c in ("failure_rate", "reasoning_rate", "full_coverage", "input_tokens", "output_tokens")])


@query
def call_throughput(spark, sf):
    return calls.throughput(calls.counted(call_rows(spark, sf)), ["ranker"]).select("ranker", r6("tokens_per_second").alias("tokens_per_second"))


@query
def top_tie_rate(spark, sf):
    return calls.tie_rate(calls.counted(call_rows(spark, sf)), ["ranker"]).select("ranker", "scored", r6("tie_rate").alias("tie_rate"))


@query
def ordered_passages(spark, sf):
    return calls.ordered(calls.counted(call_rows(spark, sf)), ["line_no"])


@query
def first_choice_stability(spark, sf):
    rows = calls.counted(call_rows(spark, sf))
    first = calls.ordered(rows, ["line_no"]).where("rank = 1").select("line_no", F.col("passage").alias("first"))
    return calls.stability(rows.join(first, "line_no"), "first", ["ranker"]).select("ranker", "questions", r6("stability").alias("stability"))


@query
def resume_pending(spark, sf):
    return calls.pending(call_rows(spark, sf))


def _call_ranks(spark, sf):
    rows = calls.counted(call_rows(spark, sf)).where("order_ids IS NOT NULL AND scores IS NOT NULL")
    gold = judged(spark, sf).where("grade > 0").join(passages(spark, sf).select(F.col("ord").alias("doc"), F.col("id").alias("passage")), "doc").select(F.col("query").alias("question"), "passage", F.lit(1).alias("g"))
    placed = calls.ordered(rows, ["line_no", "ranker", "machine", "question"]).join(gold, ["question", "passage"], "left")
    return placed.groupBy("line_no", "ranker", "machine", "question").agg(F.coalesce(F.min(F.when(F.col("g") == 1, F.col("rank"))), F.lit(0)).alias("first"))


@query
def ranker_quality(spark, sf):
    """Hit@1, Hit@8 and reciprocal rank by ranker: repeats are averaged first, then questions."""
    r = _call_ranks(spark, sf).select("ranker", "question", metrics.hit_at(F.col("first"), 1).alias("hit1"), metrics.hit_at(F.col("first"), 8).alias("hit8"), metrics.reciprocal(F.col("first")).alias("mrr"))
    per = r.groupBy("ranker", "question").agg(*[F.avg(c).alias(c) for c in ("hit1", "hit8", "mrr")])
    return per.groupBy("ranker").agg(F.count(F.lit(1)).alias("questions"), *[r6(F.avg(c)).alias(c) for c in ("hit1", "hit8", "mrr")])


@query
def ranker_quality_by_category(spark, sf):
    """The same by the language of the first keyword hit's set."""
    r = _call_ranks(spark, sf).join(_stratum(spark, sf).withColumnRenamed("query", "question"), "question")
    r = r.select("ranker", tx.lang_of(F.col("set_name")).alias("category"), metrics.hit_at(F.col("first"), 1).alias("hit1"), metrics.reciprocal(F.col("first")).alias("mrr"))
    return r.groupBy("ranker", "category").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("hit1")).alias("hit1"), r6(F.avg("mrr")).alias("mrr"))


@query
def parsed_answers(spark, sf):
    rows = call_rows(spark, sf).dropDuplicates(["line_no"]).where("raw IS NOT NULL")
    n = F.coalesce(F.size("scores"), "covered")
    stop = F.when(F.col("error").contains("context"), "length")
    read = rows.select("line_no", F.when(n >= 0, n).otherwise(F.col("covered")).alias("n"), judging.read_answer(F.col("raw"), F.when(n >= 0, n).otherwise(F.col("covered")), stop).alias("r"))
    return read.select("line_no", "n", "r.scored", F.size("r.scores").alias("read"), r6(F.aggregate("r.scores", F.lit(0.0), lambda a, x: a + x)).alias("sum_scores"))


# --- Text ---


@query
def query_styles(spark, sf):
    return passages(spark, sf).select("ord", tx.query_style(F.col("title")).alias("style"))


@query
def query_cutoffs(spark, sf):
    c = F.broadcast(table(spark, sf, "searchcutoff").select("run", "shortq", "question").distinct())
    p = titles(spark, sf).crossJoin(c)
    return p.select("query", "run", tx.cutoff_for(F.col("text"), F.col("shortq"), F.col("question")).alias("cutoff"))


@query
def snippets(spark, sf):
    return passages(spark, sf).select("ord", tx.snippet(F.col("text")).alias("snippet"))


@query
def short_excerpts(spark, sf):
    return passages(spark, sf).select("ord", tx.excerpt(F.col("text")).alias("excerpt"))


@query
def seen_texts(spark, sf):
    p = passages(spark, sf)
    return p.select("ord", F.length(tx.seen_from_start(F.col("text"))).alias("seen"), F.length(tx.document_text(F.col("title"), F.col("section"), F.col("text"))).alias("whole"), (F.length("text") > 1200).alias("past"))


@query
def scripts(spark, sf):
    d = table(spark, sf, "documents").dropDuplicates(["doc_id"])
    return d.select("doc_id", tx.script(F.col("text")).alias("script"))


@query
def clean_documents(spark, sf):
    d = table(spark, sf, "documents").dropDuplicates(["doc_id"])
    clean = tx.without_nul(F.col("text"))
    return d.select("doc_id", F.length(clean).alias("chars"), F.md5(clean).alias("digest"), F.length(tx.shortened(clean)).alias("shortened"))


@query
def name_parts(spark, sf):
    p = passages(spark, sf)
    return p.select("ord", tx.doc_id(F.col("id")).alias("doc"), tx.lang_of(F.col("set_name")).alias("lang"), tx.section_path(F.col("section")).alias("path"), tx.title_of(F.concat("id", F.lit(".txt"))).alias("name"), tx.page_link(F.col("id")).alias("link"))


@query
def run_parts(spark, sf):
    r = table(spark, sf, "ranked").select(F.replace(F.col("run"), F.lit("/"), F.lit(":")).alias("spec")).distinct().select("spec", tx.parse_run(F.col("spec")).alias("p"))
    return r.select("spec", "p.backend", "p.model", "p.raw", tx.run_key(F.col("p.backend"), F.col("p.model"), F.col("p.raw")).alias("key"))


@query
def matched_title_words(spark, sf):
    p = passages(spark, sf).where("title IS NOT NULL AND text IS NOT NULL")
    w = tx.matched_words(F.col("title"), F.col("text"))
    return p.select("ord", F.array_join(w, " ").alias("matched"), (~F.arrays_overlap(tx.tokens(F.col("title")), tx.tokens(F.col("text")))).alias("disjoint"))


def _prompts(spark, sf, candidates, chars):
    p = passages(spark, sf).select(F.col("ord").alias("doc"), "title", "section", tx.seen_from_start(F.col("text"), chars).alias("text"))
    l = ranked_lists(spark, sf).where((F.col("system") == "bm25") & (F.col("rank") <= candidates)).select("query", "doc", "rank").join(p, "doc")
    one = l.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "section", "text"))).alias("c"))
    return one.select("query", F.md5(judging.judge_prompt(F.col("query"), F.col("c"))).alias("digest"), F.length(judging.judge_prompt(F.col("query"), F.col("c"))).alias("chars"))


@query
def judge_prompts(spark, sf):
    """The prompt of each question's first three keyword hits, 200 characters each, as its SQL has it."""
    return _prompts(spark, sf, 3, 200)


@query
def judge_prompts_all(spark, sf):
    """The prompt of each question's 24 candidates, as judges read them."""
    return _prompts(spark, sf, 24, judging.SNIPPET)


@query
def titles_nearest_median(spark, sf):
    """Plain titles, those of median length first."""
    p = passages(spark, sf).where("title <> ''").select("ord", "title", F.length("title").cast("double").alias("chars"))
    plain = (F.size(F.split(F.trim("title"), r"\s+")) <= 9) & ~F.col("title").rlike(r"\d")
    return compare.near_median(p, "chars", "title", "ord", plain).select("ord", "chars", "median", "place")


# --- Python-backed ---


def _candidates(spark, sf):
    p = passages(spark, sf).select(F.col("ord").alias("doc"), "title", "text")
    l = ranked_lists(spark, sf).where("system = 'bm25' AND rank <= 24").select(F.col("query").alias("question"), "doc", F.col("rank").alias("pos"))
    first = l.where("pos = 1").join(p.select("doc", "title"), "doc").select("question", F.coalesce("title", F.lit("")).alias("query"))
    return l.join(p.select("doc", "text"), "doc").join(first, "question").select("question", "query", "pos", "text")


@query
def excerpt_windows(spark, sf):
    return judging.excerpt_candidates(_candidates(spark, sf))


@query
def excerpt_moves(spark, sf):
    """The share of long candidates whose excerpt isn't their start."""
    both = excerpt_windows(spark, sf).join(_candidates(spark, sf), ["question", "pos"])
    return both.where(F.length("text") > 1200).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("excerpt").startswith("… ").cast("double")).alias("moved"))


@query
def offline_ranking(spark, sf):
    return rankers.rank_all(_candidates(spark, sf), rankers.TermOverlap()).drop("ms", "totalms")


@query
def shuffled_sample(spark, sf):
    return sampling.shuffled_first(passages(spark, sf).select("set_name", "ord"), "set_name", "ord", 40, 20260928)


@query
def random_passages(spark, sf):
    """64 passages per question, none of them relevant to it, replayed from one generator."""
    q = ranked_lists(spark, sf).select("query").distinct()
    bad = judged(spark, sf).where("grade > 0").select("query", F.col("doc").alias("ord"))
    n = passages(spark, sf).agg(F.max("ord").alias("n")).first()["n"] or 0
    return sampling.random_others(q, bad, n + 1, 64)


def _flagship(spark, sf):
    return rrf_hybrid_topk(spark, sf)
