"""Queries that compare systems, legs and collections; registered with the others, over the same tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import text as tx
from quillmark.functions import vector as vc
from quillmark.operators import calibrate, calls, compare, fusion, lexical, metrics, nearest, stats
from quillmark.plans.queries import _bm25, _call_ranks, _interval, _legs, _ranked, calibration_levels_by_language, judged, passages, quality, query, r6, ranked_lists, run_names
from quillmark.session import durable, table

#: Passages a leg takes into a fusion, and the similarity a run's passage needs to be taken.
LEG, SIMILAR = 96, 0.2


# --- Fusion of cut legs ---


def _cut_legs(spark, sf):
    """The best LEG passages of every leg, those of runs only where similar enough; ranks are those before the cutoff."""
    legs = _legs(spark, sf)
    w = Window.partitionBy("system", "query").orderBy(F.desc("score"), "doc")
    best = legs.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= LEG)
    return best.where((F.col("system") == "bm25") | (F.col("score") >= SIMILAR)).drop("_n")


def _fused(spark, sf, weights):
    legs = durable(_cut_legs(spark, sf), "legs")
    runs = legs.where("system <> 'bm25'").select(F.col("system").alias("run"), "query", "doc", "rank")
    keyword = legs.where("system = 'bm25'").select("query", "doc", "rank").join(runs.select("run", "query").distinct(), "query")
    # Both legs' shares are added up once per passage; the weights come after.
    share = lambda df, name: df.select("run", "query", "doc", (1 / (fusion.CONSTANT + F.col("rank"))).alias(name))
    both = share(keyword, "k").unionByName(share(runs, "s"), allowMissingColumns=True).groupBy("run", "query", "doc").agg(F.sum("k").alias("k"), F.sum("s").alias("s"))
    each = both.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    score = F.round(F.col("weight") * F.coalesce("k", F.lit(0.0)) + F.coalesce("s", F.lit(0.0)), 9)
    return fusion.fused_top(each.select("run", "weight", "query", "doc", score.alias("score")), 24, by=["run", "weight"])


@query
def rrf_cut_legs(spark, sf):
    """Fusion of legs of 96 passages, with a similarity cutoff on the runs' legs."""
    return _fused(spark, sf, [1.0]).select("run", "query", "doc", "score", "rank")


@query
def fusion_half_against_equal(spark, sf):
    """Per run, what half the weight for the keyword leg changes in nDCG@10."""
    m = metrics.ranking_metrics(_fused(spark, sf, [1.0, 0.5]), judged(spark, sf), by=["run", "weight"])
    wide = m.groupBy("run", "query").agg(F.max(F.when(F.col("weight") == 1.0, F.col("ndcg"))).alias("e"), F.max(F.when(F.col("weight") == 0.5, F.col("ndcg"))).alias("h"))
    diff = F.round(F.col("h") - F.col("e"), 9)
    yes = lambda c: F.count(F.when(c, 1))
    out = wide.groupBy("run").agg(F.count(F.lit(1)).alias("questions"), r6(F.avg("e")).alias("equal"), r6(F.avg("h")).alias("half"), yes(diff > 0).alias("better"), yes(diff < 0).alias("worse"))
    return out


# --- Keyword search ---


@query
def keyword_variants(spark, sf):
    """How often a title finds its own passage first, and among ten, by text, by title and by the better of both."""
    text, title = durable(_bm25(spark, sf), "by_text"), durable(_bm25(spark, sf, "title"), "by_title")
    variants = {"text": text, "title": title, "best": lexical.best_column([text, title])}
    parts = [_ranked(df).where(F.col("query") == F.col("doc")).select(F.lit(name).alias("variant"), "rank") for name, df in variants.items()]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return found.groupBy("variant").agg(F.count(F.when(F.col("rank") == 1, 1)).alias("first"), F.count(F.lit(1)).alias("among_ten"))


@query
def candidate_bm25(spark, sf):
    """A question's 24 keyword candidates, their texts cut to 400 characters, ranked anew over the candidates alone; the
    question's text is the title of its first candidate."""
    # Texts are cut before repeated rows are taken out. What moves with a candidate is the question's terms, then their counts,
    # never its words; candidates of a null question meet no terms in SQL. Spark takes word lists for far smaller than they are
    # and would broadcast them through the driver, so both joins are merge joins.
    p = table(spark, sf, "passages").select("ord", "title", F.substring(F.coalesce("text", F.lit("")), 1, 400).alias("text")).dropDuplicates(["ord"])
    titles = p.select(F.col("ord").alias("first"), F.array_distinct(tx.tokens(F.coalesce("title", F.lit("")))).alias("terms")).where(F.size("terms") > 0)
    texts = p.select(F.col("ord").alias("doc"), tx.tokens(F.col("text")).alias("w"))
    c = ranked_lists(spark, sf).where("system = 'bm25' AND rank <= 24 AND query IS NOT NULL")
    c = c.withColumn("first", F.first("doc").over(Window.partitionBy("system", "query").orderBy(F.desc("score"), F.desc("doc"))))
    c = c.select("query", "doc", "first").join(titles.hint("merge"), "first").join(texts.hint("merge"), "doc")
    counts = F.transform("terms", lambda t: F.size("w") - F.size(F.array_remove("w", t)))
    c = c.select("query", "doc", F.size("w").alias("length"), F.when(F.arrays_overlap("terms", "w"), counts).alias("counts"))
    of = Window.partitionBy("query")
    c = c.withColumn("docs", F.count(F.lit(1)).over(of)).withColumn("mean_length", F.avg("length").over(of))
    tf = c.select("query", "doc", "length", "docs", "mean_length", F.posexplode("counts").alias("term", "tf")).where("tf > 0")
    tf = tf.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query", "term")))
    k1, b = 0.9, 0.4
    gain = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return _ranked(tf.groupBy("query", "doc").agg(F.sum(gain).alias("score")), 24)


@query
def positive_hits(spark, sf):
    """Per question, keyword hits with a score above 0 and the others, which no list takes."""
    s = ranked_lists(spark, sf).where("system = 'bm25'")
    return s.groupBy("query").agg(F.count(F.when(F.col("score") > 0, 1)).alias("positive"), F.count(F.when(F.col("score") <= 0, 1)).alias("dropped"))


# --- Vectors ---


@query
def knn_excluding_own_document(spark, sf):
    """The ten nearest passages of other documents, for every passage whose ord is divisible by 20."""
    v = table(spark, sf, "vectors").where(vc.usable(F.col("vec"), 64)).dropDuplicates(["ord"]).select("ord", "vec")
    rows = v.join(passages(spark, sf).select("ord", tx.doc_id(F.col("id")).alias("parent")), "ord")
    found = nearest.exact_top_k(rows.where("ord % 20 = 0"), rows, "ord", "vec", 10, apart="parent")
    return found.select("query", "key", "rank", r6("distance").alias("distance"))


_CROWDED: dict = {}


def crowded(spark, hidden):
    """A stored corpus of 97,000 passages anywhere, ``hidden`` unreadable ones around the query, and five readable ones further
    out: with distances to the query's vector, and its readable rows. It is built once for an application."""
    at = (spark.sparkContext.applicationId, hidden)
    if at not in _CROWDED:
        rows, q = nearest.crowded_corpus(spark, 384, 97_000, hidden, 5)
        _CROWDED[at] = durable(rows, "crowded"), list(q.first()["q"])
    rows, q = _CROWDED[at]
    return nearest.distances_to(rows, q), nearest.readable("readers", ["liv", "everyone"])


def _counted(searches):
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("search"), "rows") for name, df in searches.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def crowded_searches(spark, sf):
    """Rows that each kind of search finds where 3,000 unreadable passages are nearer than the five readable ones."""
    d, may = crowded(spark, 3000)
    return _counted(
        {
            "exact": d.where(may & (F.col("distance") < 0.6)),
            "filter after 40": nearest.budgeted(d, may, 40, 10),
            "filter after 1000": nearest.budgeted(d, may, 1000, 10),
            "cutoff outside": nearest.outside(d.where(may), 0.6, 10),
            "cutoff inside": nearest.inside(d.where(may), 0.6, 10),
            "cutoff outside, 320": nearest.outside(d.where(may), 0.6, 320),
            "cutoff inside, 320": nearest.inside(d.where(may), 0.6, 320),
        }
    )


@query
def crowded_scan_budgets(spark, sf):
    """The same with 33,000 unreadable passages nearer: a scan ends at its rows, or sooner at the rows its memory holds."""
    d, may = crowded(spark, 33_000)
    near = d.where(F.col("distance") < 0.6)
    rank = nearest.first_visible(d, may).select(F.lit("first readable").alias("search"), F.col("rank").alias("rows"))
    found = _counted(
        {
            "20,000 rows": nearest.budgeted(near, may, 20_000, 10, memory_budget=25_000),
            "100,000 rows": nearest.budgeted(near, may, 100_000, 10, memory_budget=25_000),
            "100,000 rows, 8 x memory": nearest.budgeted(near, may, 100_000, 10, memory_budget=200_000),
            "exact": near.where(may),
        }
    )
    return found.unionByName(rank)


# --- Quality ---


@query
def paired_hit_intervals(spark, sf):
    """First-place hits of the first and the last run with their intervals, and that of the paired difference."""
    a, z = run_names(spark, sf)
    q = durable(quality(spark, sf).where(F.col("system").isin(a, z)).select("system", "query", "hit1"), "hits")
    each = stats.interval_of_mean(q, ["system"], ["query"], "hit1")
    diff = stats.paired_interval(compare.paired(q, "system", a, "hit1", ["query"]), ["system"], ["query"], "diff").withColumn("system", F.lit("difference"))
    return _interval(each.unionByName(diff))


@query
def recall_by_script(spark, sf):
    """Share of relevant passages in a system's first 24, by the script of their text."""
    p = passages(spark, sf).select(F.col("ord").alias("doc"), F.when(F.substring_index("sample", "/", 1) == "zh", tx.script(F.col("text"))).otherwise("other").alias("script"))
    g = judged(spark, sf).where("grade > 0").join(p, "doc")
    lists = durable(ranked_lists(spark, sf), "lists")
    asked = lists.select("system", "query").distinct()
    hit = lists.where("rank <= 24").select("system", "query", "doc", F.lit(1).alias("f"))
    both = asked.join(g, "query").join(hit, ["system", "query", "doc"], "left")
    return both.groupBy("system", "script").agg(F.count(F.lit(1)).alias("relevant"), r6(F.avg(F.coalesce("f", F.lit(0)))).alias("recall24"))


@query
def ranker_hits_of_all_questions(spark, sf):
    """Hit@1 by ranker over all questions that any ranker was asked; one it has no ranking of counts as a miss."""
    r = _call_ranks(spark, sf).select("ranker", "question", metrics.hit_at(F.col("first"), 1).alias("hit1"))
    per = r.groupBy("ranker", "question").agg(F.avg("hit1").alias("hit1")).groupBy("ranker").agg(F.count(F.lit(1)).alias("ranked"), F.sum("hit1").alias("hits"))
    asked = calls.counted(table(spark, sf, "calls")).agg(F.count_distinct("question").alias("questions"))
    return per.crossJoin(F.broadcast(asked)).select("ranker", "ranked", "questions", r6(F.col("hits") / F.col("questions")).alias("hit1"))


# --- Distances and texts ---


@query
def own_language_transfer(spark, sf):
    """Each set held to the levels measured in its own language. Questions have the style that a table of styles gives them,
    a default where it has none. The tables here hold no texts of questions, so all take the default, the style of the titles
    that the levels are measured with."""
    levels = durable(calibration_levels_by_language(spark, sf), "levels")
    cut = levels.select("lang", "style", F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in ("strict", "balanced", "loose")]), F.array("strict", "balanced", "loose"))).alias("level", "cutoff"))
    styles = spark.createDataFrame([], "question string, style string")
    rows = table(spark, sf, "setdata").select("run", "set_name", "probe", "question", "random", "relevant").distinct().join(styles, "question", "left")
    rows = rows.withColumn("style", F.coalesce("style", F.lit("short"))).withColumn("lang", tx.lang_of(F.col("set_name")))

    def share(field, name):
        v = rows.select("run", "set_name", "lang", "style", F.explode(field).alias("value")).where(F.col("value").between(0, 2) & ~F.isnan("value"))
        return v.join(F.broadcast(cut), ["lang", "style"]).groupBy("run", "set_name", "level").agg(r6(F.avg((F.col("value") < F.col("cutoff")).cast("double"))).alias(name))

    return share("random", "lets").join(share("relevant", "keeps"), ["run", "set_name", "level"], "left")


@query
def random_profile(spark, sf):
    """Quantiles of random distances per run, by nearest rank."""
    v = calibrate.flattened(table(spark, sf, "setdata"), ["run", "set_name", "probe"], "random").select("run", "value")
    out = stats.order_statistics(v, ["run"], "value", {"p001": 0.001, "p01": 0.01, "p05": 0.05, "p50": 0.5}, nearest=True)
    return out.select("run", "n", "stat", r6("value").alias("value"))


@query
def zipped_random_pairs(spark, sf):
    """Random distances of the first and the last run, the n-th with the n-th of the same set, probe and question."""
    a, z = table(spark, sf, "setdata").agg(F.min("run"), F.max("run")).first()
    rows = table(spark, sf, "setdata").select("run", "set_name", "probe", "question", "random", "relevant").distinct()
    side = lambda run, name: rows.where(F.col("run") == run).groupBy("set_name", "probe", "question").agg(F.min("random").alias(name))
    both = side(a, "x").join(side(z, "y"), ["set_name", "probe", "question"]).select("set_name", F.explode(F.arrays_zip("x", "y")).alias("p")).select("set_name", "p.x", "p.y")
    ok = lambda c: F.col(c).between(0, 2) & ~F.isnan(c)
    return both.where(ok("x") & ok("y")).groupBy("set_name").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("x") - F.col("y"))).alias("mean_difference"))


@query
def style_counts(spark, sf):
    return passages(spark, sf).groupBy(tx.query_style(F.col("title")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query
def past_snippet(spark, sf):
    """Per set, passages, the share whose text goes past the snippet, and the median length by nearest rank."""
    p = passages(spark, sf).where("text IS NOT NULL").select("set_name", F.length("text").cast("double").alias("chars"))
    share = p.groupBy("set_name").agg(r6(F.avg((F.col("chars") > 1200).cast("double"))).alias("past"))
    median = stats.order_statistics(p, ["set_name"], "chars", {"m": 0.5}, nearest=True)
    return median.join(share, "set_name").select("set_name", "n", "past", F.col("value").alias("median"))


@query
def relevant_past_snippet(spark, sf):
    """Judged passages by relevance: the share whose text goes past the snippet."""
    p = passages(spark, sf).select(F.col("ord").alias("doc"), (F.length("text") > 1200).cast("double").alias("past"))
    return judged(spark, sf).join(p, "doc").groupBy((F.col("grade") > 0).alias("relevant")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("past")).alias("past"))
