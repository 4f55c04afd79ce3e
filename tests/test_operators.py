"""Operators against known values, brute force and the published outcomes of the small fixtures."""

import json
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.functions.numeric import uniforms
from quillmark.operators import calibrate, calls, compare, fusion, lexical, lists, metrics, nearest, rankers, sampling, stats
from quillmark.plans import queries as plans
from quillmark.session import durable


def lists_of(spark, **named):
    return spark.createDataFrame([(q, d, i + 1) for q, ds in named.items() for i, d in enumerate(ds)], "query string, doc int, rank int")


def judged(spark, **named):
    return spark.createDataFrame([(q, d, g) for q, gs in named.items() for d, g in gs.items()], "query string, doc int, grade int")


def test_graded_metrics(spark):
    m = {r["query"]: r for r in metrics.ranking_metrics(lists_of(spark, a=[7, 1, 2], b=[1, 7], c=[1, 2], d=[1, 2, 3], e=[1], f=[4, 2, 1]), judged(spark, a={7: 1}, b={7: 1}, c={7: 1}, d={1: 1, 2: 0, 3: 1}, f={1: 1, 2: 1, 3: 0}), recalls=(2, 3)).collect()}
    assert m["a"].ndcg == 1 and m["b"].ndcg == pytest.approx(1 / math.log2(3)) and m["c"].ndcg == 0 and m["e"].ndcg == 0
    assert m["d"].ndcg == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert m["f"].recall2 == 0.5 and m["f"].recall3 == 1 and m["f"].hit1 == 0 and m["a"].hit1 == 1
    assert m["f"].first_rank == 2 and m["f"].rr == 0.5 and m["c"].first_rank == 0 and m["c"].rr == 0


def test_in_list_metrics(spark):
    m = {r["query"]: r.ndcg for r in metrics.in_list_ndcg(lists_of(spark, a=[1, 2, 9], b=[9, 1], c=[9]), judged(spark, a={1: 1, 2: 1, 5: 1}, b={1: 2}, c={1: 1})).collect()}
    assert m["a"] == 1 and m["b"] == pytest.approx(1 / math.log2(3)) and m["c"] == 0
    one = metrics.in_list_ndcg(lists_of(spark, a=[9, 1]), judged(spark, a={1: 1}), k=1).first()
    assert one.ndcg == 0


def test_means(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 3.0), ("a", "y", 8.0), ("b", "x", None)], "s string, t string, v double")
    got = {r.s: r.macro_v for r in metrics.macro_mean(df, "v", "t", ["s"]).collect()}
    assert got == {"a": 5.0, "b": None}
    assert metrics.two_level_mean(df.where("s = 'a'"), "v", ["t"], ["s"]).first().v == 5.0


def test_fusion(spark):
    leg = lambda rows: fusion.ranked_leg(spark.createDataFrame([("q", *r) for r in rows], "query string, doc int, score double"))
    assert [r["rank"] for r in leg([(1, 0.9), (2, 0.5), (3, 0.5), (4, 0.1)]).orderBy("doc").collect()] == [1, 2, 2, 4]
    top = fusion.fused_top(fusion.reciprocal_ranks([(leg([(1, 9.0), (2, 8.0)]), 1.0), (leg([(3, 0.9), (2, 0.8)]), 1.0)]), 3)
    assert [r.doc for r in top.orderBy("rank").collect()] == [2, 1, 3]
    tied = fusion.fused_top(fusion.reciprocal_ranks([(leg([(5, 1.0), (4, 1.0)]), 1.0)]), 2)
    assert [r.doc for r in tied.orderBy("rank").collect()] == [4, 5]
    sweep = fusion.weight_sweep(leg([(1, 1.0)]), leg([(2, 1.0)]), [1.0, 0.0], 5)
    assert {(r.weight, r.doc) for r in sweep.collect()} == {(w, d) for w in (1.0, 0.0) for d in (1, 2)}
    capped = fusion.capped_per_doc(spark.createDataFrame([("q", f"a#{i}", i) for i in range(1, 6)] + [("q", "b#1", 6)], "query string, doc string, rank int"), text.doc_id(F.col("doc")), 3, 5)
    assert [r.doc for r in capped.orderBy("place").collect()] == ["a#1", "a#2", "a#3", "b#1", "a#4"]


def test_scores_leak(spark):
    got = {(r.step, r.word): r.score for r in plans.bm25_leak_scores(spark, "").collect()}
    want = {1: (7.07, 7.07, 6.34), 2: (6.34, 7.08, 6.34), 3: (4.98, 7.09, 6.35)}
    assert got == {(s, w): x for s, xs in want.items() for w, x in zip(("layoff", "marker1", "marker2"), xs)}
    r = plans.bm25_leak_estimate(spark, "").first()
    assert (r.documents, r.holding, r.readable) == (199, 6, 1)
    assert [(r.step, r.pos, r.id) for r in plans.bm25_order_flip(spark, "").orderBy("step", "pos").collect()] == [(1, 1, 201), (1, 2, 202), (2, 1, 201), (2, 2, 202), (3, 1, 202), (3, 2, 201)]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "k int, t string")
    q = lexical.query_terms(spark.createDataFrame([(9, "a a b zzz"), (8, None)], "k int, t string"), "k", "t")
    got = {(r["query"], r.doc): r.score for r in lexical.bm25(lexical.postings(docs, "k", "t"), lexical.corpus_facts(docs, "t"), q).collect()}
    mean = 5 / 4
    s = lambda n, tf, length: math.log(1 + (4 - n + 0.5) / (n + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * length / mean))
    assert got == {(9, 1): pytest.approx(s(1, 2, 3) + s(2, 1, 3)), (9, 2): pytest.approx(s(2, 1, 2))}
    left = lexical.excluding(spark.createDataFrame([(9, 1, 1.0), (9, 2, 2.0)], "query int, doc int, score double"), spark.createDataFrame([(9, 2)], "query int, doc int"))
    assert [r.doc for r in left.collect()] == [1]


def test_filtered_search_behind_a_crowd(spark):
    """Late filtering finds nothing, reading first finds all five: the shape of the published outcomes."""
    chunks, query = nearest.crowded_corpus(spark, 384, 600, 300, 5)
    d = nearest.distances(chunks, query).cache()
    mine = nearest.readable("readers", ["liv", "everyone"])
    assert d.where(mine & (F.col("distance") < 0.6)).groupBy("topic").count().collect() == [("team notes", 5)]
    assert nearest.budgeted(d, mine, 40, 10).count() == 0
    assert nearest.budgeted(d, mine, 20_000, 10).where("distance < 0.6").count() == 5
    assert nearest.budgeted(d, mine, 20_000, 10, memory_budget=100).count() == 0
    assert nearest.inside(d.where(mine), 0.6, 10).count() == 5 and nearest.outside(d.where(mine), 0.6, 10).count() == 5
    assert nearest.outside(d.where(mine), 0.6, 3).count() == 3
    assert nearest.first_visible(d, mine).first()["rank"] == 301


def test_exact_search(spark):
    rng = np.random.default_rng(1)
    x = {i: rng.standard_normal(8) for i in range(70)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in x.items()], "id long, v array<double>").repartition(3)
    got = {(r["query"], r["rank"]): r.key for r in nearest.exact_top_k(df.where("id < 9"), df, "id", "v", 4, block=5).collect()}
    for q in range(9):
        order = sorted(x, key=lambda o: (round(1 - float(x[q] @ x[o]) / np.linalg.norm(x[q]) / np.linalg.norm(x[o]), 9), o))
        assert [got[(q, r)] for r in range(1, 5)] == order[:4]
    assert nearest.exact_top_k(df.limit(0), df, "id", "v", 4).count() == 0


def test_statistics_of_unrelated_pairs(spark):
    rng = np.random.default_rng(11)
    items = [(i, "en" if i % 3 else "de", str(i % 4), "short" if i % 2 else "long", rng.standard_normal(6).tolist()) for i in range(90)] + [(95, None, "1", "short", [1.0] * 6)]
    df = spark.createDataFrame(items, "key long, lang string, site string, label string, vec array<double>").repartition(3)
    asked = lambda i: i < 30
    probs = {"low": 0.05, "mid": 0.5}
    for keys in (["label"], ["lang", "label"]):
        want = {}
        for i, lang, site, label, v in items:
            for j, other, elsewhere, _, w in items if asked(i) else ():
                if lang is not None and lang == other and site != elsewhere:
                    want.setdefault((lang, label) if "lang" in keys else (label,), []).append(1 - np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))
        got = {(*(r[k] for k in keys), r.stat): r for r in nearest.unrelated_statistics(df.where("key < 30"), df, keys, probs, durable, size=7, bins=8).collect()}
        assert len(got) == 2 * len(want)
        for k, values in want.items():
            for stat, p in probs.items():
                r = got[(*k, stat)]
                assert r.n == len(values) and r.least == pytest.approx(min(values), abs=1e-9)
                assert r.value == pytest.approx(sorted(values)[int(p * (len(values) - 1) + 0.5)], abs=1e-9)
    assert nearest.unrelated_statistics(df.limit(0), df, ["label"], probs, durable).count() == 0


def test_readable_with_nulls(spark):
    df = spark.createDataFrame([(["a", None],), ([None],), ([],), (None,), (["b"],)], "r array<string>")
    assert [x[0] for x in df.select(nearest.readable("r", ["a"])).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("nearest_rank", [False, True])
def test_order_statistics(spark, nearest_rank):
    rng = random.Random(2)
    data = [(k, rng.choice([rng.gauss(0, 100), 5.0, -1e-9])) for k in ("a", "b", None) for _ in range(rng.randrange(1, 500))] + [("one", 3.0), ("none", None), ("a", float("nan")), ("inf", float("inf")), ("inf", 1.0)]
    df = spark.createDataFrame([(*r, 0) for r in data], "k string, v double, n int")
    probs = {"lo": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "hi": 1.0}
    got = {(r.k, r.stat): r.value for r in stats.order_statistics(df, ["k"], "v", probs, nearest_rank).collect()}
    for k in ("a", "b", None, "one"):
        x = sorted(v for g, v in data if g == k and v is not None and v == v)
        for s, p in probs.items():
            want = x[math.floor(p * (len(x) - 1) + 0.5)] if nearest_rank else float(np.quantile(x, p))
            assert got[(k, s)] == pytest.approx(want)
    assert ("none", "p50") not in got
    assert stats.order_statistics(df.limit(0), ["k"], "v", probs).count() == 0


def test_bootstraps_replay_the_generator(spark):
    rng = random.Random(1)
    x = [rng.random() for _ in range(23)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(x)], "s string, q int, v double")
    u, means = uniforms(7), []
    for _ in range(200):
        means.append(statistics.fmean(x[int(next(u) * 23)] for _ in x))
    r = stats.interval_of_mean(df, ["s"], ["q"], "v", 200).first()
    assert (r.low, r.high) == (pytest.approx(np.quantile(means, 0.025)), pytest.approx(np.quantile(means, 0.975))) and r.mean == pytest.approx(statistics.fmean(x))
    p = stats.paired_interval(df, ["s"], ["q"], "v", 200).first()
    assert (p.low, p.high) == (pytest.approx(sorted(means)[5]), pytest.approx(sorted(means)[194]))
    constant = stats.paired_interval(spark.createDataFrame([("s", i, 0.1) for i in range(3)], "s string, q int, v double"), ["s"], ["q"], "v", 50).first()
    assert [round(v, 9) for v in (constant.mean, constant.low, constant.high)] == [0.1, 0.1, 0.1]
    strata = spark.createDataFrame([("a" if i < 5 else "b", i, v) for i, v in enumerate(x)], "s string, q int, v double")
    u, means = uniforms(7), []
    for _ in range(100):
        means.append(statistics.fmean([statistics.fmean(x[int(next(u) * 5)] for _ in range(5)), statistics.fmean(x[5 + int(next(u) * 18)] for _ in range(18))]))
    s = stats.stratified_interval(strata, "s", ["q"], "v", 100).first()
    assert (s.low, s.high) == (pytest.approx(sorted(means)[int(0.025 * 99 + 0.5)]), pytest.approx(sorted(means)[int(0.975 * 99 + 0.5)]))
    assert spark.range(1).select(stats.verdict(F.lit(0.1), F.lit(0.2)), stats.verdict(F.lit(-2), F.lit(-1)), stats.verdict(F.lit(-1), F.lit(1))).first()[0:3] == ("better", "worse", "no difference")


def test_calibration(spark):
    rng = random.Random(3)
    data = [(r, s, round(rng.betavariate(3, 2) * 2, 3)) for r in "xy" for s in ("a", "b", "c") for _ in range(rng.randrange(50, 300))]
    df = spark.createDataFrame(data, "run string, s string, value double")
    bins = calibrate.histogram(df, ["run", "s"])
    assert bins.count() == 600 and bins.agg(F.sum("n")).first()[0] == len(data)
    nearest_rank = lambda v, q: sorted(v)[math.floor(q * (len(v) - 1) + 0.5)]
    out = {(r.run, r.s, r.level): r for r in calibrate.leave_one_out(df, df, ["run"], "s").collect()}
    for (run, s, level), r in out.items():
        others = [v for a, b, v in data if a == run and b != s]
        own = [v for a, b, v in data if a == run and b == s]
        assert r.cutoff == nearest_rank(others, calibrate.LEVELS[level]) and r.lets == pytest.approx(sum(v < r.cutoff for v in own) / len(own))
    assert len(out) == 18
    levels = calibrate.style_levels(df, ["run"]).where("run = 'x'").first()
    x = [v for a, _, v in data if a == "x"]
    t1, t5 = nearest_rank(x, 0.01), nearest_rank(x, 0.05)
    assert (levels.balanced, levels.loose) == (t1, t5) and levels.strict == pytest.approx(max(min(x), t1 - (t5 - t1) * math.log(10) / math.log(5)))


CALLS = "line_no long, machine string, ranker string, repeat_no int, question string, scores array<double>, model string, inputtokens long, cachedtokens long, cachewritetokens long, outputtokens long, reasoningtokens long, ms double, totalms double, attempts int, error string, raw string, covered int, order_ids array<string>"


def call(line, question="q", scores=None, error=None, order=None, repeat=1, ms=100.0, **more):
    row = {"line_no": line, "machine": "m", "ranker": "r", "repeat_no": repeat, "question": question, "scores": scores, "model": "x", "inputtokens": 10, "outputtokens": 5, "ms": ms, "attempts": 1, "error": error, "order_ids": order} | more
    return tuple(row.get(c.split()[0]) for c in CALLS.split(", "))


def test_call_log(spark):
    data = [call(1, scores=[1.0, 2.0]), call(2, scores=[3.0, 3.0], order=["a", "b", "c"]), call(2, scores=[3.0, 3.0], order=["a", "b", "c"]), call(3, "p", error="429 rate limit"), call(4, "z", error="billing stopped"), call(5, "y", scores=[1.0, 9.0], order=["a", "b"]), call(6, "y", scores=[0.0, None], order=["a", "b"], repeat=2, cachedtokens=9, ms=5.0), call(7, None, scores=[])]
    df = spark.createDataFrame(data, CALLS)
    assert sorted(r.line_no for r in calls.latest(df).collect()) == [2, 3, 4, 5, 6, 7]
    counted = calls.counted(df)
    assert sorted(r.line_no for r in counted.collect()) == [2, 3, 5, 6, 7]
    t = calls.tie_rate(counted, ["ranker"]).first()
    assert t.scored == 3 and t.tie_rate == pytest.approx(1 / 3)
    placed = [(r.line_no, r["rank"], r.passage) for r in calls.ordered(counted, ["line_no"]).orderBy("line_no", "rank").collect()]
    assert placed == [(2, 1, "a"), (2, 2, "b"), (2, 3, "c"), (5, 1, "b"), (5, 2, "a"), (6, 1, "a"), (6, 2, "b")]
    first = calls.ordered(counted, ["line_no"]).where("rank = 1").select("line_no", F.col("passage").alias("first"))
    s = calls.stability(counted.join(first, "line_no"), "first", ["ranker"]).first()
    assert (s.questions, s.stability) == (1, 0.0)
    assert {(r.question, r.repeat_no) for r in calls.pending(df).collect()} == {("p", 1), ("z", 1)}
    lat = calls.latency(counted, ["ranker"]).first()
    assert (lat.n, lat.p50) == (4, 100.0)
    tot = calls.totals(counted, ["ranker"]).first()
    assert (tot.calls, tot.failures, tot.models) == (5, 1, "x")
    assert calls.throughput(counted, ["ranker"]).first().tokens_per_second == pytest.approx(75 / 0.405)
    assert calls.counted(df.limit(0)).count() == 0
    up = calls.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"])
    assert sorted(map(tuple, up.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_lists_and_judgements(spark):
    hits = spark.createDataFrame([("q", 0, [1, 2, None], [1.0, 2.0, 9.0]), ("q", 1, [1], [5.0, 7.0]), ("q", 2, None, [1.0]), ("r", 0, [], [])], "query_id string, shard int, ids array<int>, scores array<double>")
    ranked = spark.createDataFrame([("q", "x", [2, 3], [0.5, float("nan")])], "query_id string, run string, top array<int>, topsims array<double>")
    s = lists.system_scores(hits, ranked)
    assert sorted(map(tuple, s.collect())) == [("bm25", "q", 1, 5.0), ("bm25", "q", 2, 2.0), ("x", "q", 2, 0.5)]
    j = {r.doc: r.grade for r in lists.pooled_judgements(lists.in_order(s)).collect()}
    assert j == {1: 0, 2: 1}
    status = compare.judged_status(lists_of(spark, q=[1, 2, 5]), lists.pooled_judgements(lists.in_order(s)))
    assert {r.doc: r.judged for r in status.collect()} == {1: "judged not relevant", 2: "relevant", 5: "not judged"}


def test_comparisons(spark):
    df = spark.createDataFrame([("a", i, h) for i, h in enumerate([1, 1, 0, 0])] + [("b", i, h) for i, h in enumerate([1, 0, 1, 0])] + [("b", 9, 1)], "s string, q int, hit1 int")
    r = compare.kept_gained_lost(df, "s", "a", "q").first()
    assert (r.kept, r.gained, r.lost) == (1, 1, 1)
    o = compare.overlap(df, "s", "a", "b", "q", F.col("hit1") == 1).first()
    assert tuple(o) == (1, 1, 1, 1)
    assert sorted((r.q, r["diff"]) for r in compare.paired(df, "s", "a", "hit1", ["q"]).collect()) == [(0, 0), (1, -1), (2, 1), (3, 0)]
    pool = spark.createDataFrame([(i, float(v), "t" * n) for i, (v, n) in enumerate([(1, 3), (5, 2), (5, 1), (9, 1)])], "k int, v double, t string")
    m = compare.near_median(pool, "v", "t", "k", F.col("k") != 0).orderBy("place").collect()
    assert [r.k for r in m] == [2, 1, 3] and m[0].median == 5
    c = spark.createDataFrame([("q", 1), ("q", 2), ("r", 3)], "query string, doc int")
    assert {r["query"]: r.rankable for r in compare.rankable(c, judged(spark, q={2: 1}, r={3: 0})).collect()} == {"q": True, "r": False}
    assert [r.doc for r in compare.missing(c, spark.createDataFrame([(1,), (3,)], "doc int")).collect()] == [2]


def test_samples(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1), (None, 5), ("a", 3)], "s string, k int")
    got = [r.k for r in sampling.shuffled_first(df, "s", "k", 4, 99).where("s = 'a'").orderBy("place").collect()]
    pool, u = list(range(10)), uniforms(99)
    for k in range(9, 0, -1):
        j = int(next(u) * (k + 1))
        pool[k], pool[j] = pool[j], pool[k]
    assert got == pool[:4]
    q = spark.createDataFrame([("x",), ("y",)], "query string")
    bad = spark.createDataFrame([("x", o) for o in range(0, 10, 2)], "query string, ord int")
    out = sampling.random_others(q, bad, 10, 6).collect()
    assert len(out) == 12 and all(r.ord % 2 for r in out if r["query"] == "x")
    assert sampling.hashed_others(q, 10, 6).where("ord BETWEEN 0 AND 9").count() == 12


def test_rankers(spark):
    c = spark.createDataFrame([("q", "zebra stripes", 0, "horses"), ("q", "zebra stripes", 1, "a zebra has stripes"), ("r", None, 0, None)], "question string, query string, pos int, text string")
    got = {r.question: r for r in rankers.rank_all(c, rankers.TermOverlap()).collect()}
    assert got["q"].scores == [0.0, 1.0] and got["r"].scores == [0.0]
    assert rankers.rank_all(c, rankers.GivenOrder()).where("scores IS NULL").count() == 2
    judge = rankers.Judge(lambda prompt: (json.dumps([{"i": 0, "score": 4}]), False)).rank("q", ["a", "b"])
    assert judge.scores == [4, 0] and judge.covered == 1
    assert rankers.Judge(lambda p: ("[0] 4\n[1] 2", True)).rank("q", ["a", "b"]).error
    assert rankers.PerPair(lambda q, p: len(p)).rank("q", ["a", "bb"]).scores == [1, 2]
    with pytest.raises(ValueError):
        rankers.dense_scores({0: 1.0}, 2)
    seen = []
    tries = rankers.Attempts(pause=seen.append)
    answer, n, _, _ = tries(lambda: rankers.Answer(error="503"), lambda e: True)
    assert n == 4 and answer.error == "503" and len(seen) == 3
    assert tries(lambda: 1 / 0, lambda e: False)[1] == 1
    now = [0.0]
    b = rankers.Budget(100, 60, lambda: now[0])
    assert b.wait(80) == 0
    b.spend(80)
    now[0] = 10.0
    assert b.wait(30) == 50 and b.wait(10) == 0
    vecs = rankers.embed_all(spark.createDataFrame([(1, "a cat"), (2, "a cat"), (3, None)], "k int, t string"), "k", "t", rankers.HashedEmbedder(16)).collect()
    assert len(vecs) == 2 and vecs[0].vec == vecs[1].vec


def test_embedding_within_limits():
    class TooLong(Exception):
        pass

    def embed(texts):
        if sum(map(len, texts)) > 20:
            raise TooLong
        return [[float(len(t))] for t in texts]

    long = lambda e: isinstance(e, TooLong)
    assert rankers.embed_within(embed, ["a" * 15, "b" * 15, "c" * 30], long) == [[15.0], [15.0], [16.0]]
    with pytest.raises(TooLong):
        rankers.embed_within(embed, ["a" * 10_000], long, cuts=2)
    with pytest.raises(ZeroDivisionError):
        rankers.embed_within(lambda t: 1 / 0, ["a"], long)
