"""The operators on small tables, against brute force; nulls, ties, repeated rows, empty tables, clashing names."""

import datetime as dt
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark.llm import body, cutoff, leximin, mih, mix, pack, quantile, scores, spans, split, tokens, topn
from quillmark.session import durable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 1 ---


def nearest_brute(items, k):
    out = []
    for key, v in items:
        sims = sorted(((-round(min(1.0, float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w))), 9), o) for o, w in items if o != key))
        out += [(key, o, place) for place, (s, o) in enumerate(sims[:k], 1) if -s >= 0.85]
    return out


def test_nearest_vectors(spark):
    rng = np.random.default_rng(5)
    items = []
    for c in range(40):
        centre = rng.standard_normal(32)
        items += [(len(items) + i, centre + rng.standard_normal(32) * 0.25) for i in range(rng.integers(1, 7))]
    items = [(int(k), [float(x) for x in np.float32(v)]) for k, v in items]
    items += [(1000 + i, items[3][1]) for i in range(9)]  # copies
    extra = [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [float("nan")] * 32), (2006, [float("inf")] * 32), (2004, [1.0] * 31), (2005, [None] + [1.0] * 31), (None, [1.0] * 32)]
    df = spark.createDataFrame([(k, v, 1, 2) for k, v in items + extra + items[:5]], "key long, vec array<float>, n int, bucket int")
    found = mih.nearest(mih.usable(df, "key", "vec", 32, F.lit("c")), 32, 5, durable, floor=0.85)
    got = {(r.key, r.other) for r in found.collect()}
    want = {(k, o) for k, o, _ in nearest_brute([(k, np.array(v)) for k, v in items], 5)}
    assert got <= {(k, o) for k, o, _ in nearest_brute([(k, np.array(v)) for k, v in items], len(items))}
    assert len(got & want) >= 0.97 * len(want)
    assert [r.other for r in found.where("key = 1004").orderBy("place").collect()] == [3, 1000, 1001, 1002, 1003]


def test_nearest_in_crowded_buckets(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(48)
    items = [(i, [float(x) for x in centre + rng.standard_normal(48) * 0.05]) for i in range(80)]
    df = spark.createDataFrame(items, "key long, vec array<float>")
    monkeypatch.setattr(mih, "HOT", 10)
    found = mih.nearest(mih.usable(df, "key", "vec", 48, F.lit("c")), 48, 3, durable)
    got = {(r.key, r.other) for r in found.collect()}
    want = {(k, o) for k, o, _ in nearest_brute([(k, np.array(v)) for k, v in items], 3)}
    assert len(got & want) >= 0.95 * len(want)


def test_crowded_buckets_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(48)
    items = [(i, [float(x) for x in centre + rng.standard_normal(48) * 0.4]) for i in range(400)]
    df = spark.createDataFrame(items, "key long, vec array<float>")
    vectors = mih.usable(df, "key", "vec", 48, F.lit("c")).cache()
    found = []
    for hot in (10_000, 10):
        monkeypatch.setattr(mih, "HOT", hot)
        found.append({(r.key, r.other) for r in mih.Index(vectors, 48, durable, mih.FULL).within().collect()})
    assert found[0] == found[1] and len(found[0]) > 10_000


def test_nearest_at_any_similarity(spark):
    rng = np.random.default_rng(9)
    items = [(i, [float(x) for x in np.float32(rng.standard_normal(32))]) for i in range(300)]
    items += [(400 + i, items[20][1]) for i in range(15)]  # copies
    df = spark.createDataFrame([(c, *x) for c in ("c", "d") for x in items + items[:4]] + [("one", 20, items[0][1])], "c string, key long, vec array<float>")
    vectors = mih.usable(df, "key", "vec", 32, F.col("c"))
    found = mih.nearest_exact(vectors, vectors.where("key % 20 = 0"), 32, 10, durable, 64)
    v = np.array([x for _, x in items])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for i, (key, _) in enumerate(items):
        if key % 20 == 0:
            order = sorted((-round(min(1.0, float(v[i] @ v[j])), 9), o) for j, (o, _) in enumerate(items) if o != key)
            want[key] = [o for _, o in order[:10]]
    got = defaultdict(list)
    for r in found.orderBy("coll", "key", "place").collect():
        got[(r.coll, r.key)].append(r.other)
    assert dict(got) == {(c, key): o for c in ("c", "d") for key, o in want.items()}
    assert want[20] == list(range(400, 410))
    assert mih.nearest_exact(vectors.limit(0), vectors, 32, 10, durable).count() == 0


@pytest.mark.parametrize("part", [False, True])
def test_nearest_without_a_floor(spark, monkeypatch, part):
    """Every vector gets k neighbours, the true ones but for few, whether it lies in a crowd or by itself."""
    rng = np.random.default_rng(19)
    vecs = [v for c in range(30) for v in rng.standard_normal(24) + rng.standard_normal((12, 24)) * 0.3] + list(rng.standard_normal((240, 24)))
    items = [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vecs)] + [(2000 + i, [float(x) for x in np.float32(vecs[3])]) for i in range(7)]
    df = spark.createDataFrame([("c", *x) for x in items + items[:9]] + [("two", 1, items[0][1]), ("two", 2, items[1][1])], "c string, key long, vec array<float>")
    monkeypatch.setattr(mih, "SCANNED", 0.9)
    vectors = mih.usable(df, "key", "vec", 24, F.col("c"))
    asked = vectors.where("key % 5 = 0") if part else None
    got = defaultdict(list)
    for r in mih.nearest(vectors, 24, 10, durable, asked=asked).orderBy("coll", "key", "place").collect():
        got[(r.coll, r.key)].append(r.other)
    keys = [k for k, _ in items if not part or k % 5 == 0]
    x = np.array([v for _, v in items])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for i, (key, _) in enumerate(items):
        if key in keys:
            order = sorted((-round(min(1.0, float(x[i] @ x[j])), 9), o) for j, (o, _) in enumerate(items) if o != key)
            hit += len({o for _, o in order[:10]} & set(got[("c", key)]))
    assert {k: len(v) for k, v in got.items()} == {**{("c", k): 10 for k in keys}, **({} if part else {("two", 1): 1, ("two", 2): 1})}
    assert hit >= 0.97 * 10 * len(keys)


def test_nearest_query_gives_ten_neighbours(spark, tmp_path):
    from quillmark.llm.queries import p1_nearest

    rng = np.random.default_rng(10)
    vec = lambda d: [float(x) for x in rng.standard_normal(d)]
    spark.createDataFrame([(i, vec(384)) for i in range(60)], "id long, embedding array<float>").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("s", i, vec(64)) for i in range(60)], "set_name string, ord long, vec array<float>").write.parquet(f"{tmp_path}/vectors.parquet")
    got = Counter((r.collection, r.key) for r in p1_nearest(spark, str(tmp_path)).collect())
    assert got == {(c, key): 10 for c in ("chunks", "s") for key in (0, 20, 40)}


def test_nearest_of_nothing(spark):
    df = spark.createDataFrame([], "key long, vec array<float>")
    assert mih.nearest(mih.usable(df, "key", "vec", 8, F.lit("c")), 8, 5, durable).count() == 0


# --- 2 ---


def test_bodies(spark):
    page = lambda i: (f"p{i}", "en/site", "T", f"About · Help\r\nAnn: Read our motto.\r\nPage {i} has words of its own.\n")
    data = [page(i) for i in range(20)] + [page(3), ("null", "en/site", None, None), ("empty", None, None, ""), (None, None, None, "Only text."), ("long", "en/o", "T", "word " * 50_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "id string, sample string, title string, text string, lines int, site string")
    out = {r.id: (r.body, r.outside) for r in body.body_lines(df, durable).collect()}
    assert len(out) == 23
    assert out["p7"] == ("Page 7 has words of its own.", [0, 1])
    assert out["empty"] == ("", []) and out[None] == ("Only text.", []) and out["long"][1] == []
    assert body.body_lines(df.limit(0), durable).count() == 0


def test_lines_shared_by_sites(spark):
    def site(name, pages, lines):
        return [(f"{name}{i}", name, "T", "\n".join([x for x, n in lines.items() if i < n] + [f"Page {i} of {name} has words."])) for i in range(pages)]

    data = site("a", 40, {"Kept by the Plover platform": 40, "Overview of it": 6, "Half of us say so": 20})
    data += site("b", 40, {"Kept by the Plover platform": 40, "Overview of it": 6}) + site("c", 40, {"Kept by the Plover platform": 40, "Overview of it": 6})
    data += site("d", 900, {"Half of us say so": 3, "Rarely here": 3}) + site("e", 900, {"Half of us say so": 3, "Rarely here": 3}) + site("f", 60, {"Rarely here": 3})
    df = spark.createDataFrame(data, "id string, sample string, title string, text string")
    found = {r.site: {x.line for x in r.lines} for r in body.site_lines(df.select("id", F.col("sample").alias("site"), "text"), durable).collect()}
    assert found == {"a": {"Kept by the Plover platform", "Half of us say so"}, "b": {"Kept by the Plover platform"}, "c": {"Kept by the Plover platform"}, "f": {"Rarely here"}}
    out = {r.id: r.body for r in body.body_lines(df, durable).collect()}
    assert out["a0"] == "Overview of it\nPage 0 of a has words." and out["d0"].startswith("Half of us")


# --- 3 ---


def test_sketches_merge_and_bound(spark):
    rng = np.random.default_rng(2)
    values = rng.lognormal(3, 2, 60_000)
    data = [("a", i % 3, float(v)) for i, v in enumerate(values)] + [(None, 0, 5.0), ("a", 0, None), ("a", 1, float("nan"))]
    df = spark.createDataFrame(data, "g string, d int, v double").repartition(7)
    days = quantile.sketch(df, ["g", "d"], "v", 256)
    merged = quantile.merge_sketches(days, ["g"], 256)
    q = {(r.g, r.stat): r for r in quantile.quantiles(merged, ["g"], {"p50": 0.5, "p95": 0.95}).collect()}
    assert q[(None, "p50")].est == 5.0 and q[("a", "p50")].n == 60_000
    for stat, p in (("p50", 0.5), ("p95", 0.95)):
        r, true = q[("a", stat)], np.quantile(values, p)
        assert r.low <= true <= r.high
        assert abs((values <= r.est).mean() - p) < 0.01
    assert quantile.sketch(df.limit(0), ["g"], "v").count() == 0


def test_sketches_of_groups_far_above_their_size(spark, monkeypatch):
    """Merged over three steps of a tree, the estimate is within the error it states, and that is small."""
    monkeypatch.setattr(quantile, "FAN_IN", 4)
    monkeypatch.setattr(quantile, "CHUNK", 5_000)
    monkeypatch.setattr(quantile, "HELD", 2_000)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.lognormal(3, 2, 150_000), np.full(50_000, 30.0)])
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": values})).repartition(24)
    got = {r.stat: r for r in quantile.quantiles(quantile.sketch(df, ["g"], "v", 64), ["g"], {"p05": 0.05, "p50": 0.5, "p95": 0.95}).collect()}
    for stat, p in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95)):
        r = got[stat]
        assert r.n == 200_000 and r.low <= np.quantile(values, p) <= r.high
        assert (values < r.est).mean() - 0.05 < p < (values <= r.est).mean() + 0.05


def test_wrong_figures(spark):
    day = dt.datetime(2026, 3, 3, 12)
    calls = [(i, "m", "r", float(v), day + dt.timedelta(days=i % 2)) for i, v in enumerate(random.Random(1).choices(range(1, 2000), k=400))]
    calls += [calls[0], (900, "m", "r", None, day), (901, "m", "r", float("nan"), day), (902, "m", "r", -1.0, day), (903, "m", "r", 9e9, None)]
    df = spark.createDataFrame([(*c, 7) for c in calls], "line_no long, machine string, ranker string, ms double, at_ts timestamp_ntz, n int")
    good = {c[0]: c for c in calls if c[4] and c[3] and c[3] > 0}.values()
    one = [c[3] for c in good if c[4].date() == day.date()]
    week = [c[3] for c in good]
    p = lambda x, q: float(np.quantile(x, q))
    figures = [("m", "r", "day", day.date(), 1, p(one, 0.5) * 1.2, p(one, 0.95)), ("m", "r", "week", dt.date(2026, 3, 2), 1, p(week, 0.5) * 1.01, p(week, 0.95) * 0.8), ("m", "r", "day", dt.date(2026, 3, 4), 1, None, None), ("x", "r", "day", day.date(), 1, 1.0, 1.0)]
    s = spark.createDataFrame(figures + figures[:1], "machine string, ranker string, span string, since date, calls long, latencyp50 double, latencyp95 double")
    for k in (16, 2048):  # with collapsed buffers the open figures are counted exactly
        got = {(r.span, r.stat) for r in quantile.wrong_figures(df, s, k).collect()}
        assert got == {("day", "p50"), ("week", "p95")}


# --- 4 ---


def test_top_n(spark):
    rng = random.Random(4)
    data = [(g, rng.choice([1.0, 2.5, -3.0, 0.0, 100.0, float("inf")]), i) for g in ("a", "b", None) for i in range(200)]
    data += [("hot", float(i % 50), i) for i in range(5000)] + [("few", 1.0, 1), ("none", None, 1), ("nan", float("nan"), 1)]
    df = spark.createDataFrame([(*r, 9, "x") for r in data], "g string, s double, i int, place int, _bin string")
    got = rows(topn.top_n(df, ["g"], "s", "i", 7, durable).select("g", "i", "place"))
    by = defaultdict(list)
    for g, s, i in data:
        if s is not None and s == s:
            by[g].append((-s, i))
    want = sorted(((g, i, p) for g, x in by.items() for p, (_, i) in enumerate(sorted(x)[:7], 1)), key=str)
    assert got == want
    assert topn.top_n(df.limit(0), ["g"], "s", "i", 7).count() == 0


def test_score_bins_are_monotone(spark):
    x = sorted(random.Random(0).uniform(-1, 1) * 10 ** random.Random(i).randint(-12, 12) for i in range(500)) + [float("inf")]
    bins = [r[0] for r in spark.createDataFrame([(v,) for v in [float("-inf"), *x]], "v double").select(scores.score_bin(F.col("v"))).collect()]
    assert bins == sorted(bins)


# --- 5 ---


def leximin_brute(data, systems):
    lists = defaultdict(dict)
    for s, q, o, v in data:
        if None not in (s, q, o, v) and v == v:
            lists[(q, s)][o] = max(v, lists[(q, s)].get(o, -math.inf))
    out = {}
    for q in {q for q, _ in lists}:
        own = {s: x for (a, s), x in lists.items() if a == q}
        if len(own) < systems:
            continue
        pct = {s: {o: (sum(w < v for w in x.values()) + (sum(w == v for w in x.values()) + 1) / 2) / len(x) for o, v in x.items()} for s, x in own.items()}
        items = {o for x in own.values() for o in x}
        order = sorted(items, key=lambda o: (sorted((pct[s].get(o, 0.0) for s in own)), -o), reverse=True)
        out[q] = order
    return out


@pytest.mark.parametrize("long", [10_000, 3])
def test_leximin(spark, long):
    rng = random.Random(8)
    hits, ranked = [], []
    for q in range(12):
        items = rng.sample(range(50), 20)
        hits.append((f"q{q}", 0, [*items, None, items[0]], [*(float(rng.randint(0, 9)) for _ in items), 1.0, 50.0]))
        for run in ("x", "y", "z")[: 2 + q % 2 if q else 3]:
            top = rng.sample(range(50), 12)
            ranked.append((f"q{q}", run, top, [rng.choice([0.1, 0.2, 900.0, float("nan")]) for _ in top[:-1]]))
    hits += [("q0", 1, None, None), ("q0", 2, [], []), (None, 1, [1], [1.0])]
    h = spark.createDataFrame(hits, "query_id string, shard int, ids array<int>, scores array<double>")
    r = spark.createDataFrame(ranked, "query_id string, run string, top array<int>, topsims array<double>")
    pairs = scores.pair_rows(h, r)
    vectors = leximin.leximin_vectors(pairs, scores.list_sizes(h, r), 4, long)
    got = defaultdict(list)
    for x in leximin.leximin_rank(vectors).orderBy("query_id", "place").collect():
        got[x.query_id].append(x.ord)
    data = [(("bm25"), q, i, s) for q, _, ids, ss in hits for i, s in zip(ids or [], ss or [])] + [(run, q, i, s) for q, run, top, ss in ranked for i, s in zip(top, ss)]
    assert dict(got) == leximin_brute(data, 4)
    best = {x.query_id: x.ord for x in leximin.leximin_rank(vectors, top=1).collect()}
    assert best == {q: o[0] for q, o in got.items()}
    assert leximin.leximin_rank(leximin.leximin_vectors(pairs.limit(0), scores.list_sizes(h, r), 4), 1).count() == 0


def test_one_long_query_is_ranked_by_many_tasks(spark):
    rng = random.Random(8)
    data = [("q", i, [rng.randrange(4) / 4, rng.randrange(9) / 4]) for i in range(3000)] + [("r", 5, [0.0, 1.0]), ("r", 4, [0.0, 1.0])]
    df = spark.createDataFrame(data, "query_id string, ord int, weakest array<double>")
    got = {(r.query_id, r.ord): r.place for r in leximin.leximin_rank(df).collect()}
    want = {}
    for q in "qr":
        for place, (_, o, _) in enumerate(sorted((d for d in data if d[0] == q), key=lambda d: ([-x for x in d[2]], d[1])), 1):
            want[(q, o)] = place
    assert got == want
    assert leximin.leximin_rank(df.limit(0)).count() == 0


# --- 6 ---


@pytest.mark.parametrize("small", [4096, 20])
def test_cutoffs(spark, small):
    rng = random.Random(9)
    data = [(s, round(rng.betavariate(2, 5), d)) for s, d, n in ((1, 6, 900), (2, 1, 700), (3, 3, 1), (4, 2, 60)) for _ in range(n)] + [(5, 0.5)] * 300
    targets = [(1, 0.05), (2, 0.3), (3, 1.0), (4, 0.9), (5, 0.5), (6, 0.1)]
    v = spark.createDataFrame(data, "source long, value double").repartition(5)
    t = spark.createDataFrame([(*x, 3) for x in targets], "source long, share double, n int")
    got = {r.source: (r.cutoff, r.kept, r.n) for r in cutoff.cutoffs(v, t, durable, small).collect()}
    want = {}
    for s, share in targets:
        x = [b for a, b in data if a == s]
        fits = [y for y in set(x) if sum(z <= y for z in x) / len(x) <= share]
        if x:
            want[s] = (max(fits), sum(z <= max(fits) for z in x), len(x)) if fits else (None, 0, len(x))
    assert got == want


def test_source_cutoffs(spark):
    nan = float("nan")
    data = [("r", "s", "p", f"q{i}", [0.1 * i, None, nan, -1.0, 3.0], [0.2]) for i in range(10)] + [("r", "s", "p", "q0", [0.0, None, nan, -1.0, 3.0], [0.2]), ("r", "s", "p", "e", [], None), ("u", "s", "p", "q", [0.1], [0.1]), (None, "s", "p", "q", [0.1], None)]
    s = spark.createDataFrame(data, "run string, set_name string, probe string, question string, random array<double>, relevant array<double>")
    c = spark.createDataFrame([("r", 0.4, 0.1, 0.25, 1.0), ("r", 0.4, 0.1, 0.25, 1.0), ("w", None, 0.1, 0.2, 0.2)], "run string, question double, shortq double, random_share double, relevant_share double")
    items, cut = cutoff.source_cutoffs(s, c, durable)
    kept = rows(cutoff.kept_elements(items, cut).select("question", "field", "pos"))
    assert kept == sorted([("q0", "random", 0), ("q1", "random", 0)] + [(f"q{i}", "relevant", 0) for i in range(10)], key=str)
    items, cut = cutoff.source_cutoffs(s.limit(0), c, durable)
    assert cutoff.kept_elements(items, cut).count() == 0


# --- 7 ---


def test_split_texts(spark):
    text = "Une phrase assez longue. " * 300 + "x" * 3000 + "\n\nEnd 🧭."
    data = [("a#1", "S", text), ("a#1", "S", text), ("b", None, "short"), ("c", "S", ""), ("d", "S", None), (None, None, "no id"), ("cr", "S", "Line one.\r\n" * 200)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "id string, section string, text string, piece_no int, start string")
    out = split.split_texts(df).orderBy("id", "piece_no").collect()
    a = [r for r in out if r.id == "a#1"]
    assert "".join(text[r.own_start : r.own_end] for r in a) == text
    assert all(len(r.piece) <= 1200 and r.piece == text[r.start : r.own_end] and r.own_start - r.start <= 120 for r in a)
    assert sum(r.own_start > r.start for r in a) > len(a) / 2 and any(r.forced for r in a) and {r.section for r in a} == {"S"}
    assert [r.piece_no for r in a] == list(range(len(a)))
    assert Counter(r.id for r in out if r.id != "a#1" and r.id != "cr") == {"b": 1, "c": 1, None: 1}
    assert not any(r.forced for r in out if r.id == "cr")
    assert split.split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_texts(df, limit=10, overlap=10)


# --- 8 and 9 ---


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|> \0 东京"), (5, "word " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.token_counts(df, ["doc_id"]).collect()}
    assert got == {1: len(tokens.encoding().encode_ordinary("Hello world")), 2: 0, 3: 0, 4: len(tokens.encoding().encode_ordinary("<|endoftext|> \0 东京")), 5: len(tokens.encoding().encode_ordinary("word " * 40_000))}


@pytest.mark.parametrize("at_once", [1 << 18, 50])
def test_pack(spark, monkeypatch, at_once):
    monkeypatch.setattr(pack, "RANKED_AT_ONCE", at_once)
    rng = random.Random(3)
    sizes = [(i, rng.choice([1, 7, 30, 30, 30, 64, 99, 100, 101, 350])) for i in range(900)] + [(1000, 0), (1001, None), (None, 12), (5, 30), (5, 30)]
    df = spark.createDataFrame([(*r, 1, "x") for r in sizes], "id long, size long, container int, start string")
    out = pack.pack(df, "id", "size", durable, 100).collect()
    placed = [r for r in out if r.container is not None]
    used = Counter()
    for r in placed:
        used[r.container] += r.size
    assert max(used.values()) <= 100 and set(used) == set(range(len(used)))
    assert sum(r.size for r in placed) == sum(s or 0 for _, s in sizes)
    assert sum(r.size for r in placed) / (100 * len(used)) > 0.95
    assert {r.id for r in out if r.container is None} == {1000, 1001}
    whole = Counter(r.id for r in placed)
    assert all(n == 1 for i, n in whole.items() if i not in (5, None) and dict(sizes)[i] <= 100)
    big = next(i for i, s in sizes if s == 350)
    assert sorted((r.piece_no, r.start, r.size) for r in placed if r.id == big) == [(0, 0, 100), (1, 100, 100), (2, 200, 100), (3, 300, 50)]
    facts = pack.fill(pack.pack(df, "id", "size", durable, 100), 100).first()
    assert facts.containers == len(used) and facts.fullest <= 100
    assert pack.pack(df.limit(0), "id", "size", durable, 100).count() == 0


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", "free", None]), rng.randint(1, 40)) for i in range(3000)] + [(9001, "b", 0), (0, "a", 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, source string, tokens long, copies int, extra int")
    w = spark.createDataFrame([("a", 0.2, 1), ("b", 0.3, 2), ("c", 0.5, 3), ("none", 0.1, 9), (None, 0.5, 1)], "source string, weight double, max_repeats int")
    records, shares = mix.mix(df, w, durable, total=20_000)
    got = {r.source: r for r in shares.collect()}
    assert set(got) == {"a", "b", "c", "none"} and got["none"].tokens == 0
    caps = {"a": 1, "b": 2, "c": 3}
    for s in "abc":
        assert abs(got[s].tokens - got[s].target) <= 40
        assert got[s].target <= caps[s] * got[s].available + 1e-6
    assert sum(r.share for r in got.values()) == pytest.approx(1)
    out = records.collect()
    assert len(out) == len({d for d, _, _ in docs}) and all(r.copies == 0 for r in out if r.source not in caps)
    assert all(r.copies <= caps.get(r.source, 0) for r in out)
    assert rows(mix.mix(df, w, durable, total=20_000)[0]) == rows(records)
    records, shares = mix.mix(df.limit(0), w, durable)
    assert records.count() == 0 and all(r.tokens == 0 and r.share is None for r in shares.collect())


# --- 10 ---


def shared_brute(texts, span):
    grams = defaultdict(set)
    for d, t in texts.items():
        for i in range(len(t) - span + 1):
            grams[t[i : i + span]].add(d)
    pairs = {p for ds in grams.values() for p in itertools.combinations(sorted(ds), 2)}
    covered = {}
    for d, t in texts.items():
        on = set()
        for i in range(len(t) - span + 1):
            if len(grams[t[i : i + span]]) > 1:
                on |= set(range(i, i + span))
        covered[d] = len(on)
    return pairs, covered


def test_a_notice_in_thousands_of_texts(spark, monkeypatch):
    """A span that most texts hold gives all pairs of them, of exact copies too, and none with texts that hold less of it."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    notice, ruler = word(230), "-=" * 130
    data = [(i, word(rng.randrange(150)) + notice + word(rng.randrange(150))) for i in range(1500)]
    data += [(2000 + i, word(40) + "Q" + notice[:199] + "Z" + word(300)) for i in range(100)] + [(3000 + i, word(30 + i) + ruler + word(90)) for i in range(100)] + [(4000, data[7][1])]
    monkeypatch.setattr(spans, "BLOCK_ROWS", 100)
    found = spans.SharedSpans(spark.createDataFrame(data, "doc long, text string"), durable)
    _, crowds = found.links()
    assert crowds.groupBy("crowd").count().where("count = 1500").count() >= 1
    got = {tuple(r) for r in found.pairs().collect()}
    many, less, rulers = [*range(1500), 4000], range(2000, 2100), range(3000, 3100)  # "Q", 199 and "Z" are 201
    assert got == {*itertools.combinations(many, 2), *itertools.combinations(less, 2), *itertools.combinations(rulers, 2)}


def test_shared_spans(spark):
    rng = random.Random(11)
    word = lambda n, letters="abcdefghij .\n": "".join(rng.choice(letters) for _ in range(n))
    bits = [word(rng.randrange(35, 140)) for _ in range(12)]
    texts = {i: word(rng.randrange(0, 200)) + rng.choice(bits) + word(rng.randrange(0, 90)) + rng.choice(bits)[: rng.randrange(20, 140)] for i in range(60)}
    texts |= {100: texts[1], 101: texts[1], 102: "a" * 500, 103: "b" + "a" * 39, 104: "b" + "a" * 900, 105: "ab" * 200, 106: "xx" + "ab" * 33 + "yy", 107: "", 108: "东京都" * 30, 109: "大" + "东京都" * 20}
    data = [(d, t, 1) for d, t in texts.items()] + [(5, texts[5], 1), (200, None, 1), (None, texts[2], 1)]
    df = spark.createDataFrame(data, "doc long, text string, h int")
    op = spans.SharedSpans(df, durable, span=40, run=16)
    pairs, covered = shared_brute(texts, 40)
    assert {tuple(r) for r in op.pairs().collect()} == pairs
    assert op.pairs().count() == len(pairs)
    docs = spark.createDataFrame(list(texts.items()), "doc long, text string")
    out = {r.doc_id: r for r in spans.coverage(op.stretches(), docs).collect()}
    assert {d: r.shared for d, r in out.items()} == covered
    assert out[107].share == 0
    kept = {r.doc_id: r.text for r in spans.without_repeats(docs, op.stretches()).collect()}
    assert kept[100] == "" and kept[101] == "" and len(kept) == len(texts)
    none = spans.SharedSpans(df.limit(0), durable)
    assert none.pairs().count() == 0 and none.stretches().count() == 0


def test_shared_spans_in_unequal_repetitions(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghij .") for _ in range(n))
    texts = {}
    for unit in ("- ", "A sentence of thirty-one marks."):
        for short, long, rest in ((150, 400, 60), (170, 600, 60), (180, 900, 40)):
            for _ in range(25):
                tail = word(rest)
                for n in (short, long):
                    texts[len(texts)] = word(30) + (unit * n)[-n:] + tail + word(50)
                texts[len(texts)] = word(30) + tail + (unit * n)[:n] + word(50)
    df = spark.createDataFrame(list(texts.items()), "doc long, text string")
    op = spans.SharedSpans(df, durable)
    pairs, covered = shared_brute(texts, 200)
    assert {tuple(r) for r in op.pairs().collect()} == pairs
    assert {r.doc_id: r.shared for r in spans.coverage(op.stretches(), df).collect()} == covered
