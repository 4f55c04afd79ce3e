"""The driver contract, and all queries of the core against SQL on the smallest tables where they are present."""

import os

import pytest

import __spark_entry__ as entry
from quillmark.plans.oracle import CHUNKS, COS, MAY, ORACLE
from quillmark.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["bm25_topk", "rrf_hybrid_topk", "ranking_metrics", "latest_calls", "noise_floor_levels", "knn_exact_topk", "rrf_cut_legs", "fusion_half_against_equal", "keyword_variants", "candidate_bm25", "positive_hits", "knn_excluding_own_document", "paired_hit_intervals", "recall_by_script", "ranker_hits_of_all_questions", "own_language_transfer", "random_profile", "zipped_random_pairs", "past_snippet", "relevant_past_snippet", "bootstrap_paired_ci", "titles_nearest_median"])
def test_query_against_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    want = db.execute(ORACLE[name]).fetchall()
    columns = [d[0] for d in db.description]
    got = [tuple(r) for r in QUERIES[name](spark, SMALL).select(*columns).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def _duck():
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return db


def _same(spark, name, sql):
    db = _duck()
    want = db.execute(sql).fetchall()
    got = [tuple(r) for r in QUERIES[name](spark, SMALL).select(*[d[0] for d in db.description]).collect()]
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def _first(scan, n=10, where="true"):
    return f"SELECT query, id, topic, round(distance, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS place FROM {scan}) WHERE place <= {n} AND {where}"


SCAN = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r FROM d) WHERE r <= {} AND {})"
WHOLE = {
    "permission_filtered_knn_all": _first(f"(SELECT * FROM d WHERE {MAY})"),
    "knn_cutoff_inside_all": _first(f"(SELECT * FROM d WHERE {MAY} AND distance < 0.9)"),
    "knn_cutoff_outside_all": _first(f"(SELECT * FROM d WHERE {MAY})", where="distance < 0.9"),
    "knn_post_filter_budget_all": _first(SCAN.format(40, MAY)),
    "knn_scan_budgets_all": _first(SCAN.format(100, MAY)),
    "first_visible_rank_all": "SELECT query, min(r) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS r FROM d) WHERE list_contains(readers, 'mara') GROUP BY query",
    "within_cutoff_by_topic_all": f"SELECT query, topic, count(*) AS n FROM d WHERE {MAY} AND distance < 1.0 GROUP BY ALL",
}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", WHOLE)
def test_searches_for_all_queries(spark, name):
    d = f"d AS (SELECT a.id AS query, b.id, b.topic, coalesce(b.readers, []) AS readers, round({COS.format(a='a.v', b='b.v')}, 9) AS distance FROM c a, c b WHERE a.id % 20 = 0)"
    _same(spark, name, f"WITH {CHUNKS}, {d} {WHOLE[name]}")


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_prompts_of_all_candidates(spark):
    sql = ORACLE["judge_prompts"].replace("left(text, 200)", "left(text, 1200)").replace("rank <= 3", "rank <= 24")
    _same(spark, "judge_prompts_all", sql)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_recall_of_random_projections(spark):
    from quillmark.operators import nearest
    from quillmark.plans.queries import chunks

    c = chunks(spark, SMALL).select("id", "embedding").cache()
    asked = c.where("id % 20 = 0").orderBy("id").limit(3)
    exact = {}
    for r in nearest.exact_top_k(asked, c, "id", "embedding", 10).collect():
        exact.setdefault(r["query"], set()).add(r.key)
    found = sum(len(exact[q.id] & {r.id for r in nearest.hashed_near(c, q.embedding, "embedding", 10).collect()}) for q in asked.collect())
    assert len(exact) == 3 and found >= 0.9 * 30
