"""Reports on small tables written here, with odd rows, against their SQL."""

import pytest

from quillmark.plans import reports
from quillmark.plans.oracle import ORACLE

QUESTIONS, CANDIDATES = 40, 24


def _words(ord):
    """133 different words of two letters; a fifth of the texts repeat the words that titles are made of."""
    a = [chr(97 + i) + chr(97 + (j + ord) % 26) for i in range(26) for j in range(6)][:133]
    return " ".join(["Harbour", "lights", "harbour"] + a if ord % 5 == 0 else a)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("reports"))
    titles = {1: None, 2: "", 3: "--", 4: "Harbour, LIGHTS harbour ad"}
    texts = {6: None, 7: "", 8: "é" * 399 + " harbour", 9: "海 harbour\r\nharbour_lights lights"}
    rows = [(o, f"{o}#0", "s", "en/x", titles.get(o, f"Lights of harbour {o} ab"), "", texts.get(o, _words(o))) for o in range(60)]
    spark.createDataFrame(rows + rows[:9], "ord int, id string, set_name string, sample string, title string, section string, text string").write.parquet(f"{at}/passages.parquet")
    hits = []
    for q in range(QUESTIONS):
        # The first candidate of question q is passage q; that of question 5 is in no passage. Two more than are taken.
        ids = [999 if q == 5 else q] + [(q + 7 * k) % 60 for k in range(1, CANDIDATES + 2)]
        scores = [float(60 - k // 2) for k in range(len(ids))]
        scores[0] = 99.0
        hits += [(f"q-{q}", 0, ids[:10], scores[:10]), (f"q-{q}", 1, ids[8:] + [None], scores[8:] + [1.0])]
    hits += [(None, 0, [4, 5, 10, 15], [4.0, 3.0, 2.0, 1.0]), ("none", 0, None, None)]
    spark.createDataFrame(hits, "query_id string, shard int, ids array<int>, scores array<double>").write.parquet(f"{at}/hits.parquet")
    spark.createDataFrame([("q-0", "a/b", [1], [0.5])], "query_id string, run string, top array<int>, topsims array<double>").write.parquet(f"{at}/ranked.parquet")
    return at


def _shuffled(node):
    """Rows that a plan that ran wrote to its shuffles."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return _shuffled(node.executedPlan())
    if "QueryStage" in name:
        return _shuffled(node.plan())
    own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    return own + sum(_shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_candidate_bm25_of_odd_rows(spark, tables):
    import duckdb

    db = duckdb.connect()
    for name in ("passages", "hits", "ranked"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    want = db.execute(ORACLE["candidate_bm25"]).fetchall()
    got = [tuple(r) for r in reports.candidate_bm25(spark, tables).select(*[d[0] for d in db.description]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    asked = {r[0] for r in got}
    assert "q-4" in asked and not asked & {None, "none", "q-1", "q-2", "q-3", "q-5"}


def test_candidate_bm25_moves_no_words(spark, tables):
    found = reports.candidate_bm25(spark, tables)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    # A few rows for each candidate; each text has 133 words or more. Nothing is broadcast, as the driver would hold it.
    assert QUESTIONS * CANDIDATES < _shuffled(plan) < 10 * QUESTIONS * CANDIDATES
    assert "Broadcast" not in plan.toString()
