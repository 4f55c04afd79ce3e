"""Sources, sinks and streams on small files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark import schemas
from quillmark.session import drop_durable, durable, fits_broadcast
from quillmark.sources import files, sets, sinks
from quillmark.streaming import log


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\n"), ("b", None)], "id string, text string")
    sinks.json_lines(df, str(tmp_path / "j"))
    sinks.json_lines(df.limit(1), str(tmp_path / "j"), append=True)
    assert files.json_lines(spark, str(tmp_path / "j"), schemas.QUERIES).count() == 3
    (tmp_path / "blank.jsonl").write_text('{"id":"a"}\n\n{"id":"b"}\n')
    assert files.json_lines(spark, str(tmp_path / "blank.jsonl"), schemas.QUERIES).count() == 2


def test_call_log_file(spark, tmp_path):
    lines = [{"ranker": "r", "repeat": 1, "question": "q", "scores": [1, 2], "at": "2026-10-01T10:00:00.000Z"}, {"ranker": "r", "repeat": 1, "question": "q", "error": "429"}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = files.call_log(spark, str(tmp_path / "log.jsonl")).orderBy("line_no").collect()
    assert rows[0].scores == [1, 2] and rows[0].at.year == 2026 and rows[1].error == "429" and rows[1].at is None


def test_scored_sets(spark, tmp_path):
    (tmp_path / "host" / "model").mkdir(parents=True)
    doc = {"summary": {}, "scores": [{"id": "q1", "dense": {"ndcg10": 0.5}, "fused": {"0.9": {"ndcg10": 0.7, "semantic": 3}}, "gold": [0.2], "random": [0.9, 1.0], "nearestOther": 0.4}]}
    (tmp_path / "host" / "model" / "set-en.json").write_text(json.dumps(doc))
    (tmp_path / "host" / "model" / "set-en.half.json").write_text(json.dumps(doc))
    rows = files.scored_sets(spark, str(tmp_path)).collect()
    assert {(r.backend, r.model, r.set_name, r.variant) for r in rows} == {("host", "model", "set-en", None), ("host", "model", "set-en", "half")}
    assert rows[0].random == [0.9, 1.0] and rows[0].fused["0.9"].semantic == 3


def test_float_matrix(spark, tmp_path):
    x = np.arange(1, 13, dtype="<f4")
    (tmp_path / "v.f32").write_bytes(x.tobytes())
    rows = files.float_matrix(spark, str(tmp_path / "v.f32"), 4, 3).orderBy("ord").collect()
    assert [r.vec for r in rows] == x.reshape(3, 4).tolist()
    (tmp_path / "z.f32").write_bytes(np.zeros(4, dtype="<f4").tobytes())
    for name, dims in (("z.f32", 4), ("v.f32", 5)):
        with pytest.raises(Exception):
            files.float_matrix(spark, str(tmp_path / name), dims).collect()


def test_collections(spark, tmp_path):
    write = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    write([("d1", "T", "x"), ("d2", "", "y")], "id string, title string, text string", "m/corpus")
    write([("q1", "one"), ("q2", "two")], "id string, text string", "m/queries")
    write([("q1", "d1", 1), ("q2", "d2", 0)], "`query-id` string, `corpus-id` string, score long", "m/qrels")
    c = sets.load(spark, "titled", str(tmp_path / "m"), "m-en", language="en")
    assert {r.doc: r.text for r in c.passages.collect()} == {"d1": "T\n\nx", "d2": "y"} and [r["query"] for r in c.queries.collect()] == ["q1"]
    write([("1", "x")], "id string, content string", "b/documents")
    write([("9", "why", ["1"], ["N/A"]), ("8", "how", ["1"], ["2"])], "id string, query string, gold_ids array<string>, excluded_ids array<string>", "b/examples")
    b = sets.load(spark, "lists", str(tmp_path / "b"), "b")
    assert b.judged.count() == 2 and [tuple(r) for r in b.excluded.collect()] == [("8", "2")]
    write([(7, "x")], "id int, text string", "p/corpus")
    write([(1, "q")], "id int, text string", "p/queries")
    write([("1", "7", 1)], "qid string, pid string, score long", "p/qrels")
    assert sets.load(spark, "plain", str(tmp_path / "p"), "p").queries.first()["query"] == "1"
    with pytest.raises(ValueError):
        sets.load(spark, "other", "", "")


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 0.5), ("a", "y", 0.25), ("b", "x", None)], "run string, s string, v double")
    sinks.report_json(df, str(tmp_path / "r.json"), ["run", "s"])
    assert json.loads((tmp_path / "r.json").read_text())["a"]["y"]["v"] == 0.25
    table = sinks.markdown(df, {"run": F.col("run"), "v": F.format_string("%.1f", "v")}, [F.desc("v"), F.col("run")])
    assert table.splitlines()[0] == "| run | v |" and table.splitlines()[2] == "| a | 0.5 |"
    assert sinks.spliced("a<s>old<e>b", "<s>", "<e>", "new") == "a<s>\nnew\n<e>b"
    assert sinks.fixed_width(df, {"run": 3, "v": 5}).first().line == "a     0.5"
    sinks.by_run(df, str(tmp_path / "t"), ["run"])
    sinks.by_run(df.where("run = 'b'").withColumn("v", F.lit(1.0)), str(tmp_path / "t"), ["run"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_durable_tables(spark):
    df = spark.range(10).withColumn("x", F.rand())
    kept = durable(df, "t")
    assert sorted(kept.collect()) == sorted(kept.collect()) and kept.dtypes == df.dtypes and kept.count() == 10
    assert fits_broadcast(df, 100) and not fits_broadcast(df, 100, 500)
    drop_durable(spark)
    with pytest.raises(Exception):
        kept.collect()
    assert not files.exists(spark, "no_such_table") and files.series(spark, 3, 5).count() == 3


def test_streamed_log(spark, tmp_path):
    schema = "line_no long, machine string, ranker string, repeat_no int, question string, error string, inputtokens long, outputtokens long, at timestamp"
    import datetime as dt

    at = dt.datetime(2026, 3, 2, 10)
    put = lambda rows: spark.createDataFrame([(*r, 1, 2, at) for r in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, "m", "r", 1, "q", "429"), (2, "m", "r", 1, "p", None)])
    stream = lambda: log.read(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    log.keep_latest(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    put([(3, "m", "r", 1, "q", None)])
    log.keep_latest(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.line_no for r in log.latest_of(spark, str(tmp_path / "out")).collect()) == [2, 3]
    q = log.usage(stream(), step="60 seconds").writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(calls), sum(failures), sum(tokens) FROM usage").first()[0:3] == (3, 1, 9)
