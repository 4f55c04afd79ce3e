"""The call log as a stream: resumable appends, latest rows, windowed figures. Extensions beyond batch parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillmark.operators.calls import CALL


def read(spark: SparkSession, path: str, schema: T.StructType, format_: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.format(format_).load(path)


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None, order: str = "line_no") -> StreamingQuery:
    """Appends each batch's latest row per call to ``path``, a folder per batch.

    A batch that runs again after a failure replaces its own folder, so nothing is counted twice. ``latest_of`` reads the
    result; the checkpoint stands in for a list of finished calls.
    """

    def store(batch: DataFrame, number: int) -> None:
        w = Window.partitionBy(*(keys or CALL)).orderBy(F.desc(order))
        rows = batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_of(spark: SparkSession, path: str, keys: list[str] | None = None, order: str = "line_no") -> DataFrame:
    from quillmark.operators.calls import latest

    return latest(spark.read.parquet(path), keys, order)


def usage(stream: DataFrame, at: str = "at", width: str = "60 seconds", step: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """Calls, failures and tokens per ranker in sliding windows; rows later than the watermark are dropped."""
    rows = stream.withWatermark(at, late)
    return rows.groupBy(F.window(at, width, step), "ranker").agg(
        F.count(F.lit(1)).alias("calls"), F.count("error").alias("failures"), F.sum(F.coalesce("inputtokens", F.lit(0)) + F.coalesce("outputtokens", F.lit(0))).alias("tokens")
    )
