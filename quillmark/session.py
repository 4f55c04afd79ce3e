"""Session helpers: tables, durable intermediate results, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, name: str = "quillmark", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUILLMARK_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    A private folder is made only where the setting is absent and the master is local, as in tests; a cluster without the
    setting is an error, as its machines would each write to a folder of their own.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillmark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = f"file://{folder}"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage like a checkpoint, but computes the plan a single time, keeps columns prunable, and
    survives the loss of executors. Results read it lazily, so it stays until the application ends or ``drop_durable``.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_CLEANED: set[str] = set()


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _CLEANED:
        _CLEANED.add(app)
        atexit.register(_drop_at_end, spark, app)
    return f"{shared_dir(spark)}/quillmark/{app}"


def _drop_at_end(spark: SparkSession, app: str) -> None:
    if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == app:
        drop_durable(spark)


def drop_durable(spark: SparkSession) -> None:
    """Deletes all that ``durable`` wrote for this application, when no result that reads it is in use any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(df: DataFrame, row_bytes: int, budget: int = 32 << 20) -> bool:
    """True when ``df`` has at most ``budget // row_bytes`` rows; reads no more than one row beyond that."""
    most = budget // row_bytes
    return df.limit(most + 1).count() <= most
