"""Reading: parquet, JSON lines, scored sets, raw float matrices, generated rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark import schemas


def parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Whole files, folders or globs such as ``data/test*.parquet``; columns are pruned by what is used."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """One JSON value a line; blank lines are skipped. Strict reading fails on a malformed line, else it is null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def call_log(spark: SparkSession, path: str) -> DataFrame:
    """An appended call log with ``line_no``, the order of appending: by file, then place in it."""
    rows = spark.read.schema(schemas.LOG_LINE).option("mode", "FAILFAST").json(path)
    return rows.withColumn("at", F.to_timestamp("at")).withColumn("line_no", F.monotonically_increasing_id())


def scored_sets(spark: SparkSession, root: str) -> DataFrame:
    """Question scores of all ``<backend>/<model>/<set>[.variant].json`` below a folder, keyed by the parts of their path."""
    docs = spark.read.schema(schemas.SCORED_SET).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
    path = F.col("_metadata.file_path")
    part = lambda i: F.url_decode(F.regexp_extract(path, r"([^/]+)/([^/]+)/([^/.]+)(?:\.([^/]+))?\.json$", i))
    rows = docs.select(part(1).alias("backend"), part(2).alias("model"), part(3).alias("set_name"), F.nullif(part(4), F.lit("")).alias("variant"), F.explode("scores").alias("s"))
    return rows.select("backend", "model", "set_name", "variant", "s.*")


def float_matrix(spark: SparkSession, path: str, dims: int, count: int | None = None) -> DataFrame:
    """(path, ord, vec) of raw little-endian 32-bit rows; the length must fit and no row may be all zero."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for name, content in zip(df["path"], df["content"]):
                x = np.frombuffer(content, dtype="<f4")
                if len(x) % dims or (count is not None and len(x) != count * dims):
                    raise ValueError(f"{name} holds {len(x)} numbers, not {count if count is not None else 'a multiple of'} x {dims}")
                x = x.reshape(-1, dims)
                if len(x) and not x.any(axis=1).all():
                    raise ValueError(f"{name} has a row of zeros")
                for at in range(0, len(x), 4096):
                    part = x[at : at + 4096]
                    yield pd.DataFrame({"path": name, "ord": np.arange(at, at + len(part)), "vec": list(part)})

    return files.mapInPandas(rows, "path string, ord long, vec array<float>")


def series(spark: SparkSession, first: int, last: int, name: str = "n") -> DataFrame:
    return spark.range(first, last + 1).toDF(name)


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
