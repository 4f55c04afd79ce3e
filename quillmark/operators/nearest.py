"""Vector search: exact blocks, permission filters, cutoffs and scan budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions import vector as vc

BLOCK = 1024


def readable(readers: str, by: list[str]) -> Column:
    """Whether any of the readers may read; null readers in the list count for nobody, a missing list for nobody."""
    known = F.filter(F.coalesce(F.col(readers), F.array().cast("array<string>")), lambda r: r.isNotNull())
    return F.arrays_overlap(known, F.array(*[F.lit(x) for x in by]))


def distances(rows: DataFrame, query: DataFrame, vec: str = "embedding") -> DataFrame:
    """Adds ``distance`` to a one-row query with column ``q``."""
    return rows.crossJoin(F.broadcast(query.select("q"))).withColumn("distance", vc.cosine_distance(F.col(vec), F.col("q"))).drop("q")


def inside(rows: DataFrame, cutoff: float, k: int) -> DataFrame:
    """The cutoff within the ordered scan: filter, then take k."""
    return rows.where(F.col("distance") < cutoff).orderBy("distance", "id").limit(k)


def outside(rows: DataFrame, cutoff: float, k: int) -> DataFrame:
    """The cutoff around the limited scan: take k, then filter."""
    return rows.orderBy("distance", "id").limit(k).where(F.col("distance") < cutoff)


def budgeted(rows: DataFrame, may_read: Column, budget: int, k: int, memory_budget: int | None = None) -> DataFrame:
    """What a search that scans ``budget`` nearest rows and filters after it returns.

    The budget stands for an index's candidate list or its scan limits; ``memory_budget``, in rows, stops it sooner. The scan
    is of exact distance, so it shows the failure of filtering late, not an index's own misses.
    """
    most = budget if memory_budget is None else min(budget, memory_budget)
    return rows.orderBy("distance", "id").limit(most).where(may_read).orderBy("distance", "id").limit(k)


def first_visible(rows: DataFrame, may_read: Column) -> DataFrame:
    """One row (rank): the place of the nearest readable row among all rows.

    It is one more than the rows before it, so a count does it without ranking the table.
    """
    best = rows.where(may_read).agg(F.min(F.struct("distance", "id")).alias("b"))
    return rows.join(F.broadcast(best), F.struct("distance", "id") <= F.col("b")).agg(F.count(F.lit(1)).alias("rank"))


def _packed(rows: DataFrame, key: str, vec: str, size: int, apart: str | None = None) -> DataFrame:
    """Blocks of vectors: keys, groups as hashes, and one flat array, so that two blocks meet as matrices."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                if part.num_rows:
                    lists = [pa.array([part.column(i).to_pylist()], pa.list_(pa.int64())) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*lists, pa.array([part.column(2).flatten().to_numpy(zero_copy_only=False)], pa.list_(pa.float64()))], names=["keys", "apart", "flat"])

    group = F.xxhash64(apart) if apart else F.lit(0).cast("long")
    return rows.select(F.col(key).cast("long"), group, F.col(vec).cast("array<double>")).mapInArrow(pack, "keys array<long>, apart array<long>, flat array<double>")


def exact_top_k(queries: DataFrame, rows: DataFrame, key: str, vec: str, k: int, block: int = BLOCK, apart: str | None = None) -> DataFrame:
    """(query, key, distance, rank): the k nearest rows of each query by cosine distance, ties by smaller key.

    A query set of a stated size meets all rows block by block, as products of matrices; of each block only k rows per query
    go on. Vectors have one width and no null elements. With ``apart`` rows that have the query's value of that column are
    left out before anything is ranked.
    """
    q = _packed(queries, key, vec, block, apart).toDF("qk", "qg", "qv")
    r = _packed(rows, key, vec, block * 4, apart).toDF("rk", "rg", "rv")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cells in zip(*(b.column(i) for i in range(6))):
                qk, qg, qv, rk, rg, rv = (x.values.to_numpy(zero_copy_only=False) for x in cells)
                a, c = qv.reshape(len(qk), -1), rv.reshape(len(rk), -1)
                order = np.argsort(rk, kind="stable")
                rk, rg, c = rk[order], rg[order], c[order]
                d = 1.0 - (a @ c.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(c, axis=1))
                d = np.round(d, 9)
                if apart:
                    d[qg[:, None] == rg[None, :]] = np.inf
                most = min(k, len(rk))
                edge = np.partition(d, most - 1, axis=1)[:, most - 1 : most]
                qi, ri = np.nonzero((d <= edge) & (d < np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(qk[qi]), pa.array(rk[ri]), pa.array(d[qi, ri])], names=["query", "key", "distance"])

    met = r.crossJoin(q).select("qk", "qg", "qv", "rk", "rg", "rv").mapInArrow(meet, "query long, key long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "key")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def all_distances(queries: DataFrame, rows: DataFrame, key: str, vec: str, block: int = BLOCK) -> DataFrame:
    """(query, key, distance) of every query and row, for counts over whole tables: it is to be aggregated, not stored."""
    q = _packed(queries, key, vec, block).drop("apart").toDF("qk", "qv")
    r = _packed(rows, key, vec, block).drop("apart").toDF("rk", "rv")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qk, qv, rk, rv in zip(*(b.column(i) for i in range(4))):
                qk, qv, rk, rv = (x.values.to_numpy(zero_copy_only=False) for x in (qk, qv, rk, rv))
                a, c = qv.reshape(len(qk), -1), rv.reshape(len(rk), -1)
                d = np.round(1.0 - (a @ c.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(c, axis=1)), 9)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qk, len(rk))), pa.array(np.tile(rk, len(qk))), pa.array(d.ravel())], names=["query", "key", "distance"])

    return r.crossJoin(q).select("qk", "qv", "rk", "rv").mapInArrow(meet, "query long, key long, distance double")


def hashed_near(rows: DataFrame, query: list[float], vec: str, k: int, width: float = 0.5, tables: int = 8, seed: int = 7) -> DataFrame:
    """An approximate search by random projections, for comparison with the exact one: (id, distance)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = rows.withColumn("_v", array_to_vector(vc.unit(F.col(vec))))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=width, numHashTables=tables, seed=seed).fit(unit)
    size = sum(x * x for x in query) ** 0.5 or 1.0
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / size for x in query]), k, distCol="_d")
    return near.select("id", (F.col("_d") * F.col("_d") / 2).alias("distance"))


def distances_to(rows: DataFrame, query: list[float], vec: str = "embedding") -> DataFrame:
    """Adds ``distance`` to one query vector in place of ``vec``, as products of matrices, a batch at a time."""
    q = np.asarray(query, dtype=np.float64)
    others = [f for f in rows.schema.fields if f.name != vec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            d = np.round(1.0 - x @ q / (np.linalg.norm(x, axis=1) * np.linalg.norm(q)), 9)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(d)], names=[*(f.name for f in others), "distance"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", distance double"
    return rows.select(*[f.name for f in others], vec).mapInArrow(run, schema)


def crowded_corpus(spark, dims: int, far: int, hidden: int, near: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(chunks, query): vectors anywhere, unreadable ones crowding the query, and a few readable ones further out.

    Every element is a draw of the counter-based stream, so the table is the same however it is partitioned.
    """
    from quillmark.functions.numeric import uniform_array

    centre = uniform_array(np.arange(dims), seed) - 0.5

    def vectors(ids: np.ndarray, spread: float, around: bool) -> np.ndarray:
        noise = uniform_array((ids[:, None] + 1) * dims + np.arange(dims), seed) - 0.5
        return (centre + spread * noise if around else noise).astype(np.float32)

    def part(start: int, n: int, topic: str, reader: str, spread: float, around: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                flat = pa.array(vectors(b.column(0).to_numpy(), spread, around).ravel())
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dims)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["id", "embedding"])

        rows = spark.range(start, start + n).mapInArrow(run, "id long, embedding array<float>")
        return rows.select("id", F.lit(topic).alias("topic"), F.array(F.lit(reader)).alias("readers"), "embedding")

    chunks = part(1, far, "other", "everyone", 1.0, False).unionByName(part(far + 1, hidden, "restructuring", "hr", 0.6, True)).unionByName(part(far + hidden + 1, near, "team notes", "liv", 1.2, True))
    asked = vectors(np.array([far + hidden + near + 1]), 0.3, True)[0]
    return chunks, spark.createDataFrame([([float(x) for x in asked],)], "q array<float>")


def _site_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of one language of rows (lang, key, label, site, vec): keys, labels, sites and one flat array."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            for lang in sorted({x for x in langs if x is not None}):
                own = b.take(pa.array(np.flatnonzero(langs == lang)))
                for at in range(0, own.num_rows, size):
                    p = own.slice(at, size)
                    lists = [pa.array([p.column(i).to_pylist()], pa.list_(t)) for i, t in ((1, pa.int64()), (2, pa.string()), (3, pa.string()))]
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), *lists, pa.array([p.column(4).flatten().to_numpy(zero_copy_only=False)], pa.list_(pa.float64()))], names=["lang", "keys", "labels", "sites", "flat"])

    picked = rows.select("lang", F.col("key").cast("long"), "label", "site", F.col("vec").cast("array<double>"))
    return picked.mapInArrow(pack, "lang string, keys array<long>, labels array<string>, sites array<string>, flat array<double>")


def _met(qs, qv, rs, rv) -> tuple[np.ndarray, np.ndarray]:
    """(distances, whether the sites differ) of two blocks; missing sites count as one site."""
    a, c = (x.values.to_numpy(zero_copy_only=False) for x in (qv, rv))
    a, c = a.reshape(len(qs), -1), c.reshape(len(rs), -1)
    d = np.round(1.0 - (a @ c.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(c, axis=1)), 12)
    return d, np.array(qs.as_py(), dtype=object)[:, None] != np.array(rs.as_py(), dtype=object)[None, :]


def unrelated_statistics(queries: DataFrame, rows: DataFrame, keys: list[str], probs: dict[str, float], keep: Callable[[DataFrame, str], DataFrame], size: int = BLOCK, bins: int = 4096) -> DataFrame:
    """(keys, n, least, stat, value): order statistics, by nearest rank, of the distances of queries (lang, label, site, vec) to
    rows of their language but another site; ``keys`` are ``lang``, ``label`` or both.

    Queries, a set of a stated size, meet rows as products of matrices. No pair is written: a task counts its blocks'
    distances in ``bins`` over 0 to 2, and in a second round gives only the values of the bins that hold a wanted rank. Blocks
    are stored, so that both rounds see the same numbers.
    """
    q = keep(_site_blocks(queries.withColumn("key", F.lit(0)), size), "asked").toDF("lang", "qk", "ql", "qs", "qv")
    r = keep(_site_blocks(rows.withColumn("label", F.lit(None).cast("string")), size * 4), "rows").toDF("lang", "rk", "rl", "rs", "rv")
    met = q.join(r, "lang").select("lang", "ql", "qs", "qv", "rs", "rv")
    which = lambda d: np.clip((d * (bins / 2)).astype(np.int64), 0, bins - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, ql, qs, qv, rs, rv in zip(*(b.column(i) for i in range(6))):
                d, other = _met(qs, qv, rs, rv)
                labels = np.array(ql.as_py(), dtype=object)
                for label in sorted(set(labels) - {None}):
                    mine = labels == label
                    values = d[mine][other[mine]]
                    if len(values):
                        n = np.bincount(which(values), minlength=bins)
                        at = np.flatnonzero(n)
                        same = [pa.array([x] * len(at), pa.string()) for x in (lang.as_py(), label)]
                        yield pa.RecordBatch.from_arrays([*same, pa.array(at), pa.array(n[at]), pa.array(np.full(len(at), values.min()))], names=["lang", "label", "bin", "n", "least"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, ql, qs, qv, rs, rv, want in zip(*(b.column(i) for i in range(7))):
                d, other = _met(qs, qv, rs, rv)
                labels = np.array(ql.as_py(), dtype=object)
                for label in sorted(set(labels) - {None}):
                    held = [x["bin"] for x in want.as_py() if x["label"] in (None, label)]
                    mine = labels == label
                    values = d[mine][other[mine]]
                    values = values[np.isin(which(values), held)]
                    distinct, n = np.unique(values, return_counts=True)
                    same = [pa.array([x] * len(distinct), pa.string()) for x in (lang.as_py(), label)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(which(distinct)), pa.array(distinct), pa.array(n)], names=["lang", "label", "bin", "value", "n"])

    counts = met.mapInArrow(count, "lang string, label string, bin long, n long, least double").groupBy(*keys, "bin").agg(F.sum("n").alias("c"), F.min("least").alias("least"))
    every = Window.partitionBy(*keys)
    upto = F.sum("c").over(every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(every)).withColumn("least", F.min("least").over(every))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.lit(v).alias("q")) for k, v in probs.items()])).alias("s")
    wanted = counts.select("*", asked).withColumn("rank", F.floor(F.col("s.q") * (F.col("n") - 1) + 0.5)).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    wanted = keep(wanted.select(*keys, "bin", "n", "least", F.col("s.stat").alias("stat"), (F.col("rank") - F.col("upto") + F.col("c")).alias("inner")), "wanted")
    label = F.col("label") if "label" in keys else F.lit(None).cast("string")
    held = F.collect_set(F.struct(label.alias("label"), "bin")).alias("want")
    second = met.join(F.broadcast(wanted.groupBy("lang").agg(held)), "lang") if "lang" in keys else met.crossJoin(F.broadcast(wanted.agg(held)))
    values = second.select("lang", "ql", "qs", "qv", "rs", "rv", "want").mapInArrow(pick, "lang string, label string, bin long, value double, n long").groupBy(*keys, "bin", "value").agg(F.sum("n").alias("c"))
    values = values.withColumn("upto", F.sum("c").over(Window.partitionBy(*keys, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    found = wanted.join(values, [*keys, "bin"]).where((F.col("inner") < F.col("upto")) & (F.col("inner") >= F.col("upto") - F.col("c")))
    return found.select(*keys, "n", "least", "stat", "value")
