"""Order statistics over groups of any size, and seeded bootstraps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.numeric import uniform, uniform_array
from quillmark.session import durable, fits_broadcast

DRAWS = 2000


def _bin(x: Column) -> Column:
    size = F.floor(F.log2(F.lit(1.0) + F.least(F.abs(x), F.lit(1e290)) * F.lit(float(2**30))) * F.lit(128.0))
    return F.when(x < 0, -size).otherwise(size).cast("int")


def order_statistics(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], nearest: bool = False) -> DataFrame:
    """(keys, n, stat, value): named quantiles of every group, exactly.

    Interpolated between neighbours, or the nearest rank round(q (n - 1)). Values are counted in monotone bins first, with
    partial aggregation; only the bins that hold the wanted ranks are then looked at, by distinct value. So no group is
    sorted or collected whole. Null and NaN values don't count; a null key is a key; groups without values give no row.
    """
    good = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v")).withColumn("_b", _bin(F.col("_v")))
    bins = good.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    every = Window.partitionBy(*keys)
    upto = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("_upto", F.sum("_c").over(upto)).withColumn("n", F.sum("_c").over(every))
    place = lambda q: (F.col("n") - 1) * F.lit(float(q))
    if nearest:
        wanted = F.array(*[F.struct(F.lit(s).alias("stat"), F.lit(0.0).alias("part"), F.floor(place(q) + 0.5).alias("r"), F.floor(place(q) + 0.5).alias("r2")) for s, q in probs.items()])
    else:
        wanted = F.array(*[F.struct(F.lit(s).alias("stat"), (place(q) - F.floor(place(q))).alias("part"), F.floor(place(q)).alias("r"), F.ceil(place(q)).alias("r2")) for s, q in probs.items()])
    asked = bins.select(*keys, "_b", "n", (F.col("_upto") - F.col("_c")).alias("_below"), "_upto", F.explode(wanted).alias("w"))
    asked = asked.select(*keys, "_b", "n", "_below", "_upto", "w.stat", "w.part", F.explode(F.array_distinct(F.array("w.r", "w.r2"))).alias("rank"))
    asked = asked.where((F.col("rank") >= F.col("_below")) & (F.col("rank") < F.col("_upto")))
    # Distinct values of the wanted bins, with their counts.
    targets = asked.select(*keys, "_b").distinct()
    a, t = good.alias("a"), targets.alias("t")
    same = F.col("a._b") == F.col("t._b")
    for c in keys:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}"))
    near = a.join(t, same, "left_semi").groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_in", F.sum("_c").over(inner))
    a, t = asked.alias("a"), near.alias("t")
    found = a.join(t, same & (F.col("a.rank") - F.col("a._below") >= F.col("t._in") - F.col("t._c")) & (F.col("a.rank") - F.col("a._below") < F.col("t._in")))
    found = found.select(*[F.col(f"a.{c}") for c in keys], "n", "stat", "part", "rank", "_v")
    low, high = F.min_by("_v", "rank"), F.max_by("_v", "rank")
    return found.groupBy(*keys, "n", "stat", "part").agg((low + (high - low) * F.col("part")).alias("value")).drop("part")


def _indexed(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Numbers the rows of a group from 0: a sample that is resampled is of questions, thousands of them, not of data. It is
    stored, as it is read for its size, for each draw and for its mean."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = rows.select(*by, *order, F.col(value).cast("double").alias("_x")).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return durable(numbered, "sample")


def _draws(rows: DataFrame, draws: int) -> DataFrame:
    spark = rows.sparkSession
    return spark.range(0, draws, 1, max(spark.sparkContext.defaultParallelism, draws // 500)).select(F.col("id").alias("draw"))


def _resampled(sample: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame | None:
    """(_g, draw, mean): means of resamples, where the sample is small enough to be sent to every task; else None.

    ``_g`` numbers the groups of ``by``, ordered by it. Draw b takes ``_all`` numbers of the stream; a group's start after
    ``_before``. A task draws for whole groups at once with arrays, and gives one row a draw and group.
    """
    if not fits_broadcast(sample, 64):
        return None
    held = sample.select("_g", "_before", "_all", "_i", "_x").toPandas().sort_values(["_g", "_i"])
    groups = [(int(g), int(d["_before"].iloc[0]), int(d["_all"].iloc[0]), d["_x"].to_numpy()) for g, d in held.groupby("_g")]
    shared = sample.sparkSession.sparkContext.broadcast(groups)

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draw = b.column(0).to_numpy()
            for g, before, every, x in shared.value:
                means = np.empty(len(draw))
                step = max(1, (1 << 21) // max(len(x), 1))
                for at in range(0, len(draw), step):
                    numbers = draw[at : at + step, None].astype(np.uint64) * np.uint64(every) + np.uint64(before) + np.arange(len(x), dtype=np.uint64)
                    picked = (uniform_array(numbers, seed) * len(x)).astype(np.int64)
                    means[at : at + step] = x[picked].mean(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(draw), g, dtype=np.int64)), pa.array(draw), pa.array(means)], names=["_g", "draw", "mean"])

    return _draws(sample, draws).mapInArrow(resample, "_g long, draw long, mean double")


def _means(sample: DataFrame, by: list[str], draws: int, seed: int) -> DataFrame:
    """(by, draw, mean): means of resamples. Draw b takes numbers b n to b n + n - 1 of the stream, as one generator would."""
    groups = sample.groupBy(*by).agg(F.max("_n").alias("_n"))
    numbered = groups.withColumn("_g", F.xxhash64(*by))
    each = sample.drop("_n").join(numbered, by) if by else sample.drop("_n").crossJoin(numbered)
    found = _resampled(each.select("_g", F.lit(0).alias("_before"), F.col("_n").alias("_all"), "_i", "_x"), by, draws, seed)
    if found is not None:
        return found.join(F.broadcast(numbered.drop("_n")), "_g").drop("_g")
    # The draws are the side that is spread over tasks; groups are few.
    each = _draws(sample, draws).crossJoin(F.broadcast(groups) if fits_broadcast(groups, 64) else groups).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    picked = each.withColumn("_i", F.floor(uniform(F.col("draw") * F.col("_n") + F.col("_k"), seed) * F.col("_n")).cast("int"))
    return picked.join(sample.select(*by, "_i", "_x"), [*by, "_i"]).groupBy(*by, "draw").agg(F.avg("_x").alias("mean"))


def interval_of_mean(rows: DataFrame, by: list[str], order: list[str], value: str, draws: int = DRAWS, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """(by, n, mean, low, high): the percentile interval at level 1 - alpha, interpolated."""
    sample = _indexed(rows, by, order, value)
    means = _means(sample, by, draws, seed)
    ends = means.groupBy(*by).agg(F.percentile("mean", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_p"))
    real = sample.groupBy(*by).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"))
    return real.join(ends, by).select(*by, "n", "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def paired_interval(rows: DataFrame, by: list[str], order: list[str], diff: str, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """(by, n, mean, low, high) of paired differences, the ends being order statistics floor(.025 B) and ceil(.975 B) - 1."""
    sample = _indexed(rows, by, order, diff)
    means = _means(sample, by, draws, seed)
    listed = means.groupBy(*by).agg(F.sort_array(F.collect_list("mean")).alias("_m"))
    lo, hi = int(0.025 * draws), -(-975 * draws // 1000) - 1
    real = sample.groupBy(*by).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"))
    return real.join(listed, by).select(*by, "n", "mean", F.col("_m")[lo].alias("low"), F.col("_m")[hi].alias("high"))


def stratified_interval(rows: DataFrame, stratum: str, order: list[str], diff: str, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """One row (mean, low, high): mean of the strata's mean differences. One stream runs through the strata of a draw in
    their order, so a stratum's numbers start where the strata before it end; ends are nearest ranks."""
    sample = _indexed(rows, [stratum], order, diff)
    sizes = sample.groupBy(stratum).agg(F.max("_n").alias("_n"))
    one = Window.partitionBy(F.lit(1)).orderBy(stratum)  # a row per stratum
    sizes = sizes.withColumn("_before", F.sum("_n").over(one.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    numbered = sizes.withColumn("_g", F.xxhash64(stratum))
    found = _resampled(sample.drop("_n").join(numbered, stratum), [stratum], draws, seed)
    each = _draws(rows, draws).crossJoin(F.broadcast(sizes) if fits_broadcast(sizes, 64) else sizes).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    picked = each.withColumn("_i", F.floor(uniform(F.col("draw") * F.col("_all") + F.col("_before") + F.col("_k"), seed) * F.col("_n")).cast("int"))
    if found is None:
        found = picked.join(sample.select(stratum, "_i", "_x"), [stratum, "_i"]).groupBy("draw", stratum).agg(F.avg("_x").alias("mean"))
    means = found.groupBy("draw").agg(F.avg("mean").alias("m"))
    at = lambda q: int(q * (draws - 1) + 0.5)
    ends = means.agg(F.sort_array(F.collect_list("m")).alias("_m")).select(F.col("_m")[at(0.025)].alias("low"), F.col("_m")[at(0.975)].alias("high"))
    real = sample.groupBy(stratum).agg(F.avg("_x").alias("m")).agg(F.avg("m").alias("mean"))
    return real.crossJoin(ends)


def verdict(low: Column, high: Column) -> Column:
    return F.when(low > 0, "better").when(high < 0, "worse").otherwise("no difference")
