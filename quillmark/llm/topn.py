"""Top N items of every group, by score histograms and an exact ranking of the survivors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.scores import score_bin
from quillmark.session import fits_broadcast


def top_n(rows: DataFrame, group: list[str], score: str, tie: str, n: int, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """The ``n`` highest-scoring rows of every group, with ``place`` from 1; equal scores by smaller ``tie``.

    Method: the scores of every group are counted in monotone bins, by each task for its own rows first, so that a group of
    any size sends bins, not rows. The highest bin with ``n`` rows in it and above it gives the group a lower threshold that
    can't lose a winner; rows below it are dropped where they are. Survivors are ranked exactly with the tie key; Spark cuts
    every task's share of a group to ``n`` rows before they meet (WindowGroupLimit), so even a bin of millions of equal
    scores stays small. Thresholds are broadcast while a checked size allows it, else joined, where a hot group's rows are
    split by adaptive execution. ``keep`` may store the rows, which are read twice.

    Null and NaN scores are never ranked. Repeated rows count as often as they occur; groups with a null key are groups
    like others. A group with fewer than ``n`` rows keeps all. Extra columns pass through, but for one
    named ``place``, which gives way.
    """
    columns = [c for c in rows.columns if c != "place"]
    good = keep(rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))), "scored")
    binned = good.withColumn("_top_bin", score_bin(F.col(score).cast("double")))
    down = Window.partitionBy(*group).orderBy(F.desc("_top_bin")).rowsBetween(Window.unboundedPreceding, 0)
    reach = binned.groupBy(*group, "_top_bin").agg(F.count(F.lit(1)).alias("_top_n")).withColumn("_top_above", F.sum("_top_n").over(down))
    # Groups without n rows have no threshold and keep all.
    floors = keep(reach.where(F.col("_top_above") >= n).groupBy(*group).agg(F.max("_top_bin").alias("_top_floor")), "floors")
    names = {g: f"_top_g{i}" for i, g in enumerate(group)}
    side = floors.select(*[F.col(g).alias(names[g]) for g in group], "_top_floor")
    side = F.broadcast(side) if fits_broadcast(floors, 128) else side
    on = None
    for g in group:
        same = F.col(g).eqNullSafe(F.col(names[g]))
        on = same if on is None else on & same
    left = binned.join(side, on, "left").where(F.col("_top_floor").isNull() | (F.col("_top_bin") >= F.col("_top_floor")))
    best = Window.partitionBy(*group).orderBy(F.desc(score), F.asc(tie))
    return left.select(*columns).withColumn("place", F.row_number().over(best)).where(F.col("place") <= n)
