"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which a source's records are cut when its fractional repetition is drawn.
PARTS = 1024


def water_fill(weights: dict, sizes: dict, caps: dict, total: float) -> dict:
    """Size that each source gives: its share of ``total``, at most its cap times its size.

    Sources that can't reach their share are clamped to all they can give; what they lack is spread over the others in
    proportion to their weights, until nobody exceeds the cap. If all are clamped the total isn't reached.
    """
    most = {s: max(0, caps[s] or 0) * sizes.get(s, 0) for s in weights}
    given = {s: 0.0 for s in weights}
    free = {s for s in weights if (weights[s] or 0) > 0 and most[s] > 0}
    rest = float(total)
    while free:
        scale = rest / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * scale >= most[s]}
        if not over:
            given |= {s: weights[s] * scale for s in free}
            break
        for s in sorted(over, key=str):
            given[s] = float(most[s])
            rest -= most[s]
        free -= over
    return given


def mix(sizes: DataFrame, weights: DataFrame, keep: Callable[[DataFrame, str], DataFrame], total: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(records, shares): how often each record goes into the mixture, and what each source contributes.

    ``sizes`` has (doc_id, source, tokens), ``weights`` (source, weight, max_repeats), a configuration table of few rows.
    ``total`` is the size of the mixture, by default the size of all records of weighted sources. records: (doc_id,
    source, tokens, copies) of every record; copies is 0 for sources without a weight, and never above max_repeats.
    shares: (source, weight, max_repeats, available, target, epochs, tokens, share) of every weighted source.

    A source repeated e times gives each record floor(e) times, and once more those records that come first in a seeded
    order, up to the fraction of its size that e - floor(e) asks for; a record across the line is taken if at least half
    of it lies before. Sums run over hash parts, so one source may hold any part of all rows. A null source matches no
    weight; rows with one doc_id are one record, the largest; records of 0 tokens (null or empty texts) get no copies.
    """
    rows = sizes.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("r")).select("doc_id", "r.source", "r.tokens")
    rows = keep(rows.withColumn("_h", F.xxhash64(F.col("doc_id"), F.lit(seed))), "records")
    wanted = weights.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    config = {r["source"]: r for r in wanted.collect()}
    # A row for each weighted source.
    totals = {r["source"]: r["n"] for r in rows.join(F.broadcast(wanted.select("source")), "source").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(totals.values()) if total is None else total
    given = water_fill({s: r["weight"] for s, r in config.items()}, totals, {s: r["max_repeats"] for s, r in config.items()}, total)
    spark = sizes.sparkSession
    aims = []
    for s, r in config.items():
        available = totals.get(s, 0)
        epochs = given[s] / available if available else 0.0
        whole = min(int(epochs + 1e-9), max(0, r["max_repeats"] or 0))
        aims.append((s, r["weight"], r["max_repeats"], available, given[s], epochs, whole, max(0.0, given[s] - whole * available)))
    aim = spark.createDataFrame(aims, "source string, weight double, max_repeats int, available long, target double, epochs double, whole int, extra double")
    with_aim = rows.join(F.broadcast(aim.select("source", "whole", "extra", "max_repeats")), "source", "left").withColumn("_part", F.pmod(F.col("_h"), F.lit(PARTS)).cast("int"))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = with_aim.where("extra > 0").groupBy("source", "_part").agg(F.sum("tokens").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    in_part = Window.partitionBy("source", "_part").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    # Of each source only the part that the line crosses is put in order.
    drawn = with_aim.join(parts, ["source", "_part"], "left")
    whole_part = F.col("_start") + F.col("_n") <= F.col("extra")
    none_part = F.col("_start") >= F.col("extra")
    edge = drawn.where(F.col("extra").isNotNull() & (F.col("extra") > 0) & ~whole_part & ~none_part)
    edge = edge.withColumn("_at", F.col("_start") + F.coalesce(F.sum("tokens").over(in_part), F.lit(0))).withColumn("more", (F.col("_at") + F.col("tokens") / 2 <= F.col("extra")).cast("int"))
    rest = drawn.where(F.col("extra").isNull() | (F.col("extra") <= 0) | whole_part | none_part).withColumn("more", F.when((F.col("extra") > 0) & whole_part, 1).otherwise(0))
    columns = ["doc_id", "source", "tokens", "whole", "more", "max_repeats"]
    both = edge.select(*columns).unionByName(rest.select(*columns))
    copies = F.when(F.col("tokens") > 0, F.least(F.coalesce(F.col("whole"), F.lit(0)) + F.col("more"), F.coalesce(F.greatest("max_repeats", F.lit(0)), F.lit(0)))).otherwise(0).cast("int")
    records = keep(both.select("doc_id", "source", "tokens", copies.alias("copies")), "mixed")
    got = records.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    all_ = got.agg(F.sum("tokens").alias("_all"))
    shares = aim.drop("whole", "extra").join(got, "source", "left").crossJoin(F.broadcast(all_))
    return records, shares.select("source", "weight", "max_repeats", "available", "target", "epochs", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.try_divide(F.coalesce("tokens", F.lit(0)), "_all").alias("share"))
