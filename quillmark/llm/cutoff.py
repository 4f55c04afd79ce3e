"""Score cutoffs that keep a target fraction of every source, by multi-sequence selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Values of a source at which it is finished in one task; also the longest sorted run in one row.
SMALL = 4096
#: Values that every run shows in a round.
SHOWN = 64
#: Rows that a task sorts at a time.
CHUNK = 1 << 18

RUNS = "source long, values array<double>"


def _sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    schema = pa.schema([("source", pa.int64()), ("values", pa.list_(pa.float64()))])

    def flush() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by("source", use_threads=False).aggregate([("value", "list")]).combine_chunks()
        out = []
        for key, v in zip(t.column("source").to_pylist(), t.column("value_list").combine_chunks()):
            x = np.sort(v.values.to_numpy(zero_copy_only=False))
            out += [(key, x[i : i + SMALL].tolist()) for i in range(0, len(x), SMALL)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= CHUNK:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def _show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run its active size and up to SHOWN evenly spaced pivots, the last value among them."""
    schema = pa.schema([("source", pa.int64()), ("active", pa.int64()), ("pivots", pa.list_(pa.float64()))])
    for b in batches:
        out = []
        for key, v in zip(b.column(0).to_pylist(), b.column(1)):
            x = v.values.to_numpy(zero_copy_only=False)
            at = np.unique(np.linspace(0, len(x) - 1, min(SHOWN, len(x))).astype(int))
            out.append((key, len(x), x[at].tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, by searchsorted, of the values at or below each of the source's pivots."""
    schema = pa.schema([("source", pa.int64()), ("counts", pa.list_(pa.int64()))])
    for b in batches:
        out = []
        for key, v, p in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            x, y = v.values.to_numpy(zero_copy_only=False), p.values.to_numpy(zero_copy_only=False)
            out.append((key, np.searchsorted(x, y, "right").tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slice of each run between the source's bounds, above ``lo`` and at or below ``hi``."""
    schema = pa.schema([("source", pa.int64()), ("values", pa.list_(pa.float64()))])
    for b in batches:
        out = []
        for key, v, lo, hi in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
            x = v.values.to_numpy(zero_copy_only=False)
            x = x[np.searchsorted(x, lo, "right") : np.searchsorted(x, hi, "right")]
            if len(x):
                out.append((key, x.tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _finish(t: pa.Table) -> pa.Table:
    """The largest value with at most ``room`` values at or below it, counting ``base`` values below all."""
    n, base, share = (t.column(c)[0].as_py() for c in ("n", "base", "share"))
    x = np.sort(np.concatenate([v.values.to_numpy(zero_copy_only=False) for v in t.column("values").combine_chunks()]))
    values, counts = np.unique(x, return_counts=True)
    fits = (base + np.cumsum(counts)) / n <= share
    k = int(fits.sum())
    cutoff = float(values[k - 1]) if k else t.column("best")[0].as_py()
    kept = base + int(counts[:k].sum())
    return pa.table({"source": t.column("source").slice(0, 1), "cutoff": pa.array([cutoff], pa.float64()), "kept": pa.array([kept], pa.int64()), "n": pa.array([n], pa.int64())})


def cutoffs(values: DataFrame, targets: DataFrame, keep: Callable[[DataFrame, str], DataFrame], small: int = SMALL) -> DataFrame:
    """(source, cutoff, kept, n): per source the largest value such that the share of values at or below it is at
    most the source's target share; null with ``kept`` 0 where even the smallest value exceeds it.

    ``values`` has (source BIGINT, value DOUBLE), free of null and NaN, ``targets`` (source, share). Method: every task
    sorts its values into runs of at most ``SMALL`` and stores them once. In a round each run shows evenly spaced
    pivots, the pivots of a source are ranked in all its runs by searchsorted, and the two pivots around the target
    rank become the source's new bounds; only the slices between them stay. A round leaves about two in SHOWN of a
    source's values, or more where a value recurs; a source with at most ``small`` values left, or one value, is
    finished exactly. Sources of all sizes go through the rounds at once; a large source is many runs in many tasks.
    """
    runs = keep(values.select("source", "value").mapInArrow(_sort_runs, RUNS), "runs")
    sizes = runs.groupBy("source").agg(F.sum(F.size("values")).cast("long").alias("n"))
    state = keep(
        sizes.join(targets.select("source", "share"), "source").select("source", "n", "share", F.lit(0).cast("long").alias("base"), F.lit(None).cast("double").alias("best"), F.col("n").alias("active")),
        "state",
    )
    done = None
    while True:
        ready = state.where(F.col("active") <= small)
        last = runs.join(ready.where("active > 0"), "source").groupBy("source").applyInArrow(_finish, "source long, cutoff double, kept long, n long")
        # A source without an active value is at its target already.
        last = last.unionByName(ready.where(F.col("active") == 0).select("source", F.col("best").alias("cutoff"), F.col("base").alias("kept"), "n"))
        done = last if done is None else done.unionByName(last)
        state = state.where(F.col("active") > small)
        if state.isEmpty():
            return done
        runs = runs.join(state.select("source"), "source", "left_semi")
        shown = runs.mapInArrow(_show, "source long, active long, pivots array<double>")
        # At most SHOWN pivots of a source go on, evenly spaced among those its runs show.
        pivots = shown.select("source", F.explode("pivots").alias("p")).distinct()
        ends = pivots.groupBy("source").agg(F.percentile_approx("p", [i / SHOWN for i in range(1, SHOWN + 1)], 1000).alias("p"), F.max("p").alias("top"))
        pivots = keep(ends.select("source", F.array_sort(F.array_distinct(F.concat("p", F.array("top")))).alias("pivots")), "pivots")
        ranked = runs.join(pivots, "source").select("source", "values", "pivots").mapInArrow(_rank, "source long, counts array<long>")
        counts = ranked.select("source", F.posexplode("counts").alias("i", "c")).groupBy("source", "i").agg(F.sum("c").alias("c"))
        counts = counts.join(pivots.select("source", F.posexplode("pivots").alias("i", "p")), ["source", "i"]).join(state, "source")
        fits = (F.col("base") + F.col("c")) / F.col("n") <= F.col("share")
        new = counts.groupBy("source", "n", "share", "base", "best").agg(
            F.max(F.when(fits, F.struct("p", "c"))).alias("lo"), F.min(F.when(~fits, F.struct("p", "c"))).alias("hi")
        )
        lo_c, hi = F.coalesce("lo.c", F.lit(0)), F.col("hi.p")
        new = new.select(
            "source", "n", "share", (F.col("base") + lo_c).alias("base"), F.coalesce("lo.p", "best").alias("best"),
            F.coalesce("lo.p", F.lit(float("-inf"))).alias("lo"), F.coalesce(hi, F.lit(float("-inf"))).alias("hi"), F.coalesce(F.col("hi.c") - lo_c, F.lit(0)).cast("long").alias("left"),
        )
        new = keep(new, "state")
        runs = keep(runs.join(new.select("source", "lo", "hi"), "source").select("source", "values", "lo", "hi").mapInArrow(_narrow, RUNS), "runs")
        # A bound next to the target leaves one value over and over: nothing at or below it fits, so the source is done.
        one = runs.groupBy("source").agg(F.min(F.col("values")[0]).alias("a"), F.max(F.element_at("values", -1)).alias("z"))
        left = new.join(one, "source", "left")
        active = F.when(F.col("a") == F.col("z"), 0).otherwise(F.col("left"))
        state = keep(left.select("source", "n", "share", "base", "best", active.alias("active")), "state")


# --- Distances of the sources of setdata ---

SOURCE = ["run", "set_name", "probe"]


def elements(setdata: DataFrame) -> DataFrame:
    """(run, set_name, probe, field, source, question, pos, value) of all countable elements, from 0 to 2.

    Equal rows are one row; ``pos`` counts from 0 in the array as stored. Null, NaN and other values don't count.
    """
    rows = setdata.select(*SOURCE, "question", "random", "relevant").distinct()
    both = rows.select(*SOURCE, "question", F.explode(F.array(F.struct(F.lit("random").alias("field"), F.col("random").alias("v")), F.struct(F.lit("relevant").alias("field"), F.col("relevant").alias("v")))).alias("f"))
    flat = both.select(*SOURCE, "question", F.col("f.field").alias("field"), F.posexplode("f.v").alias("pos", "value"))
    flat = flat.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("value").between(0, 2))
    return flat.withColumn("source", F.xxhash64(*[F.coalesce(c, F.lit("\0null")) for c in (*SOURCE, "field")]))


def source_cutoffs(setdata: DataFrame, searchcutoff: DataFrame, keep: Callable[[DataFrame, str], DataFrame], small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(elements, cutoffs): cutoffs has (run, set_name, probe, field, source, share, cutoff, kept, n)."""
    items = keep(elements(setdata), "elements")
    names = items.groupBy(*SOURCE, "field", "source").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    shares = searchcutoff.select("run", F.explode(F.map_from_arrays(F.array(F.lit("random"), F.lit("relevant")), F.array("random_share", "relevant_share"))).alias("field", "share")).where(F.col("share").isNotNull()).distinct()
    named = keep(names.join(shares, ["run", "field"]), "sources")
    cut = cutoffs(items.select("source", "value"), named.select("source", "share"), keep, small)
    return items, named.join(cut, "source")


def kept_elements(items: DataFrame, cut: DataFrame) -> DataFrame:
    """The elements at or below their source's cutoff."""
    return items.join(cut.where(F.col("cutoff").isNotNull()).select("source", "cutoff"), "source").where(F.col("value") <= F.col("cutoff"))
