"""Mergeable percentiles with bounded rank error: deterministic buffer collapsing.

A sketch is a set of sorted buffers. Full buffers hold ``k`` values and have a weight, the number of values each of
theirs stands for; one shorter buffer of weight 1 holds the rest. Two full buffers of one weight w collapse to one of
weight 2w: their merged values are taken at evenly spaced positions, the odd and even ones in turn. Collapsing equal
weights only makes the tree balanced, so that n values pass at most log2(n / k) collapses, and each collapse moves a
rank by w at most; ``err`` adds these bounds up. Up to ``k`` values a sketch is exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.operators.stats import order_statistics

K = 2048
#: Rows that a task turns into sketches at a time.
CHUNK = 1 << 18
#: Tasks whose sketches meet in one step of the merge tree, and its steps: enough for FAN_IN ** STEPS tasks.
FAN_IN, STEPS = 64, 3
#: Values a task holds in its sketches before it hands them on.
HELD = 1 << 23

SKETCH = [
    T.StructField("n", T.LongType()),
    T.StructField("err", T.LongType()),
    T.StructField("weights", T.ArrayType(T.LongType())),
    T.StructField("buffers", T.ArrayType(T.ArrayType(T.DoubleType()))),
]


def collapse(buffers: list[tuple[int, np.ndarray]], k: int = K, err: int = 0) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """(err, buffers) with at most one full buffer of each weight and a shorter one of weight 1."""
    full: dict[int, list[np.ndarray]] = {}
    loose = [v for w, v in buffers if w == 1 and len(v) < k]
    for w, v in buffers:
        if not (w == 1 and len(v) < k):
            full.setdefault(w, []).append(v)
    rest = np.sort(np.concatenate(loose)) if loose else np.empty(0)
    if len(rest) >= k:
        # Strided cuts keep every buffer a fair picture of the rest.
        whole, cut = len(rest) // k, len(rest) - len(rest) % k
        picked = rest[:cut]
        full.setdefault(1, []).extend(picked[i::whole] for i in range(whole))
        rest = rest[cut:]
    w, turn = 1, 0
    while full and w <= max(full):
        while len(full.get(w, [])) >= 2:
            a, b = full[w].pop(0), full[w].pop(0)
            merged = np.sort(np.concatenate([a, b]), kind="stable")
            full.setdefault(2 * w, []).append(merged[turn::2])
            turn ^= 1
            err += w
        w *= 2
    out = [(w, v) for w in sorted(full) for v in full[w]]
    return err, out + ([(1, rest)] if len(rest) else [])


def _schema(keys: list[pa.Field]) -> pa.Schema:
    return pa.schema([*keys, ("n", pa.int64()), ("err", pa.int64()), ("weights", pa.list_(pa.int64())), ("buffers", pa.list_(pa.list_(pa.float64())))])


def _cells(n: int, err: int, buffers: list[tuple[int, np.ndarray]]) -> tuple:
    return n, err, [w for w, _ in buffers], [v.tolist() for _, v in buffers]


def _build(keys: list[str], value: str, k: int):
    """One sketch per group and task, or more where a task meets so many groups that it can't hold them."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        held: dict[tuple, tuple] = {}
        types: list[pa.Field] = []

        def take_in() -> None:
            t = pa.Table.from_batches(waiting)
            lists = t.group_by(keys, use_threads=False).aggregate([(value, "list")]).combine_chunks()
            for key, v in zip(zip(*(lists.column(c).to_pylist() for c in keys)), lists.column(f"{value}_list").combine_chunks()):
                x = np.sort(v.values.to_numpy(zero_copy_only=False))
                new = [(1, x[i : i + k - 1]) for i in range(0, len(x), k - 1)]
                n, err, old = held.get(key, (0, 0, []))
                held[key] = (n + len(x), *collapse(old + new, k, err))

        def hand_on() -> pa.RecordBatch:
            schema = _schema(types)
            cells = [_cells(*x) for x in held.values()]
            data = [*zip(*held), *zip(*cells)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(data, schema)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c) for c in keys]
            waiting.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                take_in()
                waiting, rows = [], 0
                if sum(len(v) for _, _, buffers in held.values() for _, v in buffers) > HELD:
                    yield hand_on()
                    held.clear()
        if waiting:
            take_in()
        if held:
            yield hand_on()

    return build


def _merge(keys: list[str], k: int):
    def merge(t: pa.Table) -> pa.Table:
        buffers = [(w, np.asarray(v)) for ws, vs in zip(t.column("weights").to_pylist(), t.column("buffers").to_pylist()) for w, v in zip(ws, vs)]
        cells = _cells(sum(t.column("n").to_pylist()), *collapse(buffers, k, sum(t.column("err").to_pylist())))
        schema = _schema([t.schema.field(c) for c in keys])
        data = [t.column(c).slice(0, 1).combine_chunks() for c in keys] + [pa.array([c], f.type) for c, f in zip(cells, list(schema)[len(keys) :])]
        return pa.Table.from_arrays(data, schema=schema)

    return merge


def _fields(df: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in keys] + SKETCH)


def sketch(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys, n, err, weights, buffers): a sketch of ``value`` for every group.

    Null and NaN values are left out; a null key is a key; a group without values gives no row; repeated rows count as
    often as they occur. Every task sketches its own rows first, so that of a group of any size only buffers move; they
    meet in a tree, at most ``FAN_IN`` tasks' sketches of a group in a node but the last.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    parts = rows.mapInArrow(_build(keys, "_v", k), _fields(df, keys))
    for step in range(1, STEPS):
        parts = parts.withColumn("_node", F.floor(F.spark_partition_id() / FAN_IN).cast("int")) if step == 1 else parts.withColumn("_node", F.floor(F.col("_node") / FAN_IN).cast("int"))
        parts = merge_sketches(parts, [*keys, "_node"], k)
    return merge_sketches(parts, keys, k)


def merge_sketches(sketches: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups, such as weeks of days, from sketches whose keys include ``keys``."""
    rows = sketches.select(*keys, "n", "err", "weights", "buffers")
    return rows.groupBy(*keys).applyInArrow(_merge(keys, k), _fields(sketches, keys))


def _at(buffers: list[tuple[int, np.ndarray]], n: int, err: int, p: float) -> tuple[float, float, float]:
    """(estimate, low, high) of the percentile; the true one, interpolated linearly, lies within low and high."""
    values = np.concatenate([v for _, v in buffers])
    order = np.argsort(values, kind="stable")
    values = values[order]
    upto = np.cumsum(np.concatenate([np.full(len(v), w) for w, v in buffers])[order])
    rank = (n - 1) * p

    def value(r: float) -> float:
        return float(values[min(int(np.searchsorted(upto, min(max(r, 0), n - 1), "right")), len(values) - 1)])

    lo, hi = int(np.floor(rank)), int(np.ceil(rank))
    a, b = value(lo), value(hi)
    most = max([w for w, _ in buffers]) if err else 0
    slack = err + most
    return a + (b - a) * (rank - lo), value(lo - slack) if slack else min(a, b), value(hi + slack) if slack else max(a, b)


def quantiles(sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """(keys, n, stat, est, low, high): for each named percentile its estimate and the bounds of the true value."""
    fields = T.StructType([T.StructField(c, sketches.schema[c].dataType) for c in keys] + [T.StructField("n", T.LongType()), T.StructField("stat", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in ("est", "low", "high")])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, take = [], []
            for i, (n, err, ws, vs) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("n", "err", "weights", "buffers")))):
                buffers = [(w, np.asarray(v)) for w, v in zip(ws, vs)]
                for stat, p in probs.items():
                    rows.append((n, stat, *_at(buffers, n, err, p)))
                    take.append(i)
            schema = pa.schema([b.schema.field(c) for c in keys] + [("n", pa.int64()), ("stat", pa.string()), ("est", pa.float64()), ("low", pa.float64()), ("high", pa.float64())])
            if rows:
                data = [b.column(b.schema.get_field_index(c)).take(pa.array(take)) for c in keys]
                yield pa.RecordBatch.from_arrays(data + [pa.array(c, t) for c, t in zip(zip(*rows), schema.types[len(keys) :])], schema=schema)

    return sketches.select(*keys, "n", "err", "weights", "buffers").mapInArrow(answer, fields)


# --- Call latencies and published figures ---

PROBS = {"p50": 0.5, "p95": 0.95}
WHO = ["machine", "ranker"]
#: A figure is wrong when it is more than this share off.
TOLERANCE = 0.1


def latencies(calls: DataFrame) -> DataFrame:
    """(machine, ranker, since DATE, ms) of the calls that count, each ``line_no`` once."""
    good = F.col("at_ts").isNotNull() & F.col("ms").isNotNull() & ~F.isnan("ms") & (F.col("ms") > 0)
    rows = calls.where(good).select("line_no", *WHO, F.to_date("at_ts").alias("since"), "ms")
    return rows.dropDuplicates(["line_no"]).drop("line_no")


def by_span(days: DataFrame, k: int = K) -> DataFrame:
    """Sketches by machine, ranker, span and first day: the given days, and their weeks from Monday."""
    weeks = merge_sketches(days.withColumn("since", F.to_date(F.date_trunc("week", "since"))), [*WHO, "since"], k)
    return days.withColumn("span", F.lit("day")).unionByName(weeks.withColumn("span", F.lit("week")))


def wrong_figures(calls: DataFrame, summaries: DataFrame, k: int = K, keep=lambda df: df) -> DataFrame:
    """(machine, ranker, span, since, stat): published figures more than 10 % off the percentile.

    Days are sketched, weeks merged from days. A figure that both bounds of its percentile call right or wrong is
    decided by the sketch; for the others the two order statistics are counted exactly, in bins, over the rows of their
    groups. ``keep`` may store what is used several times: the rows that count, the day sketches, and the figures beside
    their bounds.
    """
    rows = keep(latencies(calls))
    days = keep(sketch(rows, [*WHO, "since"], "ms", k))
    found = quantiles(by_span(days, k), [*WHO, "span", "since"], PROBS)
    figures = summaries.select(*WHO, "span", "since", F.explode(F.map_from_arrays(F.array(F.lit("p50"), F.lit("p95")), F.array("latencyp50", "latencyp95"))).alias("stat", "figure"))
    figures = figures.where(F.col("figure").isNotNull()).distinct()
    key = [*WHO, "span", "since", "stat"]
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"q.{c}")) for c in key]
    on = same[0] & same[1] & same[2] & same[3] & same[4]
    both = keep(figures.alias("f").join(found.alias("q"), on).select("f.*", "q.n", "q.low", "q.high"))
    # |figure - t| <= 0.1 t holds for t from figure / 1.1 to figure / 0.9, so the two bounds settle most figures.
    off = lambda t: F.isnan("figure") | (F.abs(F.col("figure") - t) > TOLERANCE * t)
    sure_wrong = (F.col("figure") > (1 + TOLERANCE) * F.col("high")) | (F.col("figure") < (1 - TOLERANCE) * F.col("low"))
    sure_right = ~off(F.col("low")) & ~off(F.col("high"))
    open_ = both.where(~sure_wrong & ~sure_right)
    return both.where(sure_wrong).select(*key).unionByName(_exactly(rows, open_, key).where(off(F.col("exact"))).select(*key))


def _exactly(rows: DataFrame, figures: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``exact``, the true percentile, to the figures: order statistics by counts in bins, over their groups' rows."""
    group = [*WHO, "span", "since"]
    spans = rows.withColumn("span", F.lit("day")).unionByName(rows.select(*WHO, F.to_date(F.date_trunc("week", "since")).alias("since"), "ms", F.lit("week").alias("span")))
    # Null machines and rankers are groups too.
    same = lambda a, b, names: functools.reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names))
    asked = figures.select(*group).distinct()
    mine = spans.alias("r").join(asked.alias("f"), same("r", "f", group), "left_semi")
    exact = order_statistics(mine, group, "ms", PROBS)
    return figures.alias("f").join(exact.alias("q"), same("f", "q", key)).select("f.*", F.col("q.value").alias("exact"))


def outside_bounds(calls: DataFrame, found: DataFrame) -> DataFrame:
    """(machine, ranker, span, since, stat, n, inside): whether each percentile of ``quantiles`` over ``latencies`` has the
    true one within its bounds."""
    key = [*WHO, "span", "since", "stat"]
    return _exactly(latencies(calls), found, key).select(*key, "n", F.col("exact").between(F.col("low") - 1e-9, F.col("high") + 1e-9).alias("inside"))
