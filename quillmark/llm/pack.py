"""Filling containers of fixed capacity with items of whole-number sizes: bulk-synchronous best fit.

Sizes are whole numbers up to the capacity, so items and gaps are range-sorted by counting: a class holds all items of
one size or all containers with one gap, numbered from 0. A round sweeps the item classes from the largest down; each
takes its successor, the class of the smallest gap that is large enough. Where items and containers of two classes meet,
the conflict is resolved by rank: the next items in rank go to the next containers in rank, one each. Filled containers
take part again in the next round with their new gaps. What meets what in a sweep hangs on the class counts alone, so the
sweeps work on tables of at most ``capacity`` rows, however many documents there are; ranking the documents within their
classes and giving each its container are the distributed part.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 2048
#: Items of one class that are ranked in one task, roughly.
RANKED_AT_ONCE = 1 << 18


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(matches, containers): rows (size, first rank, first container, how many), sorted by size and rank.

    Containers open in bulk: as many as the unplaced items fill without waste, each with one of the largest of them.
    Then best-fit rounds run until no unplaced item fits a gap, and more containers open for the rest.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} is outside 1..{capacity}")
        left[size] = n
    ranked = np.zeros(capacity + 1, dtype=np.int64)
    gaps: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]
    room = np.zeros(capacity + 1, dtype=np.int64)
    matches: list[tuple[int, int, int, int]] = []
    containers = 0
    sizes = np.arange(capacity + 1)

    def place(size: int, first: int, n: int, gap: int, into: list) -> None:
        matches.append((size, int(ranked[size]), first, n))
        ranked[size] += n
        left[size] -= n
        if gap > size:
            into.append((gap - size, first, n))

    def settle(new: list) -> None:
        for gap, first, n in new:
            gaps[gap].append((first, n))
            room[gap] += n

    while left.any():
        new: list[tuple[int, int, int]] = []
        to_open = -(-int((left * sizes).sum()) // capacity)
        for size in np.flatnonzero(left)[::-1].tolist():
            n = min(to_open, int(left[size]))
            if n == 0:
                break
            place(size, containers, n, capacity, new)
            containers += n
            to_open -= n
        settle(new)
        while True:
            new = []
            for size in np.flatnonzero(left)[::-1].tolist():
                while left[size]:
                    fits = np.flatnonzero(room[size:])
                    if not len(fits):
                        break
                    gap = size + int(fits[0])
                    first, n = gaps[gap].popleft()
                    take = min(n, int(left[size]))
                    if take < n:
                        gaps[gap].appendleft((first + take, n - take))
                    room[gap] -= take
                    place(size, first, take, gap, new)
            settle(new)
            if not new and not _any_fit(left, room):
                break
    out = np.array(matches, dtype=np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))], containers


def _any_fit(left: np.ndarray, room: np.ndarray) -> bool:
    items, open_ = np.flatnonzero(left), np.flatnonzero(room)
    return bool(len(items) and len(open_) and items[0] <= open_[-1])


def rank_in_class(items: DataFrame, size: str, ids: list[str], rows: int) -> DataFrame:
    """Adds ``_rank``, numbering the rows of each size from 0.

    A class is cut by hash into parts of about RANKED_AT_ONCE rows at most; each part is numbered alone and lifted by the
    sizes of the parts before it, so a size that a third of all items share is no hot group.
    """
    parts = max(1, -(-rows // RANKED_AT_ONCE))
    cut = items.withColumn("_part", F.pmod(F.xxhash64(*ids), F.lit(parts)).cast("int"))
    before = Window.partitionBy(size).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(size, "_part").agg(F.count(F.lit(1)).alias("_c")).withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    numbered = cut.withColumn("_row", F.row_number().over(Window.partitionBy(size, "_part").orderBy(*ids)))
    return numbered.join(starts, [size, "_part"]).withColumn("_rank", F.col("_start") + F.col("_row") - 1).drop("_part", "_row", "_start")


def pack(sizes: DataFrame, id_: str, size: str, keep: Callable[[DataFrame, str], DataFrame], capacity: int = CAPACITY) -> DataFrame:
    """(id, piece_no, start, size, container): every item in a container; the sizes in one never exceed the capacity.

    Only an item larger than the capacity is split: into pieces of the full capacity, ``start`` apart, and a rest.
    Items of size 0 or null fill no space: they come out once, with a null container. Repeated rows are items each. An
    empty table gives no rows. ``keep`` stores the sizes, which are read three times.
    """
    s = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = keep(sizes.select(F.col(id_).alias("id"), s.alias("_all")), "sizes")
    whole = F.when(F.col("_all") > 0, F.sequence(F.lit(0).cast("long"), F.col("_all") - 1, F.lit(capacity).cast("long")))
    pieces = rows.where("_all > 0").select("id", "_all", F.posexplode(whole).alias("piece_no", "start"))
    pieces = pieces.select("id", "piece_no", "start", F.least(F.lit(capacity).cast("long"), F.col("_all") - F.col("start")).alias("size"))
    # At most `capacity` rows.
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    matches, _ = plan(counts, capacity)
    ranked = rank_in_class(pieces, "size", ["id", "piece_no"], sum(counts.values()))
    id_type = rows.schema["id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast((matches, capacity))
    placed = ranked.select("id", "piece_no", "start", "size", "_rank").mapInArrow(_assign(shared), f"id {id_type}, piece_no int, start long, size long, container long")
    none = rows.where("_all = 0").select("id", F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("container"))
    return placed.unionByName(none)


def _assign(shared):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, capacity = shared.value
        span = np.int64(1) << 40
        starts = matches[:, 0] * span + matches[:, 1]
        for b in batches:
            size, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            row = matches[np.searchsorted(starts, size * span + rank, "right") - 1]
            container = row[:, 2] + rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(container, pa.int64())], names=["id", "piece_no", "start", "size", "container"])

    return assign


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row (containers, used, capacity_total, fill): how full the containers are."""
    per = packed.where(F.col("container").isNotNull()).groupBy("container").agg(F.sum("size").alias("used"))
    total = F.count(F.lit(1)) * F.lit(capacity)
    return per.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), total.alias("capacity_total"), F.max("used").alias("fullest"), (F.sum("used") / total).alias("fill"))
