"""Places in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import durable


def range_places(rows: DataFrame, groups: list[str], order: list[Column], place: str = "place") -> DataFrame:
    """Adds the place, from 1, of each row of a group in ``order``, which is to be total.

    Rows are range-sorted into tasks by group and order; a place is the place in the task after the group's rows in earlier
    tasks. So no task gets more of a large group than of any other rows.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(tasks, *[F.asc(g) for g in groups], *order).withColumn("_task", F.spark_partition_id())
    spread = durable(spread, "places")
    before = Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # Without groups a row a task, in one task.
    starts = spread.groupBy(*groups, "_task").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.select(*[F.col(g).alias(f"_{i}") for i, g in enumerate(groups)], F.col("_task").alias("_t"), "_before")
    inside = spread.withColumn("_row", F.row_number().over(Window.partitionBy(*groups, "_task").orderBy(*order)))
    same = F.col("_task") == F.col("_t")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_{i}"))
    return inside.join(starts, same).withColumn(place, (F.col("_before") + F.col("_row")).cast("long")).select(*rows.columns, place)
