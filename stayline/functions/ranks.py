"""Running sums and ranks over large ordered sets, without a window that holds everything in one task.

Rows are dealt to tasks by ranges of the whole order, as many as the session shuffles into, and written with the number
of their range. Counts of the ranges give offsets; only rows of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import write_and_read


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """``df``, written, with ``_range``: rows of a smaller range come before those of a larger one; peers share one."""
    return write_and_read(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def running_sum(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over rows of the group up to this ``order`` (peers included)."""
    rows = in_ranges(df, [*by, order])
    totals = rows.groupBy(*by, "_range").agg(F.sum(value).alias("_t"))
    w = Window.partitionBy(*by).orderBy("_range")
    before = totals.select(*by, "_range", (F.sum("_t").over(w) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    return (
        rows.withColumn("_inside", F.sum(value).over(inside))
        .join(before, [*by, "_range"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_range", "_inside", "_before")
    )


def global_rank(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Adds 1..n by ``order``, which should tell all rows apart: ties in its first columns don't share a task."""
    rows = in_ranges(df, order)
    totals = rows.groupBy("_range").agg(F.count("*").alias("_t"))  # one row for each range
    before = totals.select("_range", (F.sum("_t").over(Window.orderBy("_range")) - F.col("_t")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.withColumn("_i", inside).join(F.broadcast(before), "_range").withColumn(
        name, (F.col("_before") + F.col("_i")).cast("long")
    ).drop("_range", "_before", "_i")
