"""Which row of an id comes first, without bringing all rows of an id together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An id with more than one in this many of all rows is frequent: there are fewer such ids than this.
FREQUENT = 1000


def with_first(df: DataFrame, id_col: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: the smallest ``order`` of the row's id where the id repeats, else null. Null ids have none.

    Tasks find the smallest of each id first, so a frequent id is one row a task. Frequent ids are told to all tasks (they
    are fewer than ``FREQUENT``), and their rows, like those without id, are dealt evenly; the others meet their ids.
    """
    ids = df.select(F.col(id_col).alias("_id"), F.col(order).alias("_order")).where("_id is not null")
    repeats = ids.groupBy("_id").agg(F.min("_order").alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")
    total = ids.agg(F.count("*").alias("_total"))
    frequent = repeats.crossJoin(F.broadcast(total)).where(F.col("_rows") * FREQUENT > F.col("_total"))
    hot = F.broadcast(frequent.select(F.col("_id").alias("_hot"), F.col("_first").alias("_hot_first")))
    rows = df.join(hot, F.col(id_col) == F.col("_hot"), "left")
    alone = F.col("_hot").isNotNull() | F.col(id_col).isNull()
    rows = rows.withColumn("_deal", F.when(alone, F.xxhash64(order)).otherwise(F.lit(0).cast("long")))
    rest = repeats.select("_id", "_first", F.lit(0).cast("long").alias("_zero"))
    joined = rows.join(rest, (F.col(id_col) == F.col("_id")) & (F.col("_deal") == F.col("_zero")), "left")
    return joined.withColumn(name, F.coalesce("_hot_first", "_first")).drop("_hot", "_hot_first", "_deal", "_id", "_first", "_zero")
