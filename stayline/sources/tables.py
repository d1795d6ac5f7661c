"""Customer tables, support threads and channel exports from files, and outputs to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

THREADS = (
    "thread_id string, customer_id string, created_at timestamp, closed_at timestamp, channel string, subject string, status string, "
    "tags array<string>, language string, duplicate_of string, source string, "
    "messages array<struct<message_id:string,timestamp:timestamp,role:string,text:string>>"
)


def with_row_ids(df: DataFrame) -> DataFrame:
    """Adds ``_row_id``: the place of a row in its files, by file name and position, from counts of the files' blocks."""
    rows = df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mid")
    )
    blocks = rows.groupBy("_file", "_block").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    w = Window.orderBy("_file", "_block")  # one row for each block of a file
    blocks = blocks.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).drop("_n")
    placed = rows.join(blocks, ["_file", "_block"])
    return placed.withColumn("_row_id", F.col("_before") + F.col("_mid") - F.col("_first")).drop("_file", "_block", "_mid", "_first", "_before")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV (all columns as text, so ids keep their zeros) or Parquet table with ``_row_id``; other endings are refused."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return with_row_ids(spark.read.option("header", True).option("escape", '"').csv(path))
    if ending == "parquet":
        return with_row_ids(spark.read.parquet(path))
    raise ValueError(f"can't read a table from {path!r}")


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Nested support threads from JSON lists (a file is read by one task) with the fixed schema."""
    return spark.read.schema(THREADS).option("multiLine", True).json(path)


def read_threads_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from JSON lines, which can be split."""
    return spark.read.schema(THREADS).json(path)


def flatten_threads(threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(threads, messages)``: the flat tables that the support operators take."""
    messages = threads.select("thread_id", "customer_id", F.explode("messages").alias("m")).select(
        "thread_id", "customer_id", F.col("m.message_id").alias("message_id"), F.col("m.timestamp").alias("ts"), F.col("m.role").alias("role"), F.col("m.text").alias("text")
    )
    return threads.drop("messages"), messages


def write_outputs(folder: str, **tables: DataFrame) -> DataFrame:
    """Each table as Parquet under its name, and ``run_summary``: one row for each with its number of rows, counted while
    writing."""
    from pyspark.sql import Observation

    spark = next(iter(tables.values())).sparkSession
    counts = []
    for name, df in tables.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/{name}")
        counts.append((name, seen.get["n"]))
    summary = spark.createDataFrame(counts, "table_name string, n_rows long")
    summary.coalesce(1).write.mode("overwrite").parquet(f"{folder}/run_summary")
    return summary
