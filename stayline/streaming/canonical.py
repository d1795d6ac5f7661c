"""Canonicalisation of arriving files: the adapters are stateless projections, so they run on streams unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def canonical_stream(spark: SparkSession, folder: str, schema: str, adapter: Callable[[DataFrame, str], DataFrame], ref: str) -> DataFrame:
    """Canonical rows of the CSV files that appear in a folder; ``_row_id`` is a hash of file and cells, as order is open."""
    raw = spark.readStream.schema(schema).option("header", True).csv(folder)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in raw.columns]
    return adapter(raw.withColumn("_row_id", F.xxhash64(F.input_file_name(), *cells)), ref)


def write_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to a Parquet folder, each input once, until what is there has been read."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
