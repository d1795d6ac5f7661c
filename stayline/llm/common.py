"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import new_folder, release, written, written_here
from ..functions.files import write_and_read as materialize

__all__ = ["materialize", "new_folder", "pick", "release", "slices", "spread_join", "table", "text_or_empty", "written", "written_here"]

#: The characters of ``[\x20\x09-\x0D]``, the only white space that the text contracts know.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows of a file that ``spread_join`` keeps together.
PIECE_ROWS = 1 << 16


def spread_join(rows: DataFrame, key: list[str], values: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row for each key), for keys that may hold a third of all rows.

    ``rows`` must come straight from files. Values are joined to the distinct (key, piece of a file) pairs first, so
    that a hot key is as many rows as pieces hold it, and then to the rows of each pair.
    """
    place = F.col("_metadata")
    piece = F.xxhash64(place["file_path"], F.floor(place["row_index"] / PIECE_ROWS))
    spread = rows.select("*", piece.alias("_piece"))
    pairs = spread.select(*key, "_piece").distinct().join(values, key)
    return spread.join(pairs, [*key, "_piece"]).drop("_piece")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that any further columns of the input can't clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def slices(batches: Iterable, rows: int = 1000) -> Iterator:
    """The Arrow batches of a task in slices of few rows.

    A batch is bounded by Spark (``spark.sql.execution.arrow.maxBytesPerBatch``); its slices bound what stands in
    Python objects at a time.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
