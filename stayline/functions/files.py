"""Intermediate tables in the folder that the driver and all executors see."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}
_written: list[str] = []
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` where the cluster sets it.

    Only a local master (tests) gets a temporary folder; elsewhere a missing setting is an error, since a
    machine's own folder would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    return _own_folders[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, and a lost executor costs no recomputation."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    for scope in _scopes.get():
        scope.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def written_here() -> Iterator[list[str]]:
    """The folders that this thread writes inside the block, as a list that grows; other threads have their own."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield paths
    finally:
        _scopes.reset(token)


def written() -> list[str]:
    """The folders that ``write_and_read`` has written and nobody has released."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Empty folders that nothing reads any more, through Spark's own writer (which any file system and session can)."""
    for path in paths:
        spark.createDataFrame([], "released int").write.mode("overwrite").parquet(path)
        if path in _written:
            _written.remove(path)
