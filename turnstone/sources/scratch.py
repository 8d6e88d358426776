"""Intermediate tables in the folder that driver and executors share: they end lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from turnstone.sources import store

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, deleted when the driver ends. Where that is unset, only a local master, which
    shares all folders with itself, may go on (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.gettempdir()}"
    path = f"{at.rstrip('/')}/turnstone-scratch-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What runs within leaves no shuffle files behind: they go when their query ends, and not when the driver happens to collect
    garbage. What is read back from a written table needs none of them."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame) -> DataFrame:
    """df written once and read back."""
    path = folder(df.sparkSession)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # its session may have ended
            p, fs = store._fs(spark, path)
            fs.delete(p, True)
