"""Event-time windows on a stream, with late rows counted and results kept by window.

A run reads what is new, updates the open windows and upserts every changed window by its key into a collection, so a batch
that runs twice leaves the same rows. State is one row a key and open window: it goes when the watermark passes the window's
end. Rows that come later than that are dropped from the windows; Spark reports how many (window, key) groups of a round were,
and late_rows tells how many rows these held. A window is aggregated in parts before it shuffles, so a key with a third of
all rows sends one row a task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from turnstone.sources import store


def windows(events: DataFrame, by: Sequence[str], width: str, slide: str | None = None, late: str = "1 hour", time: str = "ts", value: str | None = None) -> DataFrame:
    """start, end, by, n and, of a value, total: tumbling windows, or sliding ones that overlap. The same on a table, where late
    means nothing, and on a stream. Rows without a time are in no window."""
    sums = [F.count(F.lit(1)).alias("n"), *([] if value is None else [F.round(F.sum(value), 6).alias("total")])]
    rows = events.withWatermark(time, late).groupBy(F.window(time, width, slide or width).alias("w"), *by).agg(*sums)
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *[c for c in rows.columns if c in ("n", "total")])


def key(by: Sequence[str]) -> Column:
    """The id of a window in a collection."""
    return F.concat_ws("/", F.unix_micros(F.col("start").cast("timestamp")).cast("string"), F.unix_micros(F.col("end").cast("timestamp")).cast("string"), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by))


def keep(changed: DataFrame, by: Sequence[str], table: str, name: str, checkpoint: str) -> dict[str, int]:
    """Runs a stream of windows to the end of what is there, upserting them into the collection name of a store. Returns the
    rows read, the windows written and the late groups dropped."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.upsert(table, batch.withColumn("id", key(by)).withColumn("batch", F.lit(number)), name)

    query = changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return totals(query)


def totals(query: StreamingQuery) -> dict[str, int]:
    """What the rounds of a query that has ended report."""
    rounds = [p for p in query.recentProgress]
    state = lambda c: sum(s[c] for p in rounds for s in p["stateOperators"])
    return {"read": sum(p["numInputRows"] for p in rounds), "written": state("numRowsUpdated"), "late_groups": state("numRowsDroppedByWatermark")}


def replay(spark: SparkSession, folder: str, schema: str, files: int = 1, fmt: str = "parquet", shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The files of a folder as a stream, so many a round, oldest first."""
    return shape(spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(folder))


def late_rows(read: int, kept: DataFrame, overlap: int = 1) -> int:
    """Of read rows with a time those that no window holds: kept are all windows, of which a row is in overlap (the width by
    the slide)."""
    return read - (kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n // overlap)
