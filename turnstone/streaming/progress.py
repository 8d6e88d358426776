"""The log of rounds: every round of every streaming query, and how each query ended, appended to a table.

Spark tells a listener of the driver what happened. A round is one small file of JSON lines under the folder, named by query,
run and round, so that telling it twice writes the same file, and a listener that fails says so in the driver's log and
never ends a query. read() shows them as a table, with the columns that a query observes."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from turnstone.sources import store

ROUND = "event string, query string, run string, name string, round long, at string, read long, written long, late long, took_ms long, observed map<string, string>, error string"


class Rounds(StreamingQueryListener):
    """Add to a session by spark.streams.addListener."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _write(self, file: str, row: dict) -> None:
        try:
            p, fs = store._fs(self.spark, f"{self.folder}/{file}.json")
            stream = fs.create(p, True)
            stream.write((json.dumps(row) + "\n").encode())
            stream.close()
        except Exception:
            logging.getLogger(__name__).exception("round %s is not in the log", file)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        self._write(f"{event.runId}-started", {"event": "started", "query": str(event.id), "run": str(event.runId), "name": event.name, "at": event.timestamp})

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        p = event.progress
        observed = {f"{name}.{column}": None if value is None else str(value) for name, row in (p.observedMetrics or {}).items() for column, value in row.asDict().items()}
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        row = {"event": "round", "query": str(p.id), "run": str(p.runId), "name": p.name, "round": p.batchId, "at": p.timestamp, "read": p.numInputRows, "written": max(p.sink.numOutputRows, -1), "late": late, "took_ms": p.durationMs.get("triggerExecution"), "observed": observed}
        self._write(f"{p.runId}-{p.batchId:012d}", row)

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        self._write(f"{event.runId}-ended", {"event": "failed" if event.exception else "ended", "query": str(event.id), "run": str(event.runId), "error": event.exception})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """event (started, round, ended or failed) and its figures; a round that was run again after a failure is there once for each
    run."""
    return spark.read.schema(ROUND).json(folder)
