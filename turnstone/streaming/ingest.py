"""Incremental ingest.

Session files are appended in place, so changed folders are found by fingerprint and read again as a batch (upserts make
that idempotent). Drops that never change are a stream: each run takes what is new and stops."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from turnstone.operators.ops import fingerprint
from turnstone.sources import store


def changed(files: DataFrame, state: DataFrame, source: str = "source") -> DataFrame:
    """Sources whose fingerprint differs from the state's, with the new one; files: source, path, changed."""
    now = fingerprint(files, F.col("path"), F.col("changed"), source)
    old = state.select(source, F.col("fingerprint").alias("old"))
    return now.join(old, source, "left").where(F.col("old").isNull() | (F.col("old") != F.col("fingerprint"))).drop("old")


def run_drop(spark: SparkSession, folder: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], fmt: str = "parquet") -> None:
    """Hands all new files of a folder to the sink, batch by batch, and stops; a batch that is run again has its old id."""
    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions by user; on a stream, state is dropped once the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_state(spark: SparkSession, path: str) -> dict[str, str]:
    """What save_state wrote last; nothing if there is none."""
    found = [n for n in store.names(spark, path) if n.startswith("state-") and n.endswith(".json")]
    if not found:
        return {}
    return json.loads(spark.read.text(store.literal(f"{path}/{found[-1]}"), wholetext=True).first()[0])


def save_state(spark: SparkSession, path: str, state: dict[str, str]) -> None:
    """Appears by one rename under a number above all others; the two last states stay."""
    found = [n for n in store.names(spark, path) if n.startswith("state-")]
    number = int(found[-1][6:18]) + 1 if found else 0
    beside, fs = store._fs(spark, f"{path}/_writing-{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    stream.write(json.dumps(state, indent=2, sort_keys=True).encode())
    stream.close()
    fs.rename(beside, store._fs(spark, f"{path}/state-{number:012d}.json")[0])
    for old in found[:-1]:
        fs.delete(store._fs(spark, f"{path}/{old}")[0], False)


def check(spark: SparkSession, state_path: str, files: DataFrame, ingest: Callable[[str], object], exports: Mapping[str, str] | None = None, source: str = "source") -> list[str]:
    """One round: sources whose fingerprint changed, and exports (name -> file) that are newer than at their last ingest,
    are ingested; the state of those that succeeded is saved with the time, if anything changed. Returns their names."""
    state = read_state(spark, state_path)
    old = spark.createDataFrame([(k.removesuffix("_hash"), v) for k, v in state.items() if k.endswith("_hash")], f"{source} string, fingerprint string")
    new = {f"{name}_hash": value for name, value in sync(files, old, ingest, source)}
    for name, path in (exports or {}).items():
        if not store.exists(spark, path):
            continue
        p, fs = store._fs(spark, path)
        changed_at = fs.getFileStatus(p).getModificationTime()
        if changed_at > int(state.get(f"{name}_mtime", 0)) and _try(ingest, name):
            new[f"{name}_mtime"] = str(changed_at)
    names = [k.rsplit("_", 1)[0] for k in new]
    if names:
        now = datetime.now(UTC).isoformat()
        save_state(spark, state_path, {**state, **new, **{f"{n}_last_sync": now for n in names}})
    return names


def loop(work: Callable[[], object], every: float = 300, after_error: float = 60, rounds: int | None = None, wait: Callable[[float], object] = time.sleep) -> int:
    """work again and again, sooner after it failed; forever, or for some rounds. Returns the rounds that failed."""
    failed, n = 0, 0
    while rounds is None or n < rounds:
        ok = _try(lambda _: work(), "round")
        failed += not ok
        n += 1
        if rounds is None or n < rounds:
            wait(every if ok else after_error)
    return failed


def archive_drop(spark: SparkSession, folder: str, archive: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None], fmt: str = "json") -> None:
    """run_drop whose files move to an archive folder once the batch after theirs has been handed on."""
    reader = spark.readStream.schema(schema).format(fmt).option("cleanSource", "archive").option("sourceArchiveDir", archive)
    reader.load(folder).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _try(work: Callable[[str], object], name: str) -> bool:
    try:
        work(name)
    except Exception:
        logging.getLogger(__name__).exception("%s failed", name)
        return False
    return True


def sync(files: DataFrame, state: DataFrame, ingest: Callable[[str], object], source: str = "source") -> list[tuple[str, str]]:
    """Ingests each source that changed, and returns source and fingerprint of those that succeeded: only these go into
    the state, so a failure is tried again next time. Sources are personas or folders, not files."""
    done = []
    for name, new in changed(files, state, source).select(source, "fingerprint").collect():
        if _try(ingest, name):
            done.append((name, new))
    return done


_PAIR = "conv_id long, turn long, user_text string, assistant_text string"


class _Pairing(StatefulProcessor):
    """Keeps the last turn of a conversation, so that an answer finds its question in an earlier batch; with a time column
    it is forgotten once the watermark is forget_ms beyond its time."""

    def __init__(self, time: str | None, forget_ms: int) -> None:
        self.time, self.forget_ms = time, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "turn long, role string, text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values("turn")
        before = self.last.get() if self.last.exists() else None
        out = []
        for turn, role, text in got[["turn", "role", "text"]].itertuples(index=False):
            if before and before[1] == "user" and role == "assistant" and before[2] and text:
                out.append((key[0], before[0], before[2], text))
            before = (int(turn), role, text)
        self.last.update(before)
        if self.time:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(got[self.time].max().timestamp() * 1000) + self.forget_ms)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "user_text", "assistant_text"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        yield pd.DataFrame([], columns=["conv_id", "turn", "user_text", "assistant_text"])

    def close(self) -> None:
        pass


def pairs(turns: DataFrame, time: str | None = None, forget_hours: float = 24 * 7, late: str = "1 hour") -> DataFrame:
    """Question and answer of a stream of turns (conv_id, turn, role, text) whose batches come in order of turn. State is
    one turn a conversation; with a time column, which makes the watermark, a conversation without turns for forget_hours
    is forgotten. It needs the RocksDB state store."""
    if time is None:
        return turns.groupBy("conv_id").transformWithStateInPandas(_Pairing(None, 0), _PAIR, "Append", "None")
    rows = turns.select("conv_id", "turn", "role", "text", time).withWatermark(time, late)
    return rows.groupBy("conv_id").transformWithStateInPandas(_Pairing(time, int(forget_hours * 3_600_000)), _PAIR, "Append", "EventTime")
