"""Streams, their log, the archive source, files that repeat or change, and sketches, bound to the test tables."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from turnstone.operators import sketches
from turnstone.plans.catalogue import _ALL, _FILLED, _export, _jsonl, _seconds, ORACLE_SQL, QUERIES, query, table
from turnstone.sources import archive, chats, readers, scratch, store
from turnstone.streaming import ingest, progress, windows

_EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _shuffled(spark, sf, files: int = 4) -> str:
    """The events as files whose order has nothing to do with time."""
    folder = scratch.folder(spark)
    for n in range(files):
        _events(spark, sf).where(F.pmod(F.xxhash64("event_id"), F.lit(files)) == n).coalesce(1).write.mode("append").parquet(folder)
    return folder


_SLIDING = "SELECT make_timestamp((s * 7200 + h * 7200) * 1000000) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, epoch(ts)::BIGINT // 7200 AS s FROM (SELECT event_type, value, date_trunc('second', ts) AS ts FROM events)), (VALUES (0), (-1), (-2)) w(h) GROUP BY ALL"


@query(_SLIDING)
def event_windows_stream(spark, sf):
    """Sliding windows of six hours each two hours, from a stream in shuffled order, kept in a store by their key."""
    stream = windows.replay(spark, _shuffled(spark, sf), _EVENT)
    table_ = scratch.folder(spark)
    windows.keep(windows.windows(stream, ["event_type"], "6 hours", "2 hours", "60 days", value="value"), ["event_type"], table_, "windows", scratch.folder(spark))
    return store.collection(spark, table_, "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


_MIDDLE = "(SELECT make_timestamp((epoch(min(ts))::BIGINT + epoch(max(ts))::BIGINT) // 2 * 1000000) FROM events)"


@query(f"SELECT count(*) FILTER (ts >= {_MIDDLE}) AS kept, count(*) FILTER (ts < {_MIDDLE} - INTERVAL 1 DAY) AS late FROM events")
def event_windows_late(spark, sf):
    """The later half comes first, so that what comes from a day before it is late: it is counted, and in no window."""
    e = _events(spark, sf)
    middle = e.agg(F.timestamp_seconds(((_seconds(F.min("ts")) + _seconds(F.max("ts"))) / 2).cast("bigint")).alias("m")).first().m
    folder = scratch.folder(spark)
    later, even = F.col("ts") >= middle, F.col("event_id") % 2 == 0
    # two rounds, as a round drops by the watermark that the one before it began with
    for part in (later & even, later & ~even, F.col("ts") < F.lit(middle) - F.expr("interval 1 day")):
        e.where(part).coalesce(1).write.mode("append").parquet(folder)
    table_ = scratch.folder(spark)
    told = windows.keep(windows.windows(windows.replay(spark, folder, _EVENT), ["event_type"], "1 hour"), ["event_type"], table_, "windows", scratch.folder(spark))
    kept = store.collection(spark, table_, "windows")
    late = windows.late_rows(told["read"], kept)
    if bool(late) != bool(told["late_groups"]):
        raise RuntimeError("late rows and Spark's own count of late groups disagree")
    return kept.agg(F.sum("n").alias("kept")).withColumn("late", F.lit(late).cast("long"))


@query("SELECT count(*) AS read, 4 AS rounds, 1 AS ended, count(*) AS observed FROM events")
def round_log(spark, sf):
    """What the log holds of a stream of four rounds that a listener wrote down."""
    folder = scratch.folder(spark)
    listener = progress.Rounds(spark, folder)
    spark.streams.addListener(listener)
    try:
        stream = windows.replay(spark, _shuffled(spark, sf), _EVENT, shape=lambda df: df.observe("seen", F.count(F.lit(1)).alias("rows")))
        q = stream.writeStream.queryName("events").format("noop").option("checkpointLocation", scratch.folder(spark)).trigger(availableNow=True).start()
        q.awaitTermination()
        until = time.time() + 60  # the log follows the query
        while time.time() < until and not any(n.endswith("-ended.json") for n in store.names(spark, folder)):
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rounds = progress.read(spark, folder)
    seen = F.col("observed")["seen.rows"].cast("long")
    return rounds.agg(F.sum("read").alias("read"), F.count_if((F.col("event") == "round") & (F.col("read") > 0)).cast("int").alias("rounds"), F.count_if(F.col("event") == "ended").cast("int").alias("ended"), F.sum(seen).alias("observed"))


_SIDES = f"SELECT conv_id, i * 2 + s AS index, CASE s WHEN 0 THEN 'user' ELSE 'assistant' END AS role, CASE s WHEN 0 THEN user_text ELSE assistant_text END AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM ({_ALL})), (VALUES (0), (1)) v(s)"


@query(_SIDES)
def archive_turns(spark, sf):
    """Sessions written as files and read through the data source; turns are those of the readers."""
    archive.register(spark)
    folder = scratch.folder(spark)
    lined = _jsonl(spark, sf, F.to_json(F.struct("role", F.col("text").alias("content"))))
    name = F.concat(F.lit("talk="), F.regexp_extract("path", r"(\d+)\.jsonl$", 1), F.lit("/session.jsonl"))
    lined.select(name.alias("path"), "value").write.format("chat_archive").mode("append").save(folder)
    whole = spark.read.format("chat_archive").option("glob", "*.jsonl").load(folder).where("bytes > 0")
    talk = F.regexp_extract("path", r"talk=(\d+)/", 1)
    turns = readers.file_turns(whole, ["claude_jsonl"])
    return turns.select(talk.cast("long").alias("conv_id"), "index", "role", "content")


_COLUMNS = ("source", "lang", "doc_id", "text")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, true AS close FROM documents" for c in _COLUMNS))
def sketch_overview(spark, sf):
    """Summaries of three segments, merged: counts are exact, and distinct numbers within five standard deviations."""
    d = table(spark, sf, "documents")
    path = scratch.folder(spark)
    for n in range(3):
        sketches.append(d.where(F.pmod("doc_id", F.lit(3)) == n), _COLUMNS, path, str(n))
    exact = d.agg(*(F.count_distinct(c).alias(c) for c in _COLUMNS)).select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("exact")) for c in _COLUMNS))))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(F.lit(1), 5 * sketches.ERROR * F.col("exact"))
    return sketches.read(spark, path).join(exact, "column").select("column", "rows", "filled", near.alias("close"))


@query(f"SELECT conv_id::VARCHAR AS conversation_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, role, text AS content FROM {_FILLED}")
def last_conversation_of_an_id(spark, sf):
    """Exports that hold every conversation twice: the last of an id counts."""
    whole = _export(spark, sf)
    old = F.regexp_replace("value", '"title":"t', '"title":"old')
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    twice = whole.select("path", F.concat(F.lit("["), inner(old), F.lit(","), inner(F.col("value")), F.lit("]")).alias("value"))
    rows = chats.export_turns(twice).where(F.col("title").startswith("t"))
    return rows.select(F.col("id").alias("conversation_id"), F.col("index").cast("long").alias("index"), "role", F.col("text").alias("content"))


@query(f"SELECT conv_id, user_text || ' user' AS user_input, assistant_text || ' assistant' AS ai_response FROM ({_ALL})")
def text_of_any_block(spark, sf):
    """Contents that are lists of plain strings and of blocks of an unknown kind."""
    block = F.concat(F.lit('{"type":"note","text":"'), "role", F.lit('"}'))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","content":['), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(',7,{"type":"image"},'), block, F.lit("]}"))
    rows = readers.parse_roles(_jsonl(spark, sf, line))
    return rows.select(F.regexp_extract("path", r"(\d+)\.jsonl$", 1).cast("long").alias("conv_id"), "user_input", "ai_response")


@query(ORACLE_SQL["fingerprint"])
def state_saved(spark, sf):
    """Fingerprints of all sources saved as the state of a sync, over an older state, and read again."""
    path = scratch.folder(spark)
    ingest.save_state(spark, path, {"old": "x"})
    ingest.save_state(spark, path, {r.source: r.fingerprint for r in QUERIES["fingerprint"](spark, sf).collect() if r.source is not None})
    return spark.createDataFrame(list(ingest.read_state(spark, path).items()), "source string, fingerprint string")
