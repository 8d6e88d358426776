"""The data source, streams of files that change, windows that run twice, the log of a failing query, SQL by name, sketches."""

import os
import time

import pytest
from pyspark.sql import functions as F

from turnstone import sql
from turnstone.operators import sketches
from turnstone.operators.memory import Persona
from turnstone.sources import archive, chats, readers, store
from turnstone.streaming import progress, windows


@pytest.fixture
def folder(tmp_path):
    """Sessions of three formats in folders, hidden ones and others."""
    talk = '{"type":"user","message":{"role":"user","content":"why is the sky blue"}}\n{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"because of scattering"}]}}\n'
    for name, text in {"a/one.jsonl": talk, "a/two.jsonl": talk * 3, "b/chats/session-1.json": '{"sessionId":"s","messages":[{"type":"user","content":"hi"}]}', "b/note.md": "# Note\n\nBody of a note", ".git/x.jsonl": talk, "b/empty.jsonl": ""}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return tmp_path


def load(spark, folder, **options):
    archive.register(spark)
    reader = spark.read.format("chat_archive")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(str(folder))


def names(df):
    return sorted(os.path.basename(r.path) for r in df.select("path").collect())


def test_same_turns_as_the_readers(spark, folder):
    turns = lambda whole: sorted(map(tuple, readers.file_turns(whole).select("path", "index", "role", "content").collect()))
    own = load(spark, folder, hidden="false")  # Spark's own reader skips hidden folders
    assert own.schema.simpleString() == "struct<path:string,value:string,bytes:bigint,changed:timestamp>"
    assert turns(own) == turns(chats.files(spark, str(folder), "*")) != []
    assert turns(load(spark, f"file://{folder}", hidden="false")) == turns(own)


def test_files_written_as_named(spark, tmp_path):
    archive.register(spark)
    rows = [("a b+%é/one.jsonl", "x\n"), ("two.jsonl", None), ("a b+%é/../three", "y")]
    write = lambda rows: spark.createDataFrame(rows, "path string, value string").write.format("chat_archive").mode("append").save(str(tmp_path / "kept"))
    write(rows[:2])
    write([("two.jsonl", "again")])
    found = {str(p.relative_to(tmp_path / "kept")): p.read_text() for p in (tmp_path / "kept").rglob("*") if p.is_file()}
    assert found == {"a b+%é/one.jsonl": "x\n", "two.jsonl": "again"}  # no marks, checksums or halves beside them
    for bad in (rows[2], ("/etc/x", "y"), (None, "y")):
        with pytest.raises(Exception, match="not a path below"):
            write([bad])


def test_few_tasks_list_many_folders(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "s.jsonl").write_text("{}")
    spark.sparkContext.setJobGroup("listing", "listing")
    found = chats.files(spark, str(tmp_path), "*.jsonl")
    told = spark.sparkContext.statusTracker()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("listing") for s in told.getJobInfo(j).stageIds]
    assert found.count() == 300 and 0 < sum(s.numTasks for s in stages) <= chats.LISTERS * spark.sparkContext.defaultParallelism < 300


def test_options(spark, folder):
    assert names(load(spark, folder, glob="*.jsonl", hidden="false")) == ["empty.jsonl", "one.jsonl", "two.jsonl"]
    assert names(load(spark, folder, under="chats")) == ["session-1.json"] and names(load(spark, folder, depth=2)) == ["session-1.json"]
    assert load(spark, folder, maxBytes=1).rdd.getNumPartitions() == 6 and load(spark, f"{folder}/absent").count() == 0
    with pytest.raises(Exception, match="needs a path"):
        spark.read.format("chat_archive").load().count()


def test_pushed_filters_open_fewer_files(spark, folder, monkeypatch):
    reader = archive.ArchiveReader({"path": str(folder)})
    left = list(reader.pushFilters([archive.EqualTo(("path",), f"{folder}/a/one.jsonl"), archive.GreaterThan(("value",), "a")]))
    assert len(left) == 1 and [f for p in reader.partitions() for f in p.files] == [f for f in reader.listed()] and len(reader.listed()) == 1
    for condition, want in ((F.col("bytes") > 200, ["two.jsonl"]), (F.col("path").startswith(f"{folder}/b"), ["empty.jsonl", "note.md", "session-1.json"]), (F.col("path").isin(f"{folder}/b/note.md", "x"), ["note.md"]), (F.col("changed") > F.lit("2100-01-01").cast("timestamp"), [])):
        assert names(load(spark, folder).where(condition)) == want
    old = folder / "a/one.jsonl"
    os.utime(old, (1_000_000, 1_000_000))
    assert names(load(spark, folder).where(F.col("changed") <= F.timestamp_seconds(F.lit(1_000_000)))) == ["one.jsonl"]


def test_stream_reads_a_file_again_that_changed(spark, folder, tmp_path_factory):
    archive.register(spark)
    checkpoint, seen = str(tmp_path_factory.mktemp("c")), []

    def run():
        stream = spark.readStream.format("chat_archive").option("glob", "*.jsonl").load(str(folder))
        sink = lambda batch, n: seen.extend((os.path.basename(r.path), r.bytes) for r in batch.select("path", "bytes").collect())
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        out, seen[:] = sorted(seen), []
        return out

    assert [n for n, _ in run()] == ["empty.jsonl", "one.jsonl", "two.jsonl", "x.jsonl"]
    assert run() == []
    time.sleep(0.01)
    (folder / "a/one.jsonl").write_text("more\n")
    assert run() == [("one.jsonl", 5)]


# --- windows and their log ------------------------------------------------------------------------------------------


def test_windows_that_run_twice(spark, tmp_path):
    """The same files from the start give the same collection: windows are upserted by key. A null key is a key."""
    folder, table = f"{tmp_path}/in", f"file://{tmp_path}/store"
    rows = spark.range(1000).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("k"))
    rows.repartition(5).write.parquet(folder)
    schema = "ts timestamp, k string"
    for run in range(2):
        told = windows.keep(windows.windows(windows.replay(spark, folder, schema), ["k"], "1 hour", late="30 days"), ["k"], table, "w", f"{tmp_path}/c{run}")
        assert told["read"] == 1000 and told["late_groups"] == 0
        kept = store.collection(spark, table, "w")
        got = sorted(map(str, kept.select("start", "end", "k", "n").collect()))
        assert got == sorted(map(str, windows.windows(rows, ["k"], "1 hour").select("start", "end", "k", "n").collect()))
        assert windows.late_rows(1000, kept) == 0


def test_log_of_rounds_that_fail(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    spark.range(10).repartition(2).write.parquet(f"{tmp_path}/in")
    listener = progress.Rounds(spark, log)
    spark.streams.addListener(listener)
    try:
        for fails in (True, False):

            def sink(batch, n, fails=fails):
                if fails:
                    raise RuntimeError("sink is full")
                batch.collect()

            q = windows.replay(spark, f"{tmp_path}/in", "id long").writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            if fails:
                with pytest.raises(Exception, match="sink is full"):
                    q.awaitTermination()
            else:
                q.awaitTermination()
        until = time.time() + 30
        while time.time() < until and not any(n.endswith("-ended.json") and "failed" not in n for n in store.names(spark, log)) or len([n for n in store.names(spark, log) if n.endswith("-ended.json")]) < 2 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    rows = progress.read(spark, log).collect()
    assert sorted(r.event for r in rows if r.event != "round") == ["ended", "failed", "started", "started"]
    assert "sink is full" in next(r.error for r in rows if r.event == "failed")
    assert sum(r.read for r in rows if r.event == "round" and r.read) == 10


# --- SQL ------------------------------------------------------------------------------------------------------------


def test_functions_of_odd_turns(spark):
    sql.register(spark)
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (2, 0, "assistant", "x"), (None, 0, "user", "p"), (None, 1, "assistant", "q")]
    spark.createDataFrame(rows, "talk long, at long, who string, said string").createOrReplaceTempView("odd_turns")
    call = "PARTITION BY talk ORDER BY at, key => 'talk', index => 'at', {}content => 'said'"
    pairs = spark.sql(f"SELECT * FROM pair_turns(TABLE(odd_turns) {call.format(chr(114) + 'ole => ' + repr('who') + ', ')})")
    assert pairs.columns == ["talk", "at", "user_text", "assistant_text"]
    assert sorted(map(tuple, pairs.collect()), key=repr) == [(1, 2, "b", "c"), (None, 0, "p", "q")]
    frames = {(r.talk, r.at): (r.from_turn, r.to_turn, r.frame_chars) for r in spark.sql(f"SELECT * FROM context_frames(TABLE(odd_turns) {call.format('k => 1, ')})").collect()}
    assert frames[1, 0] == (0, 1, 1) and frames[1, 2] == (1, 3, 2) and frames[2, 0] == (0, 0, 1) and len(frames) == 7
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM pair_turns(TABLE(odd_turns) PARTITION BY talk ORDER BY at)")
    with pytest.raises(Exception, match="0 or more"):
        spark.sql(f"SELECT * FROM context_frames(TABLE(odd_turns) {call.format('k => -1, ')})")


def test_scalars(spark):
    sql.register(spark)
    row = spark.sql("SELECT cosine(array(1D, 0D), array(1D, 1D)) AS a, cosine(array(0D), array(1D)) AS b, cosine(array(1D), array(1D, 2D)) AS c, cosine(NULL, array(1D)) AS d, cosine(embed('one two'), embed(' ONE  two ')) AS e").first()
    assert round(row.a, 6) == 0.707107 and row.b is row.c is row.d is None and round(row.e, 6) == 1
    sums = {r.k: r.v for r in spark.sql("SELECT k, vector_sum(v) AS v FROM VALUES (1, array(1F, 2F)), (1, array(3F, 4F)), (2, NULL), (3, array(1F)) t(k, v) GROUP BY k").collect()}
    assert sums == {1: [4.0, 6.0], 2: None, 3: [1.0]}


def test_tools(spark):
    sql.register(spark)
    rows = spark.sql("SELECT persona, id, embed(q) AS embedding, q AS user_input, a AS ai_response, s AS source_file FROM VALUES ('ann', 1L, 'red boat', 'It floats', 'a/b.md'), ('ann', 2L, 'green tree', 'It grows', NULL), ('bob', 3L, 'red boat', 'His own', 'c') t(persona, id, q, a, s)")
    sql.register_tools(spark, rows, [Persona("ann", "Ann", "A sailor"), Persona("bob", "Bob"), Persona("eve", "Eve")])
    got = spark.sql("SELECT point_id, score, source_file FROM summon('red boat', 'Ann', 2) ORDER BY score DESC").collect()
    assert [(r.point_id, round(r.score, 3), r.source_file) for r in got] == [("1", 1.0, "a/b.md"), ("2", got[1].score, "unknown")] and got[1].score < 0.5
    assert spark.sql("SELECT note FROM remember('red', 'bob', 1)").first().note.startswith("These are YOUR OWN memories, Bob.")
    assert spark.sql("SELECT prompt FROM rehydrate('red boat', 'ann', 1)").first().prompt == "# Ann\n\nA sailor\n\n[Relevance: 1.00]\nUser: red boat\nAnn: It floats\n\nCurrent query: red boat"
    assert {(r.persona, r.points, r.available) for r in spark.sql("SELECT * FROM stats()").collect()} == {("ann", 2, True), ("bob", 1, True), ("eve", 0, False)}
    assert spark.sql("SELECT error FROM retrieve('9', 'ann')").first().error == "point_not_found"
    assert spark.sql("SELECT * FROM summon('red', 'nobody', 3)").count() == 0


# --- sketches -------------------------------------------------------------------------------------------------------


def test_sketches_merge(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("a"), F.when(F.col("id") % 2 == 0, "x").alias("b"))
    for n in range(3):
        sketches.append(rows.where(F.col("a") % 3 == n), ["a", "b"], path, str(n))
    sketches.append(rows.where(F.col("a") % 3 == 0), ["a", "b"], path, "0")  # again
    got = {r.column: r for r in sketches.read(spark, path).collect()}
    assert (got["a"].rows, got["a"].filled, got["b"].filled, got["b"].distinct) == (60_000, 60_000, 30_000, 1)
    assert abs(got["a"].distinct - 20_000) < 5 * sketches.ERROR * 20_000
    sketches.append(rows.where("1 = 0"), ["a"], f"{path}0", "0")
    assert [(r.rows, r.distinct) for r in sketches.read(spark, f"{path}0").collect()] == [(0, 0)]
