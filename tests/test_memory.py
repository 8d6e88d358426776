"""The memory service from files to answers, readers, settings, tasks, and streams that pair turns across batches."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from test_sources import EXPORT, GEMINI, ITEMS, NOTE, SESSION, whole

from turnstone.functions import text as x
from turnstone.functions import vectors
from turnstone.operators import drawers, graph, ops, tasks
from turnstone.operators.memory import Memories, Persona
from turnstone.sources import readers, store
from turnstone.streaming import ingest


@pytest.fixture(scope="module")
def memories(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("memory")
    (at / "in" / "p" / "chats").mkdir(parents=True)
    (at / "in" / "s.jsonl").write_text(SESSION)
    (at / "in" / "p" / "chats" / "session-1.json").write_text(json.dumps(GEMINI))
    (at / "in" / "n.md").write_text(NOTE)
    (at / "in" / "junk.txt").write_text("not a chat")
    (at / "export.json").write_text(EXPORT)
    m = Memories(spark, f"file://{at}/store", [Persona("ann", "Ann", "Reads a lot."), Persona("bob", "Bob")], roots=[f"file://{at}/in"], export=f"file://{at}/export.json")
    for _ in range(2):
        assert m.ingest(f"file://{at}/in", "Ann", default_era="now") == 5
    return m


def test_summon(memories):
    rows = memories.summon("fifth question", "ANN", 2).collect()
    assert rows[0].user_input == "fifth question" and rows[0].has_full_context and rows[0].source_label == "s.jsonl"
    assert rows[0].score >= rows[1].score
    assert memories.summon("fifth question", "ann", 2, era="then").count() == 0
    assert memories.remember("fifth question", "ann", 1).first().note == "These are YOUR OWN memories, Ann. You said these things in the past."
    told = memories.invoke("fifth question", "ann", 1).first()
    assert "User: fifth question\nAnn: part A of answer part B\n---\n" in told.prompt and told.listing.startswith("[Score: ")
    stamps = {r.title: r.timestamp for r in memories.summon("A note", "ann", 5).collect()}
    assert stamps["A note: with colon"] == "2026-01-02"
    for bad in (lambda: memories.summon("a question", "eve"), lambda: memories.summon("x", "ann"), lambda: memories.summon("a question", "ann", 0)):
        with pytest.raises(ValueError):
            bad()


def test_rehydrate(memories):
    prompt = memories.rehydrate("fifth question", "ann", 2).first().prompt
    assert prompt.startswith("# Ann\n\nReads a lot.") and "User: fifth question\nAnn: part A of answer part B" in prompt
    assert prompt.count("[Relevance: ") == 2 and prompt.endswith("Current query: fifth question")


def test_retrieve_full(memories):
    hit = memories.summon("fifth question", "ann", 1).first()
    assert memories.retrieve_full("00" + hit.point_id, "ann", 1).first() == memories.retrieve_full(int(hit.point_id), "ann", 1).first()
    row = memories.retrieve_full(int(hit.point_id), "ann", 1).first()
    assert (row.source_type, row.total_turns, row.matched_turn_index, row.context_range, row.error) == ("claude_jsonl", 8, 6, [5, 7], None)
    assert [t.role for t in row.turns] == ["assistant", "user", "assistant"]
    moved = memories.retrieve_full(source_file="/gone/session-1.json", search_text="an answer of enough", context_turns=5).first()
    assert (moved.source_type, moved.matched_turn_index, moved.total_turns) == ("gemini_json", 1, 4)
    assert moved.turns[1].content == "an answer of enough length\n[Thinking: D1 | S2]"
    assert memories.retrieve_full(source_file="/gone/junk.txt", search_text="chat").first().error == "unsupported_format"
    assert memories.retrieve_full(source_file="/gone/away.md", search_text="chat").first().error == "source_file_not_found"
    assert memories.retrieve_full(-5, "ann").first().error == "point_not_found"
    assert memories.retrieve_full().first().error.startswith("Provide either")


def test_conversation(spark, memories):
    row = readers.conversation_context(whole(spark, "/e.json", EXPORT), "c1", "question", 1).first()
    assert (row.total_turns, row.matched_turn_index, [t.content for t in row.turns]) == (3, 1, ["sys", "question", "answer"])
    assert readers.conversation_context(whole(spark, "/e.json", EXPORT), "c2", "question", 1).isEmpty()


def test_stats(spark, memories, tmp_path):
    got = [(r.persona, r.n, r.available) for r in memories.stats().collect()]
    assert sorted(got, key=str) == sorted([("ann", 5, True), ("bob", None, False), (None, 5, True)], key=str)
    empty = Memories(spark, f"file://{tmp_path}/none", [Persona("ann", "Ann")])
    assert {r.title: r.n for r in empty.stats().collect()} == {"Ann": None, "total": 0}


def test_points_of_all_formats(spark):
    files = [("/a/s.jsonl", SESSION), ("/a/i.jsonl", ITEMS.split("\n", 1)[1]), ("/a/g.json", json.dumps(GEMINI)), ("/a/e.json", EXPORT), ("/a/n.md", NOTE), ("/a/u.bin", "x")]
    rows = readers.points_of_all(spark.createDataFrame(files, "path string, value string")).collect()
    assert sorted(r.source_file for r in rows) == ["/a/e.json", "/a/g.json", "/a/i.jsonl", "/a/n.md", *["/a/s.jsonl"] * 3]
    by = {r.source_file: r for r in rows}
    assert by["/a/g.json"].full_text.endswith("Thinking: S1: D1 | S2: ") and by["/a/g.json"].session_id == "s-1"
    assert by["/a/n.md"].tags == ["one", "two", "three"] and by["/a/n.md"].full_text.startswith("A note: with colon\n\nBody")
    assert by["/a/e.json"].conversation_id == "c1" and len(by["/a/e.json"].embedding) == 384


def test_roles(spark):
    rows = readers.parse_roles(whole(spark, "/r.jsonl", '{"role":"user","content":"q"}\n{"type":"model","content":["x",{"type":"text","text":"a"}]}\n{"type":"human","message":{"content":"q2"}}\n{"type":"assistant","message":{"content":"a2"}}\n')).collect()
    assert [r.user_input for r in rows][-1] == "q2"


def test_settings(spark):
    rows = readers.settings(whole(spark, "/.env", "# no\n\nA = 'one=1'\nB=two\nB=\"three\"\nbroken\n")).collect()
    assert {r.key: r.value for r in rows} == {"A": "one=1", "B": "three"}
    assert [r.key for r in readers.settings(whole(spark, "/.env", "A=1\nB=2"), "B").collect()] == ["B"]


def test_labels(spark):
    df = spark.createDataFrame([("1700000000",), ("2026-01-02T03:04:05Z",), ("soon",), (None,)], "t string")
    assert [r[0] for r in df.select(x.day(F.col("t"))).collect()] == ["2023-11-14", "2026-01-02", None, None]
    keys = spark.createDataFrame([("PASTE_HERE",), ("a b",), ("printf x",), ("real",), ("",), (None,)], "k string")
    assert [r[0] for r in keys.select(x.unusable_key(F.col("k"))).collect()] == [True, True, True, False, False, False]
    bundle = spark.createDataFrame([("/home/u/x MY_API_KEY=abc gho_1a2b",)], "l string")
    assert bundle.select(x.redact_home(F.col("l"), "/home/u")).first()[0] == "~/x MY_API_KEY=REDACTED gho_REDACTED"
    assert spark.range(1).select(x.percent(F.lit(0.8731))).first()[0] == "87.3%"


def test_diary_and_drawers(spark):
    now = F.lit("2026-01-02 03:04:05").cast("timestamp")
    diary = spark.range(1).select(*drawers.write_diary("ann", "first", now)).unionByName(spark.range(1).select(*drawers.write_diary("ann", "second", now + F.expr("interval 1 day"))))
    assert [r.content for r in drawers.read_diary(diary, "ann", 1).collect()] == ["second"]
    filed = spark.createDataFrame([(1, "f", 2), (2, "f", None), (3, "g", 0)], "id int, source_file string, chunk_index int")
    assert [(r.id, r.is_current) for r in drawers.find(filed, "id", 1).collect()] == [(2, False), (1, True)]
    with pytest.raises(LookupError):
        drawers.find(filed, "id", 9)


def test_drawers_are_filed_once(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    now = F.lit("2026-01-02 03:04:05").cast("timestamp")
    first = drawers.file_drawer(spark, at, "w", "r", "some content", now=now).first()
    again = drawers.file_drawer(spark, at, "w2", "r2", "some content").first()
    other = drawers.file_drawer(spark, at, "w", "r", "other content", "/f/x.md", "me").first()
    assert (first.success, first.reason) == (True, None) and (again.success, again.drawer_id, again.reason) == (False, first.drawer_id, "duplicate") and other.success
    kept = store.collection(spark, at, "drawers")
    page = drawers.browse(kept, "w", "r", 1).first()
    assert (page.total, len(page.items)) == (2, 1) and page["items"][0].source_name == "x.md"
    none = drawers.browse(kept, "w", "r", 5, 7).first()
    assert (none.total, none["items"]) == (2, [])
    for agent, entry in (("ann", "one"), ("ann", "two"), ("bob", "three")):
        assert drawers.file_diary(spark, at, agent, entry).first().success
    assert {r.content for r in drawers.read_diary(store.collection(spark, at, "diary"), "ann").collect()} == {"one", "two"}
    with pytest.raises(ValueError):
        drawers.file_drawer(spark, at, "", "r", "x")


def test_summaries_of_nulls(spark):
    row = drawers.summary(spark.createDataFrame([("d", None)], "id string, document string"), "id", "document").first()
    assert tuple(row) == ("d", "", "", "", "", None, None, None, "")


def test_levels(spark):
    rows = spark.createDataFrame([("L1",), ("L3",), ("L5",), (None,), ("odd",)], "level string")
    assert [r.level for r in ops.visible(rows, "L3").collect()] == ["L1", "L3"]
    assert [r.level for r in ops.elevate(rows, F.lit("L4")).collect()] == ["L4", "L4", "L5", None, "odd"]
    assert [r.level for r in ops.elevate(rows, F.lit("nonsense")).collect()] == ["L1", "L3", "L5", None, "odd"]


def test_embedders(spark, monkeypatch):
    df = spark.createDataFrame([("a b a",), ("",), (None,), ("B A a",)], "t string")
    rows = [r[0] for r in df.select(vectors.hashed_embedder(16)(F.col("t"))).collect()]
    assert rows[0] == rows[3] and abs(sum(v * v for v in rows[0]) - 1) < 1e-6 and not any(rows[1]) and not any(rows[2])
    score = df.select(vectors.cosines([1.0, 0.0])(F.when(F.col("t") == "", F.array(F.lit(3.0), F.lit(4.0))).when(F.col("t").isNull(), F.array(F.lit(0.0), F.lit(0.0))).when(F.col("t") == "a b a", F.array(F.lit(1.0)))).alias("s"))
    assert [r.s for r in score.collect()] == [None, pytest.approx(0.6), None, None]
    assert df.select(vectors.choose_embedder("hashed")(F.col("t")).alias("v")).where("size(v) = 384").count() == 4
    with pytest.raises(ValueError):
        vectors.choose_embedder("nothing")


def test_embedder_of_a_service(spark):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body["model"], len(body["prompt"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"embedding": [] if body["prompt"] == "none" else [1.0, float(len(body["prompt"]))]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    embed = vectors.choose_embedder("ollama", f"http://127.0.0.1:{server.server_port}/", "m")
    df = spark.createDataFrame([("  abc ",), ("x" * 9000,)], "t string").coalesce(1)
    assert [r[0] for r in df.select(embed(F.col("t"))).collect()] == [[1.0, 3.0], [1.0, 8000.0]]
    assert {a[:2] for a in asked} == {("/api/embeddings", "m")}
    with pytest.raises(Exception, match="empty vector"):
        spark.createDataFrame([("none",)], "t string").select(embed(F.col("t"))).collect()
    server.shutdown()


def test_health(spark):
    rows = spark.createDataFrame([("b", True, 3, "/b"), ("a", False, None, "/a")], "layer string, available boolean, total long, path string")
    assert not ops.health(rows, ("a", "b")).first().ok and ops.health(rows, ("b",)).first().ok
    assert [(r.layer, r.total) for r in ops.health(rows, ()).first().layers] == [("a", 0), ("b", 3)]


def test_rounds_of_checks(spark, tmp_path):
    """Only what changed is ingested, failures are tried again, and a state without changes is not written."""
    at = f"file://{tmp_path}/state"
    export = tmp_path / "export.json"
    export.write_text("[]")
    files = lambda t: spark.createDataFrame([("a", "/a/1", 1), ("b", "/b/1", t)], "source string, path string, changed int")
    seen = []

    def work(name, down=()):
        if name in down:
            raise OSError("down")
        seen.append(name)

    exports = {"e": f"file://{export}", "absent": f"file://{tmp_path}/no"}
    assert sorted(ingest.check(spark, at, files(1), lambda n: work(n, ("b",)), exports)) == ["a", "e"]
    assert ingest.check(spark, at, files(1), work, exports) == ["b"]
    assert ingest.check(spark, at, files(1), work, exports) == [] and len(list((tmp_path / "state").glob("state-*"))) == 2
    assert ingest.check(spark, at, files(2), work, exports) == ["b"]
    state = ingest.read_state(spark, at)
    assert {"a_hash", "b_hash", "e_mtime", "a_last_sync"} <= set(state)


def test_loop_waits_less_after_errors():
    waits, turns_ = [], iter([True, False, True])

    def work():
        if not next(turns_):
            raise OSError("down")

    assert ingest.loop(work, 300, 60, 3, waits.append) == 1 and waits == [300, 60]


def test_drops_are_archived(spark, tmp_path):
    (tmp_path / "in").mkdir()
    seen = []
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"id": n}))
        ingest.archive_drop(spark, f"{tmp_path}/in", f"{tmp_path}/done", "id long", f"{tmp_path}/mark", lambda df, _: seen.extend(r.id for r in df.collect()))
    assert seen == [0, 1, 2]
    assert list((tmp_path / "done").rglob("*.json"))


def test_facts_are_added_once(spark):
    kind = "subject string, predicate string, object string, valid_from int, valid_to int"
    facts = spark.createDataFrame([("a", "p", "b", 1, None), ("a", "p", "c", 1, 2)], kind)
    new = spark.createDataFrame([("a", "p", "b", 5, None), ("a", "p", "c", 5, None)], kind)
    assert sorted((r.object, r.valid_from) for r in graph.add(facts, new).collect()) == [("b", 1), ("c", 1), ("c", 5)]


def test_doctor_of_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, None, None)], "task_id int, status string, priority string, assignee string, project string")
    got = tasks.doctor(rows, spark.createDataFrame([("p",)], "project string")).collect()
    assert {r.problem for r in got} == {"unknown status", "unknown priority", "orphan"}


def test_sync_keeps_failures_for_later(spark):
    files = spark.createDataFrame([("a", "/a/1", 1), ("b", "/b/1", 1)], "source string, path string, changed int")

    def fails_on_b(source):
        if source == "b":
            raise OSError("down")

    none = spark.createDataFrame([], "source string, fingerprint string")
    done = ingest.sync(files, none, fails_on_b)
    assert [s for s, _ in done] == ["a"]
    state = spark.createDataFrame(done, "source string, fingerprint string")
    assert [s for s, _ in ingest.sync(files, state, lambda _: None)] == ["b"]


def test_pairs_across_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    schema = "conv_id long, turn long, role string, text string"
    for batch in ([(1, 0, "user", "q"), (2, 0, "user", "lost")], [(2, 1, "user", "q2"), (1, 1, "assistant", "a"), (2, 2, "assistant", "a2")]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(folder)
        stream = ingest.pairs(spark.readStream.schema(schema).parquet(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(out).orderBy("conv_id").collect()
    assert [(r.conv_id, r.turn, r.user_text, r.assistant_text) for r in rows] == [(1, 0, "q", "a"), (2, 1, "q2", "a2")]


def test_pairs_forget(spark, tmp_path):
    """A question is forgotten once turns of a time long after it have come."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    schema = "conv_id long, turn long, role string, text string, ts timestamp"
    at = lambda day: datetime.datetime(2026, 1, day, tzinfo=datetime.UTC)
    for batch in ([(1, 0, "user", "q", at(1)), (2, 0, "user", "q2", at(20))], [(3, 0, "user", "q3", at(21))], [(1, 1, "assistant", "late", at(21)), (2, 1, "assistant", "a2", at(21))]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(folder)
        stream = ingest.pairs(spark.readStream.schema(schema).parquet(folder), "ts", forget_hours=48)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
    assert [(r.conv_id, r.user_text, r.assistant_text) for r in spark.read.parquet(out).collect()] == [(2, "q2", "a2")]
