"""Parsers on small files with the shapes that occur, the store, and incremental ingest."""

import json

import pytest
from pyspark.sql import functions as F

from turnstone.sources import chats, readers, store
from turnstone.streaming import ingest

SESSION = """{"type":"human","content":"first question"}
{"type":"assistant","content":"first answer, long enough"}

not json
{"role":"user","content":"second question"}
{"role":"assistant","content":"short"}
{"sender":"human","message":"third question"}
{"sender":"claude","message":"third answer, also long enough"}
{"type":"user","message":{"content":"fourth question"}}
{"type":"summary"}
{"type":"assistant","message":{"content":"orphaned by the summary row"}}
{"type":"user","message":{"content":"fifth question"}}
{"type":"assistant","message":{"content":[{"type":"text","text":"part A of answer"},{"type":"tool_use","name":"x"},{"type":"text","text":"part B"}]}}
"""
ITEMS = """{"type":"session_meta","payload":{"id":"s1"}}
{"type":"response_item","payload":{"type":"message","role":"user","content":[{"type":"input_text","text":" ask "}]}}
{"type":"response_item","payload":{"type":"reasoning","summary":[]}}
{"type":"response_item","payload":{"type":"message","role":"assistant","content":[{"type":"output_text","text":"line one"},{"type":"output_text","text":" "},{"type":"output_text","text":"line two of answer"}]}}
"""
GEMINI = {"sessionId": "s-1", "messages": [{"type": "user", "content": "q", "timestamp": "2026-01-01T00:00:00Z"}, {"type": "gemini", "content": "an answer of enough length", "thoughts": [{"subject": "S1", "description": "D1"}, {"subject": "S2"}]}, {"type": "user", "content": ""}, {"type": "gemini", "content": "skipped because user text is empty"}]}
EXPORT = '[{"id":"c1","title":"T","create_time":10,"mapping":{"z":{"message":{"author":{"role":"assistant"},"content":{"parts":["ans",{"x":1},"wer"]},"create_time":2.0}},"a":{"message":null},"m":{"message":{"author":{"role":"user"},"content":{"parts":["question"]},"create_time":1.0}},"k":{"message":{"author":{"role":"system"},"content":{"parts":["sys"]},"create_time":null}}}}]'
NOTE = '---\ntitle: "A note: with colon"\ntags: one, two ,,three\nstatus:\n- listitem\ncreated: 2026-01-02\n---\nBody text of the note, long enough.\n'


def whole(spark, path, text):
    return spark.createDataFrame([(path, text)], "path string, value string")


def test_sessions(spark):
    rows = chats.parse_sessions(whole(spark, "/a/s.jsonl", SESSION)).orderBy("at").collect()
    assert [r.user_input.split()[0] for r in rows] == ["first", "second", "third", "fifth"]
    assert rows[-1].ai_response == "part A of answer part B"
    assert len([r for r in rows if len(r.ai_response) >= 20]) == 3


def test_items(spark):
    (row,) = chats.parse_items(whole(spark, "/a/s.jsonl", ITEMS)).collect()
    assert (row.user_input, row.ai_response) == ("ask", "line one\nline two of answer")


def test_session_json(spark):
    (row,) = chats.parse_session_json(whole(spark, "/a/stem.json", json.dumps(GEMINI))).collect()
    assert (row.session_id, row.thinking, row.user_input) == ("s-1", "S1: D1 | S2: ", "q")
    named = {k: v for k, v in GEMINI.items() if k != "sessionId"}
    assert chats.parse_session_json(whole(spark, "/a/stem.json", json.dumps(named))).first().session_id == "stem"
    assert chats.parse_session_json(whole(spark, "/a/b.json", "{bad")).count() == 0


def test_export(spark):
    df = whole(spark, "/a/e.json", EXPORT)
    assert [r.text for r in chats.export_turns(df).orderBy("index").collect()] == ["sys", "question", "answer"]
    (row,) = chats.parse_export(df).collect()
    assert (row.user_input, row.ai_response) == ("question", "answer")
    assert chats.parse_export(whole(spark, "/a/e.json", EXPORT.replace('"create_time":null', '"create_time":1.5'))).count() == 0


def test_notes(spark):
    row = chats.parse_notes(whole(spark, "/v/dir/n.md", NOTE)).first()
    assert (row.title, row.tags, row.status, row.created, row.directory, row.body) == ("A note: with colon", ["one", "two", "three"], "", "2026-01-02", "dir", "Body text of the note, long enough.")
    plain = chats.parse_notes(whole(spark, "/v/dir/stem.md", "No front matter, but long enough.")).first()
    assert (plain.title, plain.tags) == ("stem", [])
    assert chats.parse_notes(whole(spark, "/v/n.md", "too short")).count() == 0


def test_formats(spark):
    first_item = ITEMS.split("\n", 1)[1]
    cases = [("/n.md", NOTE, "markdown"), ("/a.jsonl", SESSION, "claude_jsonl"), ("/b.jsonl", first_item, "codex_jsonl"), ("/c.jsonl", ITEMS, "claude_jsonl"), ("/d.jsonl", '{"sessionId":"x"}', "codex_jsonl"), ("/e.json", json.dumps(GEMINI), "gemini_json"), ("/f.json", EXPORT, "openai_json"), ("/g.json", " " * 300 + EXPORT, "unknown"), ("/h.jsonl", "", "unknown"), ("/i.txt", "x", "unknown")]
    df = spark.createDataFrame([c[:2] for c in cases], "path string, value string")
    assert {r.path: r.format for r in chats.detect_format(df).collect()} == {c[0]: c[2] for c in cases}


def test_files(spark, tmp_path):
    (tmp_path / "sub" / ".hidden").mkdir(parents=True)
    (tmp_path / "sub" / "a.md").write_text(NOTE)
    (tmp_path / "sub" / "tiny.md").write_text("x")
    (tmp_path / "sub" / "b.txt").write_text(NOTE)
    found = chats.files(spark, str(tmp_path), "*.md", least_bytes=50, hidden=False)
    assert [r.path.rsplit("/", 1)[1] for r in found.collect()] == ["a.md"]


def test_resolve(spark):
    known = spark.createDataFrame([(1, "/x/a.md"), (2, "/y/a.md"), (1, "/x/b.md")], "root int, path string")
    wanted = spark.createDataFrame([("/gone/a.md",), ("/x/b.md",), ("/gone/c.md",)], "path string")
    assert {r.path: r.found for r in chats.resolve(wanted, known).collect()} == {"/gone/a.md": "/x/a.md", "/x/b.md": "/x/b.md", "/gone/c.md": None}


def test_paths_are_those_that_other_readers_open(spark, tmp_path):
    names = ["My note.md", "50%.md", "a+b.md", "ñandú [1].md"]
    (tmp_path / "sub dir").mkdir()
    for n in names:
        (tmp_path / "sub dir" / n).write_text(NOTE)
    found = chats.files(spark, str(tmp_path), "*.md")
    paths = sorted(r.path for r in found.collect())
    assert paths == sorted(f"{tmp_path}/sub dir/{n}" for n in names) and all(store.exists(spark, p) for p in paths)
    plain = NOTE.replace('title: "A note: with colon"\n', "")
    rows = chats.parse_notes(found.withColumn("value", F.lit(plain))).collect()
    assert sorted(r.title for r in rows) == sorted(n.removesuffix(".md") for n in names) and {r.directory for r in rows} == {"sub dir"}
    for n in names:
        assert readers.locate(spark, f"/gone/{n}", [str(tmp_path)]) == f"{tmp_path}/sub dir/{n}"


def test_scans(spark, tmp_path):
    for at in ("a/chats/session-1.json", "a/b/chats/session-2.json", "a/chats/other.json", "a/session-3.json", "second/x/chats/session-4.json"):
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_text("{}")
    roots = [str(tmp_path / "gone"), str(tmp_path)]
    names = lambda **k: {(r.root, r.path.rsplit("/", 1)[1]) for r in chats.scan(spark, roots, **k).collect()}
    assert names(glob="session-*.json", under="chats", depth=2) == {(1, "session-1.json")}
    assert names(glob="*.json", under="chats") == {(1, "session-1.json"), (1, "session-2.json"), (1, "other.json"), (1, "session-4.json")}
    assert {r.path.rsplit("/", 1)[1] for r in chats.scan(spark, [f"file://{tmp_path}/second"], "session-*.json", "chats", 2).collect()} == {"session-4.json"}
    assert chats.scan(spark, roots[:1], "*").count() == 0
    assert chats.first_existing(spark, None, roots[0], roots[1], roots[0]) == roots[1] and chats.first_existing(spark, None, roots[0]) == roots[0] and chats.first_existing(spark, "given", roots[1]) == "given"


def test_the_last_conversation_of_an_id_counts(spark):
    talk = '{"id":%s,"title":"%s","mapping":{"m":{"message":{"author":{"role":"user"},"content":{"parts":["%s"]},"create_time":1.0}}}}'
    text = "[" + ",".join(talk % x for x in [('"c1"', "old", "one"), ('"c2"', "other", "two"), ('"c1"', "new", "three"), ("null", "n", "four"), ('""', "n", "five")]) + "]"
    got = [(r.id, r.title, r.text, r["index"]) for r in chats.export_turns(whole(spark, "/e.json", text)).collect()]
    assert sorted(got, key=str) == sorted([("c1", "new", "three", 0), ("c2", "other", "two", 0), (None, "n", "four", 0), ("", "n", "five", 0)], key=str)


def test_texts_of_lists(spark):
    line = '{"role":"user","content":["plain",{"type":"tool","text":"kept"},{"x":1}]}\n{"role":"assistant","content":[{"type":"text","text":"a"},"b"]}'
    (row,) = readers.parse_roles(whole(spark, "/r.jsonl", line)).collect()
    assert (row.user_input, row.ai_response) == ("plain kept", "a b")


def test_upsert_is_idempotent(spark, tmp_path):
    at = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], "id long, batch int, v string")
    for _ in range(2):
        assert store.upsert(at, rows, "p") == 3
    store.upsert(at, spark.createDataFrame([(9, 1, "z")], "id long, batch int, v string"), "q")
    got = sorted((r.persona, r.id, r.v) for r in store.collection(spark, at).collect())
    assert got == [("p", 1, "c"), ("p", 2, "b"), ("q", 9, "z")]
    assert store.personas(spark, at) == ["p", "q"]


def test_upserts_merge_and_survive_a_crash(spark, tmp_path, monkeypatch):
    at = f"file://{tmp_path}/store"
    kind = "id long, batch int, v string"
    store.create(spark, at, "p", "id long, v string")
    assert store.collection(spark, at, "p").count() == 0
    for i in range(12):
        store.upsert(at, spark.createDataFrame([(i, 0, f"v{i}"), (100, 0, f"last{i}")], kind), "p")
    want = {**{i: f"v{i}" for i in range(12)}, 100: "last11"}
    read = lambda: {r.id: r.v for r in store.collection(spark, at, "p").collect()}
    assert read() == want and store.collection(spark, at, "p").count() == 13

    def down(*_):
        raise OSError("down")

    with monkeypatch.context() as m:
        m.setattr(store, "_publish", down)
        try:
            store.upsert(at, spark.createDataFrame([(1, 0, "lost")], kind), "p")
        except OSError:
            pass
    assert read() == want
    held = store.collection(spark, at, "p")
    store.upsert(at, spark.createDataFrame([(1, 0, "new")], kind), "p")
    assert {r.id: r.v for r in held.collect()} == want  # a reader that began before sees the old collection
    assert store.vacuum(spark, at, "p") > 0 and read() == {**want, 1: "new"}


def test_rows_of_an_upsert_run_once(spark, tmp_path):
    ran = spark.sparkContext.accumulator(0)

    def note(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    rows = spark.range(7).selectExpr("id", "0 AS batch").mapInArrow(note, "id long, batch int")
    assert store.upsert(f"file://{tmp_path}/store", rows, "p") == 7 and ran.value == 7


def test_drops_are_taken_once(spark, tmp_path):
    seen = []
    folder, mark = f"{tmp_path}/in", f"{tmp_path}/mark"
    spark.range(3).write.parquet(folder)
    for n in (3, 0):
        del seen[:]
        ingest.run_drop(spark, folder, "id long", mark, lambda df, _: seen.extend(df.collect()))
        assert len(seen) == n


def test_changed(spark):
    files = spark.createDataFrame([("a", "/a/1", 1), ("a", "/a/2", 2), ("b", "/b/1", 1)], "source string, path string, changed int")
    state = ingest.changed(files, spark.createDataFrame([], "source string, fingerprint string"))
    assert state.count() == 2
    moved = files.withColumn("changed", F.when(F.col("path") == "/a/2", 3).otherwise(F.col("changed")))
    assert [r.source for r in ingest.changed(moved, state).collect()] == ["a"]


def test_two_writers_of_one_manifest(spark, tmp_path):
    """The second fails and nothing of it counts; a manifest that a crash left half written is passed over, also by vacuum."""
    at = f"file://{tmp_path}/s"
    rows = lambda i: spark.createDataFrame([(i, 0, f"v{i}")], "id long, batch int, text string")
    store.upsert(at, rows(1), "p")
    number, content = store._manifest(spark, f"{at}/p")
    store._publish(spark, f"{at}/p", number + 1, content)
    with pytest.raises(RuntimeError, match="another writer"):
        store._publish(spark, f"{at}/p", number + 1, {"segments": [], "id": "id"})
    (tmp_path / "s/p" / f"manifest-{number + 2:012d}").write_text('{"segm')
    assert [r.id for r in store.collection(spark, at, "p").collect()] == [1]
    store.upsert(at, rows(2), "p")
    (tmp_path / "s/p" / f"manifest-{number + 4:012d}").write_text("")
    store.vacuum(spark, at, "p")
    assert sorted(r.id for r in store.collection(spark, at, "p").collect()) == [1, 2]
