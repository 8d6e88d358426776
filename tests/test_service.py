"""The service's routes, from requests to JSON."""

import json
from threading import Thread
from urllib.request import Request, urlopen

import pytest

from turnstone import service
from turnstone.operators.memory import Memories, Persona
from turnstone.sources import store


@pytest.fixture(scope="module")
def api(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("service")
    s = service.Service(spark, f"file://{at}/store", Memories(spark, f"file://{at}/memories", [Persona("ann", "Ann")]), "the notation")

    def ask(method, url, **body):
        status, text = service.answer(s, method, url, body or None)
        return status, json.loads(text)

    assert ask("GET", "/api/wings") == (200, {"total": 0, "items": []})
    seeds = [("alpha", "backend", "auth one", "/tmp/auth.md"), ("alpha", "backend", "auth two", "/tmp/auth.md"), ("alpha", "front", "ui", "/tmp/ui.md"), ("notes", "front", "plan ñ", None)]
    for wing, room, content, source in seeds:
        assert ask("POST", "/api/drawers", wing=wing, room=room, content=content, source_file=source)[1]["success"]
    assert ask("POST", "/api/drawers", wing="x", room="y", content="ui")[1]["reason"] == "duplicate"
    facts = spark.createDataFrame([("1", "ann", "likes", "tea", "2026-01-01", "2026-02-01", 0), ("2", "ann", "likes", "rum", "2026-02-01", None, 0)], service.FACT + ", batch int")
    store.upsert(s.table, facts, "facts")
    return s, ask


def test_drawers(api):
    _, ask = api
    assert [(i["name"], i["count"]) for i in ask("GET", "/api/wings")[1]["items"]] == [("alpha", 3), ("notes", 1)]
    assert [i["name"] for i in ask("GET", "/api/wings/alpha/rooms")[1]["items"]] == ["backend", "front"]
    page = ask("GET", "/api/wings/alpha/rooms/backend/drawers?limit=1")[1]
    assert page["total"] == 2 and len(page["items"]) == 1
    id_ = page["items"][0]["id"]
    rows = ask("GET", f"/api/drawers/{id_}")[1]["items"]
    assert len(rows) == 2 and [r["id"] for r in rows if r["is_current"]] == [id_]
    assert ask("GET", "/api/drawers/none")[0] == 404
    assert ask("GET", "/api/wings/alpha/rooms/backend/drawers?limit=0")[0] in (200, 422)
    assert ask("GET", "/api/wings/alpha/rooms/backend/drawers?limit=201")[0] == 422
    assert len(ask("GET", "/api/drawers/recent")[1]["items"]) == 4
    hits = ask("GET", "/api/search?q=auth%20two&wing=alpha&limit=2")[1]["items"]
    assert hits[0]["content"] == "auth two" and hits[0]["similarity"] == 1.0 and len(hits) == 2
    assert ask("GET", "/api/search?q=")[0] == 422


def test_rest(api):
    _, ask = api
    assert ask("GET", "/api/health")[1]["ok"]
    summary = ask("GET", "/api/dashboard/summary")[1]
    assert (summary["drawers"], summary["wings"], summary["graph"]["tunnel_rooms"]) == (4, 2, 1) and summary["top_wings"][0] == {"name": "alpha", "count": 3}
    assert ask("POST", "/api/diary", agent_name="ann", entry="wrote tests")[1]["success"]
    assert ask("GET", "/api/diary/ann")[1]["items"][0]["content"] == "wrote tests" and ask("GET", "/api/diary/ann?last_n=101")[0] == 422
    assert ask("GET", "/api/knowledge/stats")[1]["triples"] == 2
    assert [i["object"] for i in ask("GET", "/api/knowledge/entities/ann?as_of=2026-01-15&direction=outgoing")[1]["items"]] == ["tea"]
    assert ask("GET", "/api/knowledge/entities/ann?direction=odd")[0] == 422
    assert ask("GET", "/api/knowledge/timeline?entity=rum")[1]["total"] == 1
    assert ask("GET", "/api/tunnels?wing_a=alpha&wing_b=notes")[1]["items"][0]["room"] == "front"
    assert ask("GET", "/api/graph/stats")[1]["rooms_per_wing"] == {"alpha": 2, "notes": 1}
    assert ask("GET", "/api/spec")[1] == {"spec": "the notation"}
    assert ask("GET", "/api/memories/personas")[1]["items"][0]["available"] is False
    assert ask("GET", "/api/memories/search?q=tea&persona=eve")[0] == 422
    assert ask("GET", "/api/memories/retrieve_full")[1]["error"].startswith("Provide either")
    assert ask("GET", "/nowhere")[0] == 404


def test_over_http(api):
    s, _ = api
    http = service.server(s)
    Thread(target=http.serve_forever, daemon=True).start()
    try:
        with urlopen(f"http://127.0.0.1:{http.server_port}/api/wings", timeout=60) as r:
            assert json.load(r)["total"] == 2
        sent = Request(f"http://127.0.0.1:{http.server_port}/api/drawers", b'{"wing":"w","room":"r","content":"over http"}', method="POST")
        with urlopen(sent, timeout=60) as r:
            assert json.load(r)["success"]
    finally:
        http.shutdown()
