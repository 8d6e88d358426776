"""The service's answers as JSON, and a thin HTTP server over them.

Routes are functions from a request's values to a DataFrame, whose rows (bounded: pages, hits, counts) become JSON. Drawers,
diary entries and facts are collections of a store; personas' memories are those of Memories."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.operators import drawers, graph, ops
from turnstone.operators.memory import Memories
from turnstone.sources import store

FACT = "id string, subject string, predicate string, object string, valid_from string, valid_to string"
DIARY = "id string, agent string, date string, timestamp string, topic string, content string"


@dataclass
class Service:
    """table: the store of drawers, diary and facts; memories: the personas; specification: the text of the notation."""

    spark: SparkSession
    table: str
    memories: Memories
    specification: str = ""

    def rows(self, name: str, schema: str) -> DataFrame:
        there = name in store.personas(self.spark, self.table)
        return store.collection(self.spark, self.table, name) if there else self.spark.createDataFrame([], schema)

    @property
    def drawers(self) -> DataFrame:
        return self.rows("drawers", drawers.DRAWER)

    @property
    def facts(self) -> DataFrame:
        return self.rows("facts", FACT)

    def health(self) -> DataFrame:
        layers = self.drawers.agg(F.lit("drawers").alias("layer"), F.lit(True).alias("available"), F.count("*").alias("total"), F.lit(self.table).alias("path"))
        points = self.memories.stats().where("persona is null").select(F.lit("memories").alias("layer"), F.coalesce("available", F.lit(False)).alias("available"), F.col("n").alias("total"), F.lit(self.memories.table).alias("path"))
        return ops.health(layers.unionByName(points), ("drawers",))

    def entity(self, name: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        if direction not in ("outgoing", "incoming", "both"):
            raise ValueError("direction is outgoing, incoming or both")
        return graph.about(self.facts if as_of is None else graph.as_of(self.facts, F.lit(as_of)), name, direction)

    def tunnels(self, wing_a: str | None, wing_b: str | None) -> DataFrame:
        found = graph.tunnels(self.drawers, "wing", "room", filed="filed_at")
        for wing in (wing_a, wing_b):
            found = found if wing is None else found.where(F.array_contains("wings", wing))
        return found.orderBy(F.desc("count"), "room")

    def search(self, q: str, wing: str | None, room: str | None, limit: int) -> DataFrame:
        if not q:
            raise ValueError("q is not empty")
        rows, embed = self.drawers, self.memories.embedder
        # drawers have their vectors from when they were filed; only older ones without any are embedded now
        there = F.col("embedding") if "embedding" in rows.columns else F.lit(None).cast("array<float>")
        old = rows.where(there.isNull()).withColumn("embedding", embed(F.col("document")).cast("array<float>"))
        rows = old if "embedding" not in rows.columns else rows.where(there.isNotNull()).unionByName(old)
        return drawers.search(rows, self.memories._vector(q), wing, room, limit)

    def find(self, id_: str) -> DataFrame:
        if self.drawers.where(F.col("id") == id_).isEmpty():
            raise LookupError(f"Drawer not found: {id_}")
        rows = drawers.siblings(self.drawers, "id", id_) if self.drawers.where(F.col("id") == id_).where("coalesce(source_file, '') <> ''").count() else self.drawers.where(F.col("id") == id_).withColumn("is_current", F.lit(True)).withColumn("chunk", F.lit(0))
        return rows.orderBy("chunk", "id").select("id", "wing", "room", "source_file", "chunk_index", "filed_at", "added_by", F.col("document").alias("content"), "is_current")

    def counts(self, by: str, **where: str) -> DataFrame:
        own = drawers.counts(drawers.where_all(self.drawers, **where), by)
        return own.select(F.col(by).alias("name"), F.col("n").alias("count")).orderBy(F.desc("count"), "name")


Values = Mapping[str, str]
Route = tuple[str, str, Callable[[Service, Values], DataFrame], bool]


def _int(v: Values, name: str, default: int) -> int:
    return int(v.get(name) or default)


#: Method, pattern of the path, what answers, and whether the answer is one object and not a list.
ROUTES: tuple[Route, ...] = (
    ("GET", "/api/health", lambda s, v: s.health(), True),
    ("GET", "/api/dashboard/summary", lambda s, v: drawers.overview(s.drawers), True),
    ("GET", "/api/wings", lambda s, v: s.counts("wing"), False),
    ("GET", "/api/wings/{wing}/rooms", lambda s, v: s.counts("room", wing=v["wing"]), False),
    ("GET", "/api/wings/{wing}/rooms/{room}/drawers", lambda s, v: drawers.browse(s.drawers, v["wing"], v["room"], _int(v, "limit", 30), _int(v, "offset", 0)), True),
    ("GET", "/api/drawers/recent", lambda s, v: drawers.summary(drawers.page(s.drawers, "id", _int(v, "limit", 6)), "id", "document"), False),
    ("GET", "/api/drawers/{id}", lambda s, v: s.find(v["id"]), False),
    ("GET", "/api/search", lambda s, v: s.search(v.get("q", ""), v.get("wing"), v.get("room"), _int(v, "limit", 10)), False),
    ("POST", "/api/drawers", lambda s, v: drawers.file_drawer(s.spark, s.table, v.get("wing", ""), v.get("room", ""), v.get("content", ""), v.get("source_file"), v.get("added_by", "web"), embedder=s.memories.embedder), True),
    ("GET", "/api/diary/{agent}", lambda s, v: drawers.read_diary(s.rows("diary", DIARY), v["agent"], _int(v, "last_n", 10)), False),
    ("POST", "/api/diary", lambda s, v: drawers.file_diary(s.spark, s.table, v.get("agent_name", ""), v.get("entry", ""), v.get("topic", "general")), True),
    ("GET", "/api/knowledge/stats", lambda s, v: graph.fact_stats(s.facts), True),
    ("GET", "/api/knowledge/entities/{entity}", lambda s, v: s.entity(v["entity"], v.get("as_of"), v.get("direction", "both")), False),
    ("GET", "/api/knowledge/timeline", lambda s, v: graph.timeline(s.facts, v.get("entity")), False),
    ("GET", "/api/tunnels", lambda s, v: s.tunnels(v.get("wing_a"), v.get("wing_b")), False),
    ("GET", "/api/graph/stats", lambda s, v: graph.graph_stats(s.drawers, "wing", "room"), True),
    ("GET", "/api/spec", lambda s, v: s.spark.createDataFrame([(s.specification,)], "spec string"), True),
    ("GET", "/api/memories/search", lambda s, v: s.memories.summon(v.get("q", ""), v.get("persona", ""), _int(v, "limit", 10), v.get("era")), False),
    ("GET", "/api/memories/personas", lambda s, v: s.memories.stats().where("persona is not null"), False),
    ("GET", "/api/memories/retrieve_full", lambda s, v: s.memories.retrieve_full(v.get("point_id"), v.get("persona"), _int(v, "context_turns", 5), v.get("source_file"), v.get("search_text")), True),
)


def to_json(df: DataFrame, one: bool) -> str:
    """Rows as a list with their number, or the only row as an object; nulls stay."""
    rows = [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()]
    return json.dumps((rows or [None])[0] if one else {"total": len(rows), "items": rows}, ensure_ascii=False, indent=2)


def answer(service: Service, method: str, url: str, body: Values | None = None) -> tuple[int, str]:
    """Status and JSON: 404 for what is not there, 422 for values that are wrong."""
    parts = urlsplit(url)
    for verb, pattern, work, one in ROUTES:
        found = re.fullmatch(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/]+)", pattern), parts.path)
        if verb == method and found:
            values = {**dict(parse_qsl(parts.query)), **(body or {}), **{k: unquote(v) for k, v in found.groupdict().items()}}
            try:
                return 200, to_json(work(service, values), one)
            except LookupError as e:
                return 404, json.dumps({"error": str(e)})
            except ValueError as e:
                return 422, json.dumps({"error": str(e)})
    return 404, json.dumps({"error": f"no route {method} {parts.path}"})


def server(service: Service, port: int = 0, host: str = "127.0.0.1") -> HTTPServer:
    """A server that is ready to serve; one request at a time, as the session is one."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, text = answer(service, self.command, self.path, json.loads(raw) if raw else None)
            except json.JSONDecodeError as e:
                status, text = 422, json.dumps({"error": str(e)})
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do  # noqa: N815

        def log_message(self, *_: object) -> None:
            pass

    return HTTPServer((host, port), Handler)
