"""The memory service: personas whose collections are searched, quoted in prompts, and traced back to their sources.

Answers are DataFrames; what is wrong with a request's values raises, what is missing in the data is an error column."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as x
from turnstone.functions.vectors import Embedder, hashed_embedder
from turnstone.operators import ops, search
from turnstone.sources import chats, readers, store

LEAST_QUERY_CHARS = 2
MOST_HITS, MOST_CONTEXT = 50, 20
# Fixed value: what a persona is told about memories of its own.
NOTE = "These are YOUR OWN memories, {}. You said these things in the past."


@dataclass(frozen=True)
class Persona:
    key: str
    title: str
    description: str = ""


def with_persona(rows: DataFrame, key: str, personas: Sequence[Persona]) -> DataFrame:
    """rows with persona_title and persona_description of the persona that key names, whatever its case; null where there is
    none. The registry is the driver's own list, so it is broadcast."""
    names = {"k_": [p.key.lower() for p in personas], "persona_title": [p.title for p in personas], "persona_description": [p.description for p in personas]}
    table = rows.sparkSession.createDataFrame(list(zip(*names.values(), strict=True)), "k_ string, persona_title string, persona_description string")
    return rows.withColumn("k_", F.lower(F.col(key))).join(F.broadcast(table), "k_", "left").drop("k_")


@dataclass
class Memories:
    """table: the store's folder; personas: who has a collection; roots: where files that moved are looked for; export:
    the file of conversations that points without a source file come from."""

    spark: SparkSession
    table: str
    personas: Sequence[Persona]
    embedder: Embedder = field(default_factory=hashed_embedder)
    roots: Sequence[str] = ()
    export: str | None = None

    def persona(self, key: str) -> Persona:
        known = {p.key: p for p in self.personas}
        if key.lower() not in known:
            raise ValueError(f"Unknown persona: {key}. Available: {list(known)}")
        return known[key.lower()]

    def points(self, key: str) -> DataFrame:
        return store.collection(self.spark, self.table, self.persona(key).key)

    def summon(self, query: str, persona: str, limit: int = 5, era: str | None = None) -> DataFrame:
        """The persona's memories most like the query, best first, ties by id; an era (other than all) is filtered first."""
        if len(query.strip()) < LEAST_QUERY_CHARS:
            raise ValueError(f"a query has at least {LEAST_QUERY_CHARS} characters")
        if not 1 <= limit <= MOST_HITS:
            raise ValueError(f"limit is 1 to {MOST_HITS}")
        points = self.points(persona)
        asked = self._vector(query)
        where = None if era in (None, "all") else F.col("era") == era
        hits = search.top_k(points, asked, limit, where, "id")
        given = hits.select("*", F.col("source_file").alias("given_source"))
        stamp = x.first_filled(*(F.col(c) for c in ("timestamp", "created", "updated")))
        out = search.project(given, F.col("id"), F.col("user_input"), F.col("ai_response"), F.col("given_source"), "conversation_id", "title", "vault", "era", stamp.alias("timestamp"), conversation=F.col("conversation_id"))
        return out.orderBy(F.desc("score"), F.col("point_id").cast("bigint"))

    def _vector(self, text: str) -> list[float]:
        return self.spark.createDataFrame([(text,)], "q string").select(self.embedder(F.col("q"))).first()[0]

    def remember(self, query: str, my_persona: str, limit: int = 5) -> DataFrame:
        """summon, told to the persona itself."""
        note = NOTE.format(self.persona(my_persona).title)
        return self.summon(query, my_persona, limit).withColumn("note", F.lit(note))

    def rehydrate(self, query: str, persona: str, limit: int = 5) -> DataFrame:
        """One row: the prompt."""
        p = self.persona(persona)
        title = f"{p.title}\n\n{p.description}" if p.description else p.title
        return search.prompt(self.summon(query, persona, limit), title, p.key.capitalize(), query)

    def invoke(self, query: str, persona: str, limit: int = 5) -> DataFrame:
        """One row: the prompt of the command line, over whole memories, and a listing with excerpts."""
        p = self.persona(persona)
        asked = self._vector(query)
        hits = search.top_k(self.points(persona), asked, limit, None, "id")
        whole = hits.select(F.col("id").cast("string").alias("point_id"), "score", F.coalesce("user_input", F.lit("Unknown")).alias("user_input"), F.coalesce("ai_response", F.lit("...")).alias("ai_response"))
        return search.plain_prompt(whole, p.title, p.key.capitalize(), query)

    def retrieve_full(self, point_id: int | str | None = None, persona: str | None = None, context_turns: int = 5, source_file: str | None = None, search_text: str | None = None) -> DataFrame:
        """One row: the turns around a memory in its source, found by its id or by file and text; error says what is
        missing."""
        if not 1 <= context_turns <= MOST_CONTEXT:
            raise ValueError(f"context_turns is 1 to {MOST_CONTEXT}")
        conversation = None
        if point_id is not None:
            found = self.points(persona or "").where(F.col("id").cast("string") == str(point_id).lstrip("0")).select("source_file", "conversation_id", "user_input").first()
            if found is None:
                return self._error("point_not_found")
            source_file, conversation, search_text = found
        elif not (source_file and search_text):
            return self._error("Provide either point_id or source_file+search_text")
        source = "" if (source_file or "").strip() in ("", "unknown") else source_file
        if not source and conversation:
            if self.export is None or not store.exists(self.spark, self.export):
                return self._error("export_not_found")
            out = readers.conversation_context(self._whole(self.export), conversation, search_text or "", context_turns)
            return self._shape(out, F.lit("openai_json"), self.export) if not out.isEmpty() else self._error("conversation_not_found")
        path = readers.locate(self.spark, source, self.roots) if source else None
        if path is None:
            return self._error("source_file_not_found")
        if conversation:
            out = readers.conversation_context(self._whole(path), conversation, search_text or "", context_turns)
            if not out.isEmpty():
                return self._shape(out, F.lit("openai_json"), path)
        return self._shape(readers.context_of(self._whole(path), search_text or "", context_turns), F.col("format"), path)

    def stats(self) -> DataFrame:
        """Each persona's points, and whether its collection is there; the last row is the total (persona null)."""
        registry = self.spark.createDataFrame([(p.key, p.title) for p in self.personas], "persona string, title string")
        points = store.collection(self.spark, self.table).select("persona") if store.personas(self.spark, self.table) else registry.select("persona").limit(0)
        by = ops.collection_stats(points, registry, "persona")
        total = by.agg(F.lit(None).cast("string").alias("persona"), F.lit("total").alias("title"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("available").alias("available"))
        return by.select("persona", "title", "n", "available").unionByName(total)

    def ingest(self, folder: str, persona: str, glob: str = "*", **options: object) -> int:
        """Reads all files under a folder into a persona's collection; the pairs seen, before ids are made unique."""
        key = self.persona(persona).key
        whole = chats.files(self.spark, folder, glob, hidden=False)
        return store.upsert(self.table, readers.points_of_all(whole, embedder=self.embedder, **options), key)

    def _whole(self, path: str) -> DataFrame:
        return self.spark.read.text(store.literal(path), wholetext=True).select(F.lit(path).alias("path"), "value")

    _ROW = "source_type string, source_file string, total_turns long, matched_turn_index long, context_range array<long>, turns array<struct<index:long,role:string,content:string>>, error string"

    def _error(self, error: str) -> DataFrame:
        return self.spark.createDataFrame([(None, None, None, None, None, None, error)], self._ROW)

    def _shape(self, out: DataFrame, kind: Column, path: str) -> DataFrame:
        have = out.columns
        error = F.col("error") if "error" in have else F.lit(None)
        return out.select(kind.alias("source_type"), F.lit(path).alias("source_file"), "total_turns", "matched_turn_index", F.col("context_range").cast("array<long>"), F.col("turns").cast("array<struct<index:long,role:string,content:string>>"), error.cast("string").alias("error"))
