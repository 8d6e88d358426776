"""Every operator bound to the driver's tables, and the SQL that must agree.

conversations are turns, embeddings memory vectors (label: persona), documents drawers (lang: wing, source: room), events
diary entries and facts, pages source paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions import text as x
from turnstone.functions.vectors import hashed_embedder
from turnstone.operators import drawers, graph, ops, search, tasks, turns
from turnstone.operators.memory import Memories, Persona, with_persona
from turnstone.sources import archive, chats, readers, scratch, store
from turnstone.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- turns ----------------------------------------------------------------------------------------------------------

_LEAD = "SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM {t} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
_PAIRS = "SELECT conv_id, turn, text AS user_text, nt AS assistant_text FROM (" + _LEAD + ") WHERE role = 'user' AND nr = 'assistant' AND text <> '' AND nt <> ''"
_ALL = _PAIRS.format(t="conversations")


def _pairs(spark, sf):
    return turns.pair(table(spark, sf, "conversations"), "conv_id", ["turn"])


@query(_ALL)
def pair_turns(spark, sf):
    return _pairs(spark, sf)


@query(_PAIRS.format(t="(SELECT * FROM conversations WHERE role <> 'system')"))
def pair_turns_filtered(spark, sf):
    return turns.pair(table(spark, sf, "conversations"), "conv_id", ["turn"], only=F.col("role") != "system")


@query(f"SELECT * FROM ({_ALL}) WHERE length(assistant_text) >= 300")
def pair_min_length(spark, sf):
    return turns.long_enough(_pairs(spark, sf), 300)


@query(f"SELECT conv_id, turn, 'User: ' || user_text || chr(10) || 'Assistant: ' || left(assistant_text, 200) AS full_text FROM ({_ALL})")
def embed_text_trunc(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", x.embed_text(F.col("user_text"), F.col("assistant_text"), answer_chars=200).alias("full_text"))


_STRIP = r"regexp_replace(coalesce({c}, ''), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g')"


def _sql_id(*parts: str) -> str:
    return "('0x' || substr(md5(" + " || chr(31) || ".join(_STRIP.format(c=p) for p in parts) + "), 1, 15))::BIGINT"


@query(f"SELECT conv_id, turn, {_sql_id("'conversations'", 'conv_id::VARCHAR', "''", 'user_text', 'assistant_text')} AS id FROM ({_ALL})")
def memory_ids(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", x.memory_id(F.lit("conversations"), F.col("conv_id"), F.col("user_text"), F.col("assistant_text")).alias("id"))


@query(f"SELECT doc_id, {_sql_id('source', 'lang', 'left(text, 2048)')} AS id FROM documents")
def document_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", x.document_id(F.col("source"), F.col("lang"), F.col("text")).alias("id"))


@query(f"SELECT id, max(doc_id) AS doc_id FROM (SELECT doc_id, {_sql_id('text')} AS id FROM documents) GROUP BY id")
def dedup_latest(spark, sf):
    return ops.latest(table(spark, sf, "documents").select("doc_id", x.stable_id(F.col("text")).alias("id")), "id", "doc_id")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS reader_role FROM conversations")
def role_map(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", readers.reader_role(F.col("role")).alias("reader_role"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 = 0 THEN 0 ELSE turn::DOUBLE END, turn) - 1)::INT AS index FROM conversations")
def openai_sort_nulls(spark, sf):
    t = table(spark, sf, "conversations").withColumn("time", F.when(F.col("turn") % 3 != 0, F.col("turn").cast("double")))
    return turns.chronological(t, "conv_id", "time", "turn").select("conv_id", "turn", "index")


@query("SELECT conv_id, min(CASE WHEN contains(lower(text), 'the ') THEN turn END) AS matched FROM conversations GROUP BY conv_id")
def match_turn_exact(spark, sf):
    return turns.match_exact(table(spark, sf, "conversations"), "conv_id", "turn", "THE ")


@query()
def match_turn_fuzzy(spark, sf):
    return turns.match_fuzzy(table(spark, sf, "conversations"), "conv_id", "turn", "plan the trip to the coast")


_CENTER = "SELECT conv_id, (max(turn) // 2)::BIGINT AS center FROM conversations GROUP BY conv_id"


def _centers(t):
    return t.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("center"))


@query(f"SELECT c.conv_id, c.turn, c.role, m.center FROM conversations c JOIN ({_CENTER}) m USING (conv_id) WHERE c.turn BETWEEN center - 2 AND center + 2")
def context_window(spark, sf):
    t = table(spark, sf, "conversations")
    return turns.context(t, _centers(t), "conv_id", "turn", 2).select("conv_id", "turn", "role", "center")


@query("SELECT conv_id, turn, min(turn) OVER w AS from_turn, max(turn) OVER w AS to_turn, (sum(length(text)) OVER w)::BIGINT AS frame_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def context_all_rows(spark, sf):
    return turns.frames(table(spark, sf, "conversations"), "conv_id", "turn", 2)


@query(f"SELECT conv_id, n AS total_turns, center AS matched_turn_index, greatest(0, center - 2)::BIGINT AS range_from, least(n - 1, center + 2)::BIGINT AS range_to, (SELECT count(*) FROM conversations c WHERE c.conv_id = m.conv_id AND c.turn BETWEEN center - 2 AND center + 2)::INT AS shown FROM ({_CENTER}) m JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) USING (conv_id)")
def full_context(spark, sf):
    t = table(spark, sf, "conversations")
    out = turns.full_context(t, _centers(t), "conv_id", "turn", 2)
    return out.select("conv_id", "total_turns", "matched_turn_index", F.col("context_range")[0].alias("range_from"), F.col("context_range")[1].alias("range_to"), F.size("turns").alias("shown"))


@query("SELECT conv_id, turn, (least(2200, greatest(420, length(text) * 10)) / 2.0)::DOUBLE AS delay FROM conversations")
def playback_delay(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", x.playback_delay(F.length("text"), 2.0).alias("delay"))


# --- labels and text ------------------------------------------------------------------------------------------------

ERAS = ("casino-win", "blog", "example.net", "/fr/")


@query("SELECT page_id, CASE " + " ".join(f"WHEN contains(replace(lower(url), '_', '-'), '{e}') THEN '{e}'" for e in ERAS) + " ELSE 'other' END AS era FROM pages")
def era_infer(spark, sf):
    return table(spark, sf, "pages").select("page_id", x.infer_label(F.col("url"), ERAS, "other").alias("era"))


@query("SELECT page_id, CASE WHEN trim(coalesce(url, '')) IN ('', 'unknown') THEN 'source pending' ELSE split_part(url, '/', -1) END AS label FROM pages")
def source_label(spark, sf):
    return table(spark, sf, "pages").select("page_id", x.source_label(F.col("url")).alias("label"))


_FLAT = r"regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')"


@query(f"SELECT doc_id, CASE WHEN length({_FLAT}) <= 220 THEN {_FLAT} ELSE rtrim(left({_FLAT}, 217), ' ') || '...' END AS preview FROM documents")
def preview(spark, sf):
    return table(spark, sf, "documents").select("doc_id", x.preview(F.col("text")).alias("preview"))


_REDACT = "text"
for _pattern, _to in (("sk-[A-Za-z0-9]{20,}", "sk-REDACTED"), ("(?i)anthropic[_-]?api[_-]?key\\s*[:=]\\s*[''\"]?[A-Za-z0-9_-]{10,}", "ANTHROPIC_API_KEY=REDACTED"), ("(?i)openai[_-]?api[_-]?key\\s*[:=]\\s*[''\"]?[A-Za-z0-9_-]{10,}", "OPENAI_API_KEY=REDACTED"), ("AIzaSy[A-Za-z0-9_-]{20,}", "AIzaSyREDACTED"), ('(?i)(token|secret|password|api_key)\\s*=\\s*"[^"]+"', '\\1="REDACTED"')):
    _REDACT = f"regexp_replace({_REDACT}, '{_pattern}', '{_to}', 'g')"
#: Texts that hold every kind of secret, made from a document's own id.
_KEYED = "SELECT doc_id, text || ' OpenAI-API-Key: \"k' || lpad(doc_id::VARCHAR, 12, 'x') || '\" sk-' || repeat('a', (doc_id % 30)::INT) || ' AIzaSy' || repeat('Z', (doc_id % 25)::INT) || ' anthropic_api_key=' || lpad(doc_id::VARCHAR, 9 + (doc_id % 3)::INT, 'q') AS text FROM documents"


@query(f"SELECT doc_id, md5({_REDACT}) AS redacted, {_REDACT} <> text AS changed FROM ({_KEYED})")
def redact(spark, sf):
    n = F.col("doc_id")
    keyed = F.concat("text", F.lit(' OpenAI-API-Key: "k'), F.lpad(n.cast("string"), 12, "x"), F.lit('" sk-'), F.repeat(F.lit("a"), (n % 30).cast("int")), F.lit(" AIzaSy"), F.repeat(F.lit("Z"), (n % 25).cast("int")), F.lit(" anthropic_api_key="), F.lpad(n.cast("string"), (n % 3 + 9).cast("int"), F.lit("q")))
    clean = x.redact(F.col("text"), (*x.SECRETS, x.TOKEN_ASSIGNMENT))
    return table(spark, sf, "documents").select("doc_id", keyed.alias("text")).select("doc_id", F.md5(clean).alias("redacted"), (clean != F.col("text")).alias("changed"))


@query(f"SELECT conv_id, turn, {_STRIP.format(c='user_text')} AS user_content, {_STRIP.format(c='assistant_text')} AS assistant_content FROM ({_ALL})")
def export_training(spark, sf):
    rows = ops.training_rows(_pairs(spark, sf), F.col("user_text"), F.col("assistant_text"), {"conv_id": F.col("conv_id"), "turn": F.col("turn")})
    return rows.select("meta.conv_id", "meta.turn", F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"))


# --- vectors --------------------------------------------------------------------------------------------------------


def _vector(spark, sf, id_=0):
    return table(spark, sf, "embeddings").where(F.col("vec_id") == id_).select("embedding").first()[0]


_SCORE = "round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 4)"


@query(f"SELECT vec_id, {_SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    return search.top_k(table(spark, sf, "embeddings"), _vector(spark, sf), 10).select("vec_id", "score")


@query(f"SELECT vec_id, {_SCORE} AS score FROM embeddings WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk_filtered(spark, sf):
    return search.top_k(table(spark, sf, "embeddings"), _vector(spark, sf), 10, F.col("label") == 3).select("vec_id", "score")


@query(f"SELECT vec_id, label, score, rank FROM (SELECT vec_id, label, {_SCORE} AS score, row_number() OVER (PARTITION BY label ORDER BY {_SCORE} DESC, vec_id)::INT AS rank FROM embeddings) WHERE rank <= 3")
def topk_per_persona(spark, sf):
    return search.top_k_by_group(table(spark, sf, "embeddings"), _vector(spark, sf), 3, "label")


def _neighbours(spark, sf, all_=False):
    e = table(spark, sf, "embeddings")
    found = search.neighbours(e, 10) if all_ else search.search_block(e, e.where(F.col("vec_id") % 100 == 0), 10)
    label = e.select(F.col("vec_id"), "label")
    return found.join(label.withColumnsRenamed({"vec_id": "id", "label": "found"}), "id").join(label.withColumnsRenamed({"vec_id": "query_id", "label": "asked"}), "query_id")


_HUNDREDTH = "q.vec_id % 100 = 0 AND "
_NEAR = f"SELECT q.vec_id AS query_id, e.vec_id AS id, q.label AS asked, e.label AS found, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS score FROM embeddings e, embeddings q WHERE {_HUNDREDTH}q.vec_id <> e.vec_id"
_RANKED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM ({_NEAR})) WHERE rank <= 10"


@query(f"SELECT query_id, id, score, rank FROM ({_RANKED})")
def cosine_search_block(spark, sf):
    return _neighbours(spark, sf).select("query_id", "id", "score", "rank")


@query(f"SELECT round(avg(a), 4) AS recall, round(avg(s), 4) AS precision FROM (SELECT max((asked = found)::INT) AS a, avg((asked = found)::INT::DOUBLE) AS s FROM ({_RANKED.replace(_HUNDREDTH, "")}) GROUP BY query_id)")
def recall_at_k(spark, sf):
    return search.recall_at_k(_neighbours(spark, sf, all_=True), F.col("asked") == F.col("found"), 10)


_IDEAL = "(SELECT sum(1 / log2(range + 1)) FROM range(1, 11) WHERE range <= (SELECT count(*) - 1 FROM embeddings l WHERE l.label = asked))"


@query(f"SELECT round(avg(CASE WHEN i > 0 THEN d / i ELSE 0 END), 4) AS ndcg FROM (SELECT sum((asked = found)::INT / log2(rank + 1)) AS d, max({_IDEAL}) AS i FROM ({_RANKED}) GROUP BY query_id)")
def ndcg(spark, sf):
    e = table(spark, sf, "embeddings")
    total = e.join(e.groupBy("label").agg((F.count("*") - 1).alias("total")), "label").select(F.col("vec_id").alias("query_id"), "total")
    return search.ndcg(_neighbours(spark, sf), (F.col("asked") == F.col("found")).cast("int"), 10, total)


def _hits(spark, sf):
    top = search.top_k(table(spark, sf, "embeddings"), _vector(spark, sf), 5).select("vec_id", "score")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang", "source")
    return search.project(top.join(docs, "vec_id"), F.col("vec_id"), F.col("lang"), F.col("text"), F.col("source"))


_HITS = f"SELECT vec_id::VARCHAR AS point_id, score, left(coalesce(lang, 'Unknown'), 500) AS user_input, left(coalesce(text, '...'), 1000) AS ai_response, coalesce(source, 'unknown') AS source_file, split_part(source, '/', -1) AS source_label, source IS NOT NULL AND source <> '' AS has_full_context FROM (SELECT vec_id, {_SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 5) JOIN documents ON doc_id = vec_id"


@query(_HITS)
def search_projection(spark, sf):
    return _hits(spark, sf)


def _two_places(c: str) -> str:
    return f"format('{{:.2f}}', round({c}, 2))"


@query(f"SELECT '# Archive' || chr(10) || chr(10) || string_agg('[Relevance: ' || {_two_places('score')} || ']' || chr(10) || 'User: ' || user_input || chr(10) || 'Assistant: ' || ai_response || chr(10), chr(10) ORDER BY score DESC, point_id) || chr(10) || 'Current query: what was said' AS prompt FROM ({_HITS})")
def rehydration_prompt(spark, sf):
    return search.prompt(_hits(spark, sf), "Archive", "Assistant", "what was said")


_WHOLE_HITS = f"SELECT vec_id::VARCHAR AS point_id, score, lang AS user_input, text AS ai_response FROM (SELECT vec_id, {_SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 5) JOIN documents ON doc_id = vec_id"


@query(f"SELECT 'You are Archive. These are your memories:' || chr(10) || chr(10) || string_agg('User: ' || user_input || chr(10) || 'Assistant: ' || ai_response || chr(10) || '---' || chr(10), '' ORDER BY score DESC, point_id) || chr(10) || 'Current query: what was said' AS prompt, string_agg('[Score: ' || {_two_places('score')} || ']' || chr(10) || 'Assistant: ' || left(ai_response, 150) || '...' || chr(10), '' ORDER BY score DESC, point_id) AS listing FROM ({_WHOLE_HITS})")
def command_line_prompt(spark, sf):
    top = search.top_k(table(spark, sf, "embeddings"), _vector(spark, sf), 5).select(F.col("vec_id").alias("doc_id"), "score")
    docs = table(spark, sf, "documents").join(F.broadcast(top), "doc_id")
    return search.plain_prompt(docs.select(F.col("doc_id").cast("string").alias("point_id"), "score", F.col("lang").alias("user_input"), F.col("text").alias("ai_response")), "Archive", "Assistant", "what was said")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id = 7")
def retrieve_by_id(spark, sf):
    wanted = spark.createDataFrame([(7,)], "vec_id long")
    return search.by_id(table(spark, sf, "embeddings"), wanted, "vec_id").select("vec_id", "label")


@query("SELECT w.vec_id, CASE WHEN e.vec_id IS NULL THEN 'point_not_found' END AS error FROM (VALUES (7::BIGINT), (-7::BIGINT)) w(vec_id) LEFT JOIN embeddings e USING (vec_id)")
def point_not_found(spark, sf):
    wanted = spark.createDataFrame([(7,), (-7,)], "vec_id long")
    return search.by_id(table(spark, sf, "embeddings"), wanted, "vec_id").select("vec_id", "error")


# --- collections and drawers ----------------------------------------------------------------------------------------


def _registry(spark):
    return spark.range(12).select(F.col("id").cast("int").alias("label"), F.concat(F.lit("persona_"), "id").alias("collection"))


_REGISTRY = "(SELECT range::INT AS label, 'persona_' || range AS collection FROM range(12))"


@query(f"SELECT label, collection, n, n IS NOT NULL AS available FROM {_REGISTRY} LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)")
def collection_stats(spark, sf):
    return ops.collection_stats(table(spark, sf, "embeddings"), _registry(spark), "label")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY ROLLUP (label)")
def stats_rollup(spark, sf):
    return ops.totals(table(spark, sf, "embeddings"), "label")


@query(f"SELECT label, collection FROM {_REGISTRY} WHERE label NOT IN (SELECT label FROM embeddings)")
def missing_required(spark, sf):
    return ops.missing(_registry(spark), table(spark, sf, "embeddings").select("label").distinct(), "label")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def list_wings(spark, sf):
    return drawers.counts(table(spark, sf, "documents"), "lang")


@query("SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY source")
def list_rooms(spark, sf):
    return drawers.counts(drawers.where_all(table(spark, sf, "documents"), lang="en"), "source")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def taxonomy(spark, sf):
    return drawers.counts(table(spark, sf, "documents"), "lang", "source")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 6")
def top_groups(spark, sf):
    return drawers.top_groups(table(spark, sf, "documents"), "source")


@query("SELECT count(*) AS drawers, count(DISTINCT lang) AS wings, count(DISTINCT source) AS rooms FROM documents")
def dashboard_summary(spark, sf):
    return drawers.dashboard(table(spark, sf, "documents"), "lang", "source")


#: Documents as drawers: rooms by source and length, so that they do not all span all wings.
_DRAWERS = "(SELECT 'd' || doc_id AS id, text AS document, lang AS wing, source || '-' || (n_chars % 59) AS room, '/f/' || source || '/' || (doc_id % 50) || '.md' AS source_file, (doc_id % 5)::INT AS chunk_index, CASE WHEN doc_id % 7 <> 0 THEN lpad((n_chars % 1000)::VARCHAR, 4, '0') END AS filed_at, CASE WHEN doc_id % 2 = 0 THEN 'even' END AS added_by, doc_id FROM documents)"


def _drawers(spark, sf):
    n = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("d"), n).alias("id"), F.col("text").alias("document"), F.col("lang").alias("wing"), F.concat("source", F.lit("-"), F.col("n_chars") % 59).alias("room"), F.concat(F.lit("/f/"), "source", F.lit("/"), n % 50, F.lit(".md")).alias("source_file"),
        (n % 5).cast("int").alias("chunk_index"), F.when(n % 7 != 0, F.lpad((F.col("n_chars") % 1000).cast("string"), 4, "0")).alias("filed_at"), F.when(n % 2 == 0, "even").alias("added_by"), "doc_id",
    )


_FLAT_DOCUMENT = _FLAT.replace("coalesce(text", "coalesce(document")
_SUMMARY = f"id, coalesce(wing, '') AS wing, coalesce(room, '') AS room, coalesce(source_file, '') AS source_file, split_part(coalesce(source_file, ''), '/', -1) AS source_name, chunk_index, filed_at, added_by, CASE WHEN length({_FLAT_DOCUMENT}) <= 220 THEN {_FLAT_DOCUMENT} ELSE rtrim(left({_FLAT_DOCUMENT}, 217), ' ') || '...' END AS preview"


@query(f"SELECT {_SUMMARY} FROM {_DRAWERS}")
def drawer_summaries(spark, sf):
    return drawers.summary(_drawers(spark, sf), "id", "document")


@query(f"SELECT 'en' AS wing, 'src1-3' AS room, 1 AS offset, 3 AS limit, (SELECT count(*) FROM {_DRAWERS} WHERE wing = 'en' AND room = 'src1-3') AS total, coalesce((SELECT string_agg(id || ' ' || source_name || ' ' || preview, '|' ORDER BY coalesce(filed_at, '') DESC, id) FROM (SELECT {_SUMMARY} FROM {_DRAWERS} WHERE wing = 'en' AND room = 'src1-3' ORDER BY coalesce(filed_at, '') DESC, id LIMIT 3 OFFSET 1)), '') AS items")
def browse_with_total(spark, sf):
    out = drawers.browse(_drawers(spark, sf), "en", "src1-3", 3, 1)
    return out.withColumn("items", F.array_join(F.transform("items", lambda r: F.concat_ws(" ", r["id"], r["source_name"], r["preview"])), "|"))


def _top(by: str) -> str:
    return f"(SELECT string_agg({by} || '=' || n, ',' ORDER BY n DESC, {by}) FROM (SELECT {by}, count(*) AS n FROM {_DRAWERS} GROUP BY {by} ORDER BY n DESC, {by} LIMIT 6))"


@query(f"SELECT (SELECT count(*) FROM documents) AS drawers, (SELECT count(DISTINCT wing) FROM {_DRAWERS}) AS wings, (SELECT count(DISTINCT room) FROM {_DRAWERS}) AS rooms, {_top('wing')} AS top_wings, {_top('room')} AS top_rooms, (SELECT string_agg(id, ',' ORDER BY coalesce(filed_at, '') DESC, id) FROM (SELECT * FROM {_DRAWERS} ORDER BY coalesce(filed_at, '') DESC, id LIMIT 6)) AS recent, (SELECT count(*) FROM (SELECT room FROM {_DRAWERS} GROUP BY room HAVING count(DISTINCT wing) >= 2)) AS tunnels")
def overview(spark, sf):
    out = drawers.overview(_drawers(spark, sf))
    named = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["name"], F.lit("="), r["count"])), ",").alias(c)
    return out.select("drawers", "wings", "rooms", named("top_wings"), named("top_rooms"), F.array_join(F.transform("recent_drawers", lambda r: r["id"]), ",").alias("recent"), F.col("graph.tunnel_rooms").alias("tunnels"))


@query(f"SELECT id, wing, room, source_file, split_part(source_file, '/', -1) AS source_name, similarity, md5(content) AS content FROM (SELECT d.id, wing, room, source_file, document AS content, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 3) AS similarity FROM {_DRAWERS} d JOIN embeddings ON vec_id = doc_id WHERE wing = 'fr') ORDER BY similarity DESC, id LIMIT 10")
def drawer_search(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = drawers.search(_drawers(spark, sf).join(vectors, "doc_id"), _vector(spark, sf), wing="fr")
    return found.select("id", "wing", "room", "source_file", "source_name", "similarity", F.md5("content").alias("content"))


@query(f"SELECT id, doc_id % 3 = 0 AS success, CASE WHEN doc_id % 3 <> 0 THEN 'duplicate' END AS reason FROM {_DRAWERS}")
def file_drawers(spark, sf):
    """Contents of which two in three are filed already; a third is new."""
    all_ = _drawers(spark, sf).withColumn("document", F.concat("document", F.lit(" "), "id"))
    filed, new = all_.where("doc_id % 3 <> 0"), all_.select("id", "document")
    return drawers.answers(filed, new, "id", "document")


_FILED = "(SELECT doc_id, lang, source, CASE WHEN doc_id % 7 <> 0 THEN lpad((n_chars % 1000)::VARCHAR, 4, '0') END AS filed_at FROM documents)"


def _filed(spark, sf):
    stamp = F.when(F.col("doc_id") % 7 != 0, F.lpad((F.col("n_chars") % 1000).cast("string"), 4, "0"))
    return table(spark, sf, "documents").select("doc_id", "lang", "source", stamp.alias("filed_at"))


@query(f"SELECT * FROM {_FILED} WHERE lang = 'en' AND source = 'src1' ORDER BY coalesce(filed_at, '') DESC, doc_id LIMIT 5 OFFSET 3")
def browse_page(spark, sf):
    return drawers.page(drawers.where_all(_filed(spark, sf), lang="en", source="src1"), "doc_id", 5, 3)


@query(f"SELECT * FROM {_FILED} ORDER BY coalesce(filed_at, '') DESC, doc_id LIMIT 6")
def recent_drawers(spark, sf):
    return drawers.page(_filed(spark, sf), "doc_id", 6)


@query("SELECT doc_id, source, doc_id = 21 AS is_current FROM documents WHERE source = (SELECT source FROM documents WHERE doc_id = 21)")
def siblings(spark, sf):
    return drawers.siblings(table(spark, sf, "documents"), "doc_id", 21, "source", "doc_id").select("doc_id", "source", "is_current")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'")
def where_and(spark, sf):
    return drawers.where_all(table(spark, sf, "documents"), lang="fr", source="src3", kind=None).select("doc_id")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.text = b.text)")
def check_duplicate(spark, sf):
    return drawers.add(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "text").select("item_id")


# --- diary, facts and tunnels ---------------------------------------------------------------------------------------


@query("SELECT event_type AS topic, content FROM (SELECT *, 'e' || event_id AS content FROM events WHERE user_id = 7) ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%S') DESC, event_type, content LIMIT 10")
def diary_last_n(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    diary = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("agent"), stamp.alias("timestamp"), F.col("event_type").alias("topic"), F.concat(F.lit("e"), "event_id").alias("content"))
    return drawers.read_diary(diary, "u7").select("topic", "content")


_FACTS = "(SELECT 'u' || user_id AS subject, event_type AS predicate, 'k' || json_extract_string(props, '$.k') AS object, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events)"
_AT = "TIMESTAMP '2024-01-05 00:00:00'"


def _facts(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("subject"), F.col("event_type").alias("predicate"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("object"), F.col("ts").alias("valid_from"), F.lead("ts").over(w).alias("valid_to"))


def _seconds(at):
    """Whole seconds nearest to a time, halves to the even one, as the SQL's cast of an epoch rounds."""
    return F.rint(F.unix_micros(at.cast("timestamp")) / 1_000_000)


def _middle(facts):
    return facts.agg(F.min("valid_from").alias("a"), F.max("valid_from").alias("b")).select(F.rint(_seconds(F.col("a")) / 2 + _seconds(F.col("b")) / 2).cast("bigint").alias("s"))


@query(f"SELECT subject, predicate, object FROM {_FACTS}, (SELECT make_timestamp(((epoch(min(ts))::BIGINT / 2 + epoch(max(ts))::BIGINT / 2)::BIGINT) * 1000000) AS t FROM events) WHERE valid_from <= t AND (valid_to IS NULL OR valid_to > t)")
def kg_asof(spark, sf):
    facts = _facts(spark, sf)
    kind = facts.schema["valid_from"].dataType
    timed = facts.join(F.broadcast(_middle(facts).select(F.timestamp_seconds("s").cast(kind).alias("t"))))
    return graph.as_of(timed, F.col("t")).select("subject", "predicate", "object")


@query(f"SELECT 'outgoing' AS direction, subject, predicate, object FROM {_FACTS} WHERE subject = 'u1' UNION ALL SELECT 'incoming', subject, predicate, object FROM {_FACTS} WHERE object = 'u1'")
def kg_direction_both(spark, sf):
    return graph.about(_facts(spark, sf), "u1").select("direction", "subject", "predicate", "object")


@query(f"SELECT subject, predicate, object, valid_to IS NULL AS current FROM {_FACTS} WHERE subject = 'u2' OR object = 'u2'")
def kg_timeline(spark, sf):
    return graph.timeline(_facts(spark, sf), "u2").select("subject", "predicate", "object", F.col("valid_to").isNull().alias("current"))


@query(f"SELECT (SELECT count(DISTINCT e) FROM (SELECT subject AS e FROM {_FACTS} UNION ALL SELECT object FROM {_FACTS})) AS entities, count(*) AS triples, count(*) FILTER (valid_to IS NULL) AS current_facts, count(*) FILTER (valid_to IS NOT NULL) AS expired_facts, (SELECT string_agg(event_type, ',' ORDER BY event_type) FROM (SELECT DISTINCT event_type FROM events)) AS relationship_types FROM {_FACTS}")
def kg_stats(spark, sf):
    return graph.fact_stats(_facts(spark, sf))


@query(f"SELECT subject, predicate, object, count(*) FILTER (valid_to IS NULL AND NOT (subject = 'u3' AND predicate = 'click')) AS current FROM {_FACTS} GROUP BY ALL")
def kg_invalidate(spark, sf):
    facts = _facts(spark, sf)
    gone = facts.where("subject = 'u3' and predicate = 'click'").select("subject", "predicate", "object", F.col("valid_from").alias("at"))
    return graph.invalidate_all(facts, gone).groupBy("subject", "predicate", "object").agg(F.count_if(F.col("valid_to").isNull()).alias("current"))


@query(f"SELECT room, string_agg(DISTINCT wing, ',' ORDER BY wing) AS wings, string_agg(DISTINCT coalesce(added_by, ''), ',' ORDER BY coalesce(added_by, '')) AS halls, count(*) AS count, max(filed_at) AS recent FROM {_DRAWERS} GROUP BY room HAVING count(DISTINCT wing) >= 2")
def tunnels(spark, sf):
    rows = _drawers(spark, sf).withColumn("hall", F.coalesce("added_by", F.lit("")))
    return graph.tunnels(rows, "wing", "room", "hall", "filed_at").select("room", F.array_join("wings", ",").alias("wings"), F.array_join("halls", ",").alias("halls"), "count", "recent")


@query(f"SELECT room FROM {_DRAWERS} WHERE wing = 'en' INTERSECT SELECT room FROM {_DRAWERS} WHERE wing = 'fr'")
def tunnels_between(spark, sf):
    return graph.tunnels_between(_drawers(spark, sf), "wing", "room", "en", "fr")


@query(f"SELECT count(*) AS total_rooms, count(*) FILTER (w >= 2) AS tunnel_rooms, sum(w * (w - 1) / 2)::BIGINT AS total_edges, (SELECT string_agg(wing || '=' || n, ',' ORDER BY wing) FROM (SELECT wing, count(DISTINCT room) AS n FROM {_DRAWERS} GROUP BY wing)) AS rooms_per_wing, (SELECT string_agg(room || ':' || wings || ':' || n, ' ' ORDER BY w DESC, n DESC, room) FROM (SELECT room, count(DISTINCT wing) AS w, count(*) AS n, string_agg(DISTINCT wing, ',' ORDER BY wing) AS wings FROM {_DRAWERS} GROUP BY room HAVING w >= 2 ORDER BY w DESC, n DESC, room LIMIT 10)) AS top_tunnels FROM (SELECT room, count(DISTINCT wing) AS w FROM {_DRAWERS} GROUP BY room)")
def graph_stats(spark, sf):
    out = graph.graph_stats(_drawers(spark, sf), "wing", "room")
    per_wing = F.array_join(F.transform(F.array_sort(F.map_entries("rooms_per_wing")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    top = F.array_join(F.transform("top_tunnels", lambda r: F.concat(r["room"], F.lit(":"), F.array_join(r["wings"], ","), F.lit(":"), r["count"])), " ")
    return out.select("total_rooms", "tunnel_rooms", "total_edges", per_wing.alias("rooms_per_wing"), F.nullif(top, F.lit("")).alias("top_tunnels"))


#: Wings finer than rooms, so that not all are reached at once.
_FINE = f"(SELECT DISTINCT room, wing || (doc_id % 11) AS wing FROM {_DRAWERS})"


@query(f"WITH RECURSIVE l AS {_FINE}, r AS (SELECT (SELECT min(room) FROM l) AS room, 0 AS hops UNION SELECT b.room, hops + 1 FROM r JOIN l a ON a.room = r.room JOIN l b ON b.wing = a.wing WHERE hops < 2) SELECT room, min(hops)::INT AS hops FROM r GROUP BY room")
def traverse(spark, sf):
    rows = _drawers(spark, sf).select("room", F.concat("wing", F.col("doc_id") % 11).alias("wing"))
    return graph.traverse(rows, "wing", "room", rows.agg(F.min("room")).first()[0], 2)


# --- incremental, health and sync -----------------------------------------------------------------------------------


_WORDS = " || ':' || ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR" for i in range(4))


@query(f"SELECT source, md5(count(*) || ':' || {_WORDS}) AS fingerprint FROM (SELECT lang AS source, md5(source || '/' || doc_id || ':' || n_chars) AS h FROM documents) GROUP BY source")
def fingerprint(spark, sf):
    d = table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return ops.fingerprint(d.select(F.col("lang").alias("source"), "path", "n_chars"), F.col("path"), F.col("n_chars"), "source")


@query("SELECT lang AS source FROM documents WHERE lang <> 'de' GROUP BY lang")
def changed_sources(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("source"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("changed"))
    state = ops.fingerprint(d.where("source = 'de'"), F.col("path"), F.col("changed"), "source")
    return ingest.changed(d, state).select("source")


@query("SELECT sum(CASE WHEN ok THEN weight ELSE 0 END)::DOUBLE AS score, sum(weight)::DOUBLE AS possible, min(ok::INT)::INT AS all_ok FROM (SELECT count(*) > 0 AS ok, 2.0 AS weight FROM documents UNION ALL SELECT count(*) > 0, 3.0 FROM conversations UNION ALL SELECT count(*) < 0, 5.0 FROM embeddings)")
def health_score(spark, sf):
    has = lambda t, ok, w: table(spark, sf, t).agg(F.count("*").alias("n")).select(ok(F.col("n")).alias("ok"), F.lit(w).alias("weight"))
    return ops.health_score(has("documents", lambda n: n > 0, 2.0).unionByName(has("conversations", lambda n: n > 0, 3.0)).unionByName(has("embeddings", lambda n: n < 0, 5.0)))


@query("SELECT event_id, block FROM (SELECT event_id, event_id // 10 AS block FROM events WHERE event_type = 'view') WHERE block NOT IN (SELECT event_id // 10 FROM events WHERE event_type = 'click')")
def unacked(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 10).alias("block"), "event_type")
    return ops.unacknowledged(e.where("event_type = 'view'").drop("event_type"), e.where("event_type = 'click'").select("block"), "block")


@query("SELECT 'conversations,documents,embeddings' AS layers, (SELECT count(*) FROM conversations) + (SELECT count(*) FROM documents) + (SELECT count(*) FROM embeddings) AS total, false AS ok")
def health_summary(spark, sf):
    names = ("documents", "conversations", "embeddings")
    one = lambda t: table(spark, sf, t).agg(F.lit(t).alias("layer"), (F.count("*") > 0).alias("available"), F.count("*").alias("total"), F.lit(f"/{t}").alias("path"))
    rows = one(names[0]).unionByName(one(names[1])).unionByName(one(names[2]))
    out = ops.health(rows, (*names, "absent"))
    return out.select(F.array_join(F.transform("layers", lambda r: r["layer"]), ",").alias("layers"), F.aggregate("layers", F.lit(0).cast("bigint"), lambda n, r: n + r["total"]).alias("total"), "ok")


@query("SELECT doc_id, ('L' || (doc_id % 5 + 1)) AS level FROM documents WHERE doc_id % 5 + 1 <= 3")
def access_filter(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("L"), (F.col("doc_id") % 5 + 1).cast("string")).alias("level"))
    return ops.visible(d, "L3")


@query("SELECT doc_id, 'L' || greatest(doc_id % 5 + 1, CASE WHEN doc_id % 6 < 5 THEN doc_id % 6 + 1 ELSE 0 END) AS level FROM documents")
def access_elevation(spark, sf):
    n = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("L"), (n % 5 + 1).cast("string")).alias("level"))
    return ops.elevate(d, F.concat(F.lit("L"), (n % 6 + 1).cast("string")))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOURS")
def session_48h(spark, sf):
    return ops.recent(table(spark, sf, "events"), "ts").select("event_id")


@query("WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_s, count(*) AS n FROM s GROUP BY user_id, s")
def event_sessions(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.sessions(e).select("user_id", F.unix_seconds("start").alias("start_s"), "n")


def _hashed(rows: str, dimensions: int) -> str:
    """id, dim, v of the hashed bag of words of rows (id, text)."""
    return f"(SELECT id, h % {dimensions} AS dim, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END) AS v FROM (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM (SELECT id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) AS w FROM {rows}) WHERE w <> '') GROUP BY ALL)"


@query(f"WITH h AS {_hashed('(SELECT doc_id AS id, text FROM documents)', 64)} SELECT doc_id, (SELECT string_agg(CASE WHEN coalesce(v, 0) > 0 THEN '+' WHEN coalesce(v, 0) < 0 THEN '-' ELSE '0' END, '' ORDER BY range) FROM range(64) LEFT JOIN h ON h.id = doc_id AND h.dim = range) AS signs, (SELECT count(*) > 0 FROM h WHERE h.id = doc_id AND v <> 0) AS filled FROM documents")
def hashed_embeddings(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", hashed_embedder(64)(F.col("text")).alias("v"))
    signs = F.array_join(F.transform("v", lambda e: F.when(e > 0, "+").when(e < 0, "-").otherwise("0")), "")
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return d.select("doc_id", signs.alias("signs"), (F.round(norm, 4) == 1).alias("filled"))


# --- parsers, over lines made from the turns ------------------------------------------------------------------------


def _jsonl(spark, sf, line):
    t = table(spark, sf, "conversations")
    rows = t.select("conv_id", F.struct("turn", line.alias("line")).alias("l")).groupBy("conv_id").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    return rows.select(F.concat(F.lit("/s/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), F.concat(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("\n\nnot json\n")).alias("value"))


_PARSED = f"SELECT '/s/' || conv_id || '.jsonl' AS path, user_text AS user_input, assistant_text AS ai_response FROM ({{p}})"


@query(_PARSED.format(p=_ALL))
def parse_claude(spark, sf):
    line = F.to_json(F.struct("role", F.col("text").alias("content")))
    return chats.parse_sessions(_jsonl(spark, sf, line)).select("path", "user_input", "ai_response")


@query(_PARSED.format(p=_PAIRS.format(t="(SELECT * FROM conversations WHERE role IN ('user', 'assistant'))").replace("text AS user_text", "text AS user_text")))
def parse_codex(spark, sf):
    content = F.array(F.struct(F.when(F.col("role") == "user", "input_text").otherwise("output_text").alias("type"), "text"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), "role", content.alias("content")).alias("payload")))
    return chats.parse_items(_jsonl(spark, sf, line)).select("path", "user_input", "ai_response")


@query("SELECT '/s/' || conv_id || '.jsonl' AS path, 'claude_jsonl' AS format FROM conversations GROUP BY conv_id")
def detect_format(spark, sf):
    return chats.detect_format(_jsonl(spark, sf, F.to_json(F.struct("role", F.col("text").alias("content")))))


# --- readers, tasks and the rest of the service ---------------------------------------------------------------------


def _messages(spark, sf, ask: str, answer: str):
    """Conversations as session JSON files."""
    t = table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", ask).when(F.col("role") == "assistant", answer).otherwise(F.col("role"))
    m = F.struct("turn", kind.alias("type"), F.col("text").alias("content"))
    rows = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("messages"))
    path = F.concat(F.lit("/s/chats/session-"), F.col("conv_id").cast("string"), F.lit(".json"))
    return rows.select(path.alias("path"), F.to_json(F.struct(F.col("conv_id").cast("string").alias("sessionId"), "messages")).alias("value"))


@query(f"SELECT conv_id::VARCHAR AS session_id, turn AS pos, user_text AS user_input, assistant_text AS ai_response FROM ({_ALL})")
def parse_gemini(spark, sf):
    return chats.parse_session_json(_messages(spark, sf, "user", "gemini")).select("session_id", F.col("pos").cast("long").alias("pos"), "user_input", "ai_response")


@query("SELECT conv_id::VARCHAR AS conversation_id, turn AS index, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, coalesce(text, '') AS content FROM conversations")
def reader_messages(spark, sf):
    return readers.message_turns(_messages(spark, sf, "user", "gemini")).select("conversation_id", "index", "role", "content")


def _export(spark, sf):
    """All conversations in one export a hundred; messages carry no order but their time."""
    t = table(spark, sf, "conversations")
    message = F.struct(F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), F.col("turn").cast("double").alias("create_time")).alias("message"))
    entry = F.struct(F.concat(F.lit("n"), F.format_string("%06d", 999999 - F.col("turn"))).alias("key"), message.alias("value"))
    rows = t.groupBy("conv_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1))).alias("mapping"))
    c = F.struct(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("t"), "conv_id").alias("title"), "mapping")
    return rows.groupBy(F.floor(F.col("conv_id") / 100).alias("b")).agg(F.to_json(F.collect_list(c)).alias("value")).select(F.concat(F.lit("/e/"), "b", F.lit(".json")).alias("path"), "value")


_FILLED = "(SELECT * FROM conversations WHERE " + _STRIP.format(c="text") + " <> '')"


@query("SELECT conv_id::VARCHAR AS conversation_id, 't' || conv_id AS title, user_text AS user_input, assistant_text AS ai_response FROM (" + _PAIRS.format(t=_FILLED) + ")")
def parse_openai(spark, sf):
    return chats.parse_export(_export(spark, sf)).select("conversation_id", "title", "user_input", "ai_response")


@query(f"SELECT path, turn * 2 + side AS index, role, content FROM (SELECT '/s/' || conv_id || '.jsonl' AS path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, user_text, assistant_text FROM ({_ALL}) WHERE {_STRIP.format(c='user_text')} <> '' AND {_STRIP.format(c='assistant_text')} <> ''), LATERAL (VALUES (0, 'user', user_text), (1, 'assistant', assistant_text)) v(side, role, content)")
def reader_file_turns(spark, sf):
    whole = _jsonl(spark, sf, F.to_json(F.struct("role", F.col("text").alias("content"))))
    return readers.file_turns(whole).select("path", "index", "role", "content")


@query(f"SELECT '/s/' || conv_id || '.jsonl' AS source_file, ('0x' || substr(md5({_STRIP.format(c="'/s/' || conv_id || '.jsonl'")} || chr(31) || chr(31) || chr(31) || {_STRIP.format(c='user_text')} || chr(31) || {_STRIP.format(c='assistant_text')}), 1, 15))::BIGINT AS id FROM ({_ALL}) WHERE length(assistant_text) >= 20")
def ingest_points(spark, sf):
    whole = _jsonl(spark, sf, F.to_json(F.struct("role", F.col("text").alias("content"))))
    return readers.points(whole, "claude_jsonl").select("source_file", "id")


def _notes(spark, sf):
    d = table(spark, sf, "documents").where("doc_id is not null")
    head = F.concat(F.lit("---\ntitle: 'N "), "doc_id", F.lit("'\ntags: a, ,"), F.col("lang"), F.lit("\nstatus:\n- no\n---\n"))
    return d.select(F.concat(F.lit("/v/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.concat(head, "text").alias("value"))


@query(f"SELECT '/v/' || source || '/' || doc_id || '.md' AS path, 'N ' || doc_id AS title, 'a,' || lang AS tags, source AS directory, md5({_STRIP.format(c='text')}) AS body FROM documents WHERE length({_STRIP.format(c='text')}) >= 20")
def parse_markdown(spark, sf):
    return chats.parse_notes(_notes(spark, sf)).select("path", "title", F.array_join("tags", ",").alias("tags"), "directory", F.md5("body").alias("body"))


def _tasks(spark, sf):
    """Events as tasks."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    state = F.element_at(F.array(*map(F.lit, (*tasks.STATES, "lost"))), (n % 8 + 1).cast("int"))
    priority = F.concat(F.lit("P"), (n % 5).cast("string"))
    return e.select(n.alias("task_id"), state.alias("status"), priority.alias("priority"), F.when(n % 3 != 0, F.concat(F.lit("a"), (n % 3).cast("string"))).alias("assignee"), (F.col("user_id") % 10).alias("project"), F.array(F.lit("made")).alias("log"))


_STATES = "[" + ", ".join(f"'{s}'" for s in (*tasks.STATES, "lost")) + "]"
_TASKS = f"(SELECT event_id AS task_id, {_STATES}[event_id % 8 + 1] AS status, 'P' || (event_id % 5) AS priority, CASE WHEN event_id % 3 <> 0 THEN 'a' || (event_id % 3) END AS assignee, user_id % 10 AS project FROM events)"


@query(f"SELECT task_id FROM {_TASKS} WHERE status = 'blocked' AND assignee = 'a1'")
def task_list(spark, sf):
    return tasks.listed(_tasks(spark, sf), status="blocked", assignee="a1", project=None).select("task_id")


@query(f"SELECT task_id, priority FROM {_TASKS} WHERE (assignee IS NULL OR assignee = 'a1') AND status IN ('inbox', 'ready') ORDER BY CASE WHEN priority < 'P4' THEN priority ELSE 'P9' END, task_id LIMIT 5")
def task_next(spark, sf):
    return tasks.next_for(_tasks(spark, sf), "a1", 5).select("task_id", "priority")


@query(f"SELECT task_id, CASE WHEN task_id % 2 = 0 THEN 'done' ELSE status END AS status, CASE WHEN task_id % 2 = 0 THEN 'made|2 a2 ' || status || '->done' ELSE 'made' END AS log FROM {_TASKS}")
def task_move(spark, sf):
    rows = _tasks(spark, sf)
    wanted = rows.where("task_id % 2 = 0").select("task_id", F.explode(F.array(F.struct(F.lit("ready").alias("status"), F.lit(1).alias("at")), F.struct(F.lit("done").alias("status"), F.lit(2).alias("at")), F.struct(F.lit("nonsense").alias("status"), F.lit(3).alias("at")))).alias("w")).select("task_id", "w.*", F.lit("a2").alias("by"))
    return tasks.move(rows, wanted).select("task_id", "status", F.array_join("log", "|").alias("log"))


@query(f"SELECT task_id, 'unknown status' AS problem FROM {_TASKS} WHERE status = 'lost' UNION ALL SELECT task_id, 'unknown priority' FROM {_TASKS} WHERE priority = 'P4' UNION ALL SELECT task_id, 'nobody on it' FROM {_TASKS} WHERE assignee IS NULL AND status = 'in_progress' UNION ALL SELECT task_id, 'orphan' FROM {_TASKS} WHERE project >= 9")
def task_doctor(spark, sf):
    return tasks.doctor(_tasks(spark, sf), spark.range(9).select(F.col("id").alias("project")))


@query(f"SELECT CASE WHEN grouping(assignee) = 0 THEN 'assignee' WHEN grouping(project) = 0 THEN 'project' ELSE 'all' END AS board, CASE WHEN grouping(assignee) = 0 THEN assignee WHEN grouping(project) = 0 THEN project::VARCHAR END AS key, count(*) FILTER (status NOT IN ('done', 'cancelled'))::BIGINT AS active, count(*) AS n FROM {_TASKS} GROUP BY GROUPING SETS ((assignee), (project), ())")
def dashboards(spark, sf):
    return tasks.boards(_tasks(spark, sf))


@query("SELECT event_id, ts AS stamp, 'n-' || (user_id % 5) AS node, event_type AS kind FROM (SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type FROM events)")
def file_names(spark, sf):
    e = table(spark, sf, "events")
    name = F.concat(F.lit("/q/"), F.date_format("ts", "yyyy-MM-dd-HHmmss"), F.lit("-n-"), (F.col("user_id") % 5).cast("string"), F.lit("-"), "event_type", F.lit(".md"))
    out = tasks.named(e.select("event_id", name.alias("path"), F.col("ts").alias("t")))
    return out.select("event_id", F.col("stamp").cast(e.schema["ts"].dataType).alias("stamp"), "node", "kind")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)")
def delete_drawers(spark, sf):
    gone = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))
    return drawers.delete(table(spark, sf, "documents").select("doc_id", "source"), gone, "doc_id").select("doc_id")


@query(f"SELECT vec_id, round(0.7 * s + 0.3 * w, 4) AS score FROM (SELECT e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s, len(list_intersect(regexp_split_to_array(lower(coalesce(d.text, '')), '[^a-zA-Z0-9_]+'), ['and', 'the'])) / 2.0 AS w FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id) ORDER BY score DESC, vec_id LIMIT 10")
def hybrid_topk(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding").join(docs, "vec_id")
    return search.hybrid(rows, _vector(spark, sf), ["the", "and"], 10).select("vec_id", "score")


@query("SELECT page_id, length(trim(coalesce(url, ''))) > 0 AND (starts_with(url, 'PASTE_') OR regexp_matches(url, '\\s') OR contains(url, 'blog')) AS bad FROM pages")
def unusable_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", x.unusable_key(F.col("url"), ("blog",)).alias("bad"))


# --- files, stores and what is shown of them ------------------------------------------------------------------------


_folder = scratch.folder


@query(f"SELECT 'c ' || conv_id || '+%é' AS talk, 'claude_jsonl' AS format, user_text AS user_input, assistant_text AS ai_response, true AS there FROM ({_ALL})")
def read_session_files(spark, sf):
    """Sessions written as files, in folders whose names hold spaces, signs and accents, found and read again."""
    folder = _folder(spark)
    lined = _jsonl(spark, sf, F.to_json(F.struct("role", F.col("text").alias("content"))))
    name = F.concat(F.lit("talk=c "), F.regexp_extract("path", r"(\d+)\.jsonl$", 1), F.lit("+%25é/session.jsonl"))
    archive.register(spark)
    lined.select(name.alias("path"), "value").write.format("chat_archive").mode("append").save(folder)
    whole = scratch.stage(chats.scan(spark, [f"{folder}/absent", folder], "*.jsonl", depth=1))  # a file is opened once
    own = F.url_decode(F.regexp_replace(F.regexp_extract("path", r"talk=([^/]+)/", 1), r"\+", "%2B"))
    told = chats.detect_format(whole).join(chats.parse_sessions(whole), "path")
    some = whole.agg(F.min("path")).first()[0]
    return told.select(own.alias("talk"), "format", "user_input", "ai_response", F.lit(store.exists(spark, some)).alias("there"))


_EMBEDDED = f"SELECT {_sql_id("'conversations'", 'conv_id::VARCHAR', "''", 'user_text', 'assistant_text')} AS id, user_text, assistant_text, 'User: ' || user_text || chr(10) || 'Assistant: ' || left(assistant_text, 2000) AS text FROM ({_ALL}) WHERE length(assistant_text) >= 20"
_LIKE = "(SELECT h.id, sum(h.v * coalesce(q.v, 0)) / (sqrt(sum(h.v * h.v)) * (SELECT sqrt(sum(v * v)) FROM q)) AS cosine FROM h LEFT JOIN q USING (dim) GROUP BY h.id)"


def _points(spark, sf):
    pairs = turns.long_enough(_pairs(spark, sf))
    body = x.embed_text(F.col("user_text"), F.col("assistant_text"))
    return pairs.select(x.memory_id(F.lit("conversations"), F.col("conv_id"), F.col("user_text"), F.col("assistant_text")).alias("id"), "user_text", "assistant_text", body.alias("full_text"))


@query(f"WITH p AS ({_EMBEDDED}), h AS (SELECT DISTINCT * FROM {_hashed('p', 384)}), q AS (SELECT dim, v FROM h WHERE id = (SELECT min(id) FROM p)) SELECT id::VARCHAR AS point_id, round(cosine, 4) AS score, left(user_text, 500) AS user_input, left(assistant_text, 1000) AS ai_response, 'conversations' AS source_file, 'conversations' AS source_label, true AS has_full_context FROM p JOIN {_LIKE} USING (id) ORDER BY score DESC, id LIMIT 5")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Turns -> pairs -> ids and vectors -> the pairs most like the first one."""
    points = _points(spark, sf).select(F.col("id").alias("vec_id"), "user_text", "assistant_text", F.lit("conversations").alias("source"), hashed_embedder()(F.col("full_text")).alias("embedding"))
    question = points.orderBy("vec_id").select("embedding").first()[0]
    return search.project(search.top_k(points, question, 5), F.col("vec_id"), F.col("user_text"), F.col("assistant_text"), F.col("source"))


@query(f"WITH p AS ({_EMBEDDED}), h AS {_hashed('p', 384)}, q AS (SELECT dim, v FROM {_hashed("(SELECT 0 AS id, 'plan the trip to the coast' AS text)", 384)}) SELECT id::VARCHAR AS point_id, round(cosine, 4) AS score, left(user_text, 500) AS user_input, 'ann' AS persona, (SELECT count(DISTINCT id) FROM p) AS stored, (SELECT count(*) FROM p) AS seen FROM (SELECT DISTINCT id, user_text FROM p) JOIN {_LIKE} USING (id) ORDER BY score DESC, id LIMIT 5")
def memory_summon(spark, sf):
    """Pairs kept in a store in three upserts, the last of which repeats the first, and summoned by a persona."""
    rows = _points(spark, sf).select("id", F.col("user_text").alias("user_input"), F.col("assistant_text").alias("ai_response"), hashed_embedder()(F.col("full_text")).alias("embedding"), F.lit(0).alias("batch"), F.lit("conversations").alias("source_file"), *(F.lit(None).cast("string").alias(c) for c in ("conversation_id", "title", "vault", "era", "timestamp", "created", "updated")))
    memories = Memories(spark, _folder(spark), [Persona("ann", "Ann"), Persona("bob", "Bob")])
    odd = F.pmod("id", F.lit(2)) == 1
    seen = [store.upsert(memories.table, rows.where(part), "ann") for part in (odd, ~odd, odd)]
    stored = memories.points("ann").count()
    return memories.summon("plan the trip to the coast", "Ann").select("point_id", "score", "user_input", F.lit("ann").alias("persona"), F.lit(stored).cast("bigint").alias("stored"), F.lit(seen[0] + seen[1]).cast("bigint").alias("seen"))


@query(f"SELECT {_STRIP.format(c='user_text')} AS user_content, {_STRIP.format(c='assistant_text')} AS assistant_content, conv_id FROM ({_ALL})")
def export_jsonl(spark, sf):
    """Training rows written as JSON lines and read again; either side under any of its names."""
    n = F.col("turn") % 3
    named = _pairs(spark, sf).select("conv_id", F.when(n == 0, F.col("user_text")).otherwise("").alias("user_input"), F.when(n != 0, F.col("user_text")).alias("user"), F.when(n == 1, F.col("assistant_text")).alias("assistant"), F.when(n == 2, F.col("assistant_text")).alias("ai_response"), F.when(n == 0, F.col("assistant_text")).alias("ai"))
    path = _folder(spark)
    store.export_jsonl(ops.training_rows(named, *ops.sides(named), {"conv_id": F.col("conv_id")}, ()), path)
    back = spark.read.schema("messages array<struct<role:string,content:string>>, meta struct<conv_id:bigint>").json(path)
    return back.select(F.col("messages")[0]["content"].alias("user_content"), F.col("messages")[1]["content"].alias("assistant_content"), "meta.conv_id")


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id::VARCHAR ELSE 'p-' || page_id END AS id, CASE WHEN page_id % 3 = 0 THEN 'BIGINT' ELSE 'STRING' END AS kind FROM pages")
def coerce_ids(spark, sf):
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("00"), "page_id")).otherwise(F.concat(F.lit("p-"), "page_id"))
    id_ = x.coerce_id(given)
    return table(spark, sf, "pages").select("page_id", F.try_variant_get(id_, "$", "string").alias("id"), F.schema_of_variant(id_).alias("kind"))


@query("SELECT page_id, 'example.net' AS given, 'other' AS wrong, CASE WHEN contains(replace(lower(url), '_', '-'), 'blog') THEN 'blog' WHEN contains(replace(lower(url), '_', '-'), 'example.net') THEN 'example.net' ELSE 'other' END AS none FROM pages")
def era_override(spark, sf):
    era = lambda given: x.configured_label(given, F.col("url"), ("blog", "example.net"), "other")
    return table(spark, sf, "pages").select("page_id", era(" Example.NET ").alias("given"), era("nonsense").alias("wrong"), era(None).alias("none"))


@query("SELECT event_id, format('{:.1f}', round(value % 1 * 1000) / 10) || '%' AS share, format('{:,}', event_id * 1000) AS many, strftime(ts, '%Y-%m-%d') AS day, left('event-' || lpad(event_id::VARCHAR, 20, '0'), 18) AS short FROM events")
def display(spark, sf):
    e = table(spark, sf, "events")
    share = F.round(F.col("value") % 1 * 1000) / 1000
    long_id = F.concat(F.lit("event-"), F.lpad(F.col("event_id").cast("string"), 20, "0"))
    return e.select("event_id", x.percent(share).alias("share"), x.grouped(F.col("event_id") * 1000).alias("many"), x.day(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("day"), x.short_id(long_id).alias("short"))


@query("SELECT '/v/' || source || '/' || doc_id || '.md' AS path, CASE WHEN contains('/v/' || source || '/', 'src1') THEN 'src1' WHEN contains('/v/' || source || '/', 'src') AND source = 'src2' THEN 'src2' ELSE 'unknown' END AS vault, 'note' AS type, '2026-01-0' || (doc_id % 9 + 1) AS updated, '2026-01-0' || (doc_id % 9 + 1) AS shown FROM documents WHERE length(" + _STRIP.format(c="text") + ") >= 20")
def note_fields(spark, sf):
    d = table(spark, sf, "documents").where("doc_id is not null")
    head = F.concat(F.lit("---\ntype: note\nupdated: 2026-01-0"), F.col("doc_id") % 9 + 1, F.lit("\n---\n"))
    notes = d.select(F.concat(F.lit("/v/"), "source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.concat(head, "text").alias("value"))
    out = chats.parse_notes(notes, ("src1", "src2"))
    return out.select("path", "vault", "type", "updated", x.first_filled(F.col("created"), F.col("updated")).alias("shown"))


@query("SELECT page_id, 'src' || (page_id % 3) AS label, page_id % 3 < 2 AS known FROM pages")
def persona_lookup(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.concat(F.lit("src"), F.col("page_id") % 3).alias("label"))
    told = with_persona(rows, "label", [Persona("src0", "Zero"), Persona("Src1", "One")])
    return told.select("page_id", "label", F.col("persona_title").isNotNull().alias("known"))


@query("SELECT url AS path, CASE WHEN page_id % 2 = 0 THEN url WHEN page_id % 4 = 1 THEN '/moved/' || split_part(url, '/', -1) || page_id END AS found FROM pages")
def resolve_paths(spark, sf):
    """Files that are where they were, files that moved and are found by name, and files that are gone."""
    pages = table(spark, sf, "pages")
    name = F.substring_index("url", "/", -1)
    # what moved and what is gone was in folders of its own, and no file has a name like that of a gone one: urls end in numbers too
    moved, gone = F.concat(F.lit("/was/"), "url", "page_id"), F.concat(F.lit("/gone/"), "url", "page_id", F.lit(".gone"))
    wanted = pages.select(F.when(F.col("page_id") % 2 == 0, F.col("url")).when(F.col("page_id") % 4 == 1, moved).otherwise(gone).alias("path"), "url")
    # the folder that files move to is the first root, so a name is that of a moved file before it is another url's
    known = pages.where("page_id % 4 = 1").select(F.lit(0).alias("root"), F.concat(F.lit("/moved/"), name, "page_id").alias("path")).unionByName(pages.where("page_id % 2 = 0").select(F.lit(1).alias("root"), F.col("url").alias("path")))
    return wanted.join(chats.resolve(wanted.select("path").distinct(), known), "path", "left").select(F.col("url").alias("path"), "found")


from turnstone.plans import live, retrieval, surface, temporal  # noqa: E402, F401  they add their queries to those above
