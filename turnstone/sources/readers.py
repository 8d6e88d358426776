"""Files of any known format as turns, and as points ready for a collection.

Turns all have one schema: path, index, role, content, conversation_id, title, time. A format is recognised once for each
file and its parser sees only files of that format. To add a format, add its parser to TURNS and to PAIRS."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions import text as x
from turnstone.functions.vectors import Embedder, hashed_embedder
from turnstone.sources import chats

_OPTIONAL = {"conversation_id": "string", "title": "string", "time": "double"}


def _turns(rows: DataFrame) -> DataFrame:
    have = rows.columns
    extra = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _OPTIONAL.items()]
    return rows.select("path", F.col("index").cast("long").alias("index"), "role", "content", *extra)


def reader_role(kind: Column) -> Column:
    """Whoever is not the user is the assistant."""
    return F.when(kind == "user", "user").otherwise("assistant")


def from_pairs(pairs: DataFrame, order: str) -> DataFrame:
    """Two turns a pair, numbered through each file; pairs with a blank side do not count."""
    filled = pairs.where((x.strip(F.col("user_input")) != "") & (x.strip(F.col("ai_response")) != ""))
    at = (F.row_number().over(Window.partitionBy("path").orderBy(order)) - 1) * 2
    side = lambda n, role, c: F.struct((F.col("at_") + n).alias("index"), F.lit(role).alias("role"), F.col(c).alias("content"))
    both = F.array(side(0, "user", "user_input"), side(1, "assistant", "ai_response"))
    return _turns(filled.withColumn("at_", at).select("path", F.inline(both)))


_THOUGHTS = "array<struct<subject:string,description:string>>"
_SESSION = f"struct<sessionId:string,messages:array<struct<type:string,role:string,content:string,thoughts:{_THOUGHTS}>>>"


def message_turns(whole: DataFrame) -> DataFrame:
    """Every message of a session JSON, its thoughts at its end; whoever is not the user is the assistant."""
    rows = whole.select("path", F.from_json("value", _SESSION).alias("j"))
    rows = rows.select("path", F.col("j.sessionId").alias("conversation_id"), F.posexplode("j.messages").alias("index", "m"))
    said = F.array_join(F.transform("m.thoughts", lambda t: F.coalesce(t["description"], t["subject"], F.lit(""))), " | ")
    body = F.coalesce("m.content", F.lit(""))
    thinking = F.when(F.coalesce(said, F.lit("")) != "", F.concat(F.lit("\n[Thinking: "), said, F.lit("]"))).otherwise("")
    role = reader_role(F.coalesce("m.type", "m.role"))
    return _turns(rows.select("path", "conversation_id", "index", role.alias("role"), F.concat(body, thinking).alias("content")))


def note_turn(whole: DataFrame) -> DataFrame:
    return _turns(whole.select("path", F.lit(0).alias("index"), F.lit("document").alias("role"), F.col("value").alias("content")))


def export_turns(whole: DataFrame) -> DataFrame:
    rows = chats.export_turns(whole)
    return _turns(rows.withColumnsRenamed({"id": "conversation_id", "text": "content"}))


TURNS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "claude_jsonl": lambda whole: from_pairs(chats.parse_sessions(whole), "at"),
    "codex_jsonl": lambda whole: from_pairs(chats.parse_items(whole), "pos"),
    "gemini_json": message_turns,
    "markdown": note_turn,
    "openai_json": export_turns,
}


def file_turns(whole: DataFrame, formats: Sequence[str] = tuple(TURNS)) -> DataFrame:
    """Turns of all files of the given formats; others have none."""
    known = chats.with_format(whole)
    parts = [TURNS[f](known.where(F.col("format") == f)) for f in formats]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parse_roles(whole: DataFrame, asks: Sequence[str] = ("human", "user"), answers: Sequence[str] = ("assistant", "model")) -> DataFrame:
    """JSONL whose objects carry a type or else a role: adjacent asking and answering ones, both with text."""
    rows = chats.lines(whole)
    role = x.first_filled(F.try_variant_get("v", "$.type", "string"), F.try_variant_get("v", "$.role", "string"))
    body = F.coalesce(chats._content("v", "$.content", None), chats._content("v", "$.message.content", None))
    w = Window.partitionBy("path").orderBy("pos")
    rows = rows.select("path", "pos", role.alias("role"), body.alias("user_input"))
    rows = rows.withColumn("n", F.lead("role").over(w)).withColumn("ai_response", F.lead("user_input").over(w))
    rows = rows.where(F.col("role").isin(*asks) & F.col("n").isin(*answers)).drop("role", "n")
    return rows.where("user_input <> '' and ai_response <> ''")


def note_pairs(whole: DataFrame, vaults: Sequence[str] = ()) -> DataFrame:
    """A note as a pair: its title asks, its body answers."""
    return chats.parse_notes(whole, vaults).withColumnsRenamed({"body": "ai_response"}).withColumn("user_input", F.col("title"))


PAIRS: dict[str, tuple[Callable[[DataFrame], DataFrame], str | None]] = {
    "claude_jsonl": (chats.parse_sessions, "at"),
    "codex_jsonl": (chats.parse_items, "pos"),
    "gemini_json": (chats.parse_session_json, "pos"),
    "openai_json": (chats.parse_export, "index"),
    "markdown": (note_pairs, None),
}
#: Formats whose answers have a least length, and whose answers are embedded whole.
_SHORT_ALLOWED, _WHOLE_ANSWER = {"openai_json"}, {"openai_json"}
_PAYLOAD = ("conversation_id", "session_id", "title", "thinking", "timestamp", "status", "type", "created", "updated", "vault", "directory")


def points(whole: DataFrame, format_: str, name: str = "Assistant", embedder: Embedder | None = None, eras: Sequence[str] = (), default_era: str = "unknown", era: str | None = None, vaults: Sequence[str] = (), questions_alone: bool = False) -> DataFrame:
    """Files of one format as points: id, embedding, the text embedded, and one payload for all formats (null where a
    format lacks a field). batch is the order within a file, for the store's upsert. An era that is given counts before the
    path; questions_alone embeds the question of a pair and not its answer, and sets no least length."""
    parse, order = PAIRS[format_]
    rows = parse(whole) if format_ != "markdown" else note_pairs(whole, vaults)
    if format_ not in _SHORT_ALLOWED and not questions_alone:
        rows = rows.where(F.length("ai_response") >= x.MIN_RESPONSE_CHARS)
    have = set(rows.columns)
    payload = [(F.col(c) if c in have else F.lit(None)).cast("string").alias(c) for c in _PAYLOAD]
    user, answer = F.col("user_input"), F.col("ai_response")
    if format_ == "markdown":
        text = F.concat(F.col("title"), F.lit("\n\n"), F.substring(answer, 1, x.RESPONSE_CHARS))
        id_ = x.document_id(F.col("path"), F.col("title"), answer)
    else:
        text = x.embed_text(user, answer, name, F.col("thinking") if "thinking" in have else None, None if format_ in _WHOLE_ANSWER else x.RESPONSE_CHARS)
        id_ = x.memory_id(F.col("path"), F.col("conversation_id") if "conversation_id" in have else F.lit(""), user, answer)
    if questions_alone:
        text = user
    tags = (F.col("tags") if "tags" in have else F.lit(None)).cast("array<string>").alias("tags")
    batch = (F.col(order) if order else F.lit(0)).cast("long").alias("batch")
    rows = rows.select(id_.alias("id"), batch, user, answer, F.col("path").alias("source_file"), *payload, tags, x.configured_label(era, F.col("path"), eras, default_era).alias("era"), text.alias("full_text"))
    return rows.withColumn("embedding", (embedder or hashed_embedder())(F.col("full_text")))


def points_of_all(whole: DataFrame, **options: object) -> DataFrame:
    """Points of all files, whatever their format."""
    known = chats.with_format(whole)
    parts = [points(known.where(F.col("format") == f), f, **options) for f in PAIRS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def settings(whole: DataFrame, *keys: str) -> DataFrame:
    """path, key, value of dotenv files: comments and blank lines skipped, cut at the first =, quotes taken off; of a key
    that stands twice the last counts."""
    rows = whole.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    rows = rows.withColumn("line", x.strip(F.col("line"))).where((F.col("line") != "") & ~F.col("line").startswith("#") & F.col("line").contains("="))
    value = F.regexp_replace(x.strip(F.regexp_replace("line", "^[^=]*=", "")), "^[\"']+|[\"']+$", "")
    rows = rows.select("path", "pos", x.strip(F.substring_index("line", "=", 1)).alias("key"), value.alias("value"))
    rows = rows.where(F.col("key").isin(*keys)) if keys else rows
    return rows.groupBy("path", "key").agg(F.max_by("value", "pos").alias("value"))


def locate(spark: SparkSession, path: str, roots: Sequence[str] = ()) -> str | None:
    """The path itself if it is there, or else the first file of its name under the roots, in their order."""
    from turnstone.sources.store import exists, literal

    if exists(spark, path):
        return path
    name = path.rsplit("/", 1)[-1]
    for root in roots:
        if name and exists(spark, root):
            listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", literal(name)).load(literal(root))
            if found := listed.agg(F.min("path")).first()[0]:  # only names are read
                return found.removeprefix("file://").removeprefix("file:")
    return None


def context_of(whole: DataFrame, needle: str, k: int) -> DataFrame:
    """One row for each file: its format, the turn most like the needle, and the turns around it; errors as a column."""
    from turnstone.operators import turns

    known = chats.with_format(whole)
    rows = file_turns(whole)
    centers = turns.match_fuzzy(rows, "path", "index", needle.strip(), "content").select("path", F.col("matched").alias("center"))
    found = turns.full_context(rows, centers, "path", "index", k, content="content").drop("error")
    error = F.when(F.col("format") == "unknown", "unsupported_format").when(F.col("total_turns").isNull(), "no_turns_found")
    return known.select("path", "format").join(found, "path", "left").withColumn("error", error)


def conversation_context(whole: DataFrame, conversation: str, needle: str, k: int) -> DataFrame:
    """The same for one conversation of an export."""
    from turnstone.operators import turns

    rows = export_turns(whole).where(F.col("conversation_id") == conversation)
    centers = turns.match_fuzzy(rows, "conversation_id", "index", needle.strip(), "content").select("conversation_id", F.col("matched").alias("center"))
    return turns.full_context(rows, centers, "conversation_id", "index", k, content="content").drop("error")
