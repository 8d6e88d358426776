"""Chat logs and notes as DataFrames: whole files in, messages or pairs out, malformed lines and files skipped.

Files are read whole, one row a file, because line order matters; lines and messages are exploded at once, so a file's
size bounds a task, not the archive's. JSON is VARIANT where shapes vary and a MAP where key order counts."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions import text as x

HEAD_CHARS = 200
#: Tasks a core that list folders.
LISTERS = 4


@contextlib.contextmanager
def _listed_by(spark: SparkSession, tasks: int) -> Iterator[None]:
    """Many folders are listed by so many tasks at most; Spark's own bound, one a folder up to 10,000, costs more than they do."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), tasks))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def plain_path(uri: Column) -> Column:
    """A file's URI as its path; a plus sign stands for itself there."""
    return F.regexp_replace(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))), "^file:(//)?(?=/)", "")


def scan(spark: SparkSession, roots: Sequence[str], glob: str, under: str | None = None, depth: int | None = None, **options: object) -> DataFrame:
    """files of all roots that exist, with the place of the root (the first is 0): of folders named under alone, and exactly
    depth folders below the root, where given. Sessions of the model's command line are scan(roots, "session-*.json",
    under="chats", depth=2), those of the package reader scan(roots, "*.json", under="chats")."""
    from turnstone.sources.store import exists

    parts = []
    for i, root in enumerate(roots):
        if exists(spark, root):
            found = files(spark, root, glob, **options).withColumn("root", F.lit(i))
            own = re.sub("^file:(//)?(?=/)", "", root).rstrip("/")
            below = F.split(F.expr(f"substring(path, {len(own) + 2})"), "/")
            if under is not None:
                found = found.where(F.try_element_at(F.split("path", "/"), F.lit(-2)) == under)
            parts.append(found if depth is None else found.where(F.size(below) == depth + 1))
    if not parts:
        return spark.createDataFrame([], "path string, value string, bytes long, changed timestamp, root int")
    return reduce(lambda a, b: a.unionByName(b), parts)


def first_existing(spark: SparkSession, given: str | None, *candidates: str) -> str:
    """What is configured, else the first candidate that exists, else the first. Candidates count once, in order."""
    from turnstone.sources.store import exists

    if given:
        return given
    ordered = list(dict.fromkeys(candidates))
    return next((c for c in ordered if exists(spark, c)), ordered[0])


def files(spark: SparkSession, folder: str, glob: str, recursive: bool = True, least_bytes: int = 0, hidden: bool = True) -> DataFrame:
    """path, value (the whole file), bytes, changed. A path is what other readers open: not encoded, and of the local file
    system without its scheme."""
    with _listed_by(spark, LISTERS * spark.sparkContext.defaultParallelism):
        df = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(folder, wholetext=True)
    df = df.select(plain_path(F.col("_metadata.file_path")).alias("path"), "value", F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_modification_time").alias("changed"))
    df = df.where(F.col("bytes") >= least_bytes)
    return df if hidden else df.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")))


def lines(whole: DataFrame) -> DataFrame:
    """path, pos, v: every line that is JSON, in order."""
    rows = whole.select("path", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    return rows.where(F.trim("line") != "").select("path", "pos", F.try_parse_json("line").alias("v")).where("v is not null")


def _s(v: str, path: str) -> Column:
    return F.try_variant_get(F.col(v), path, "string")


def _content(v: str, path: str, kinds: tuple[str, ...] | None = ("text",), glue: str = " ") -> Column:
    """Text at path: a string, or the texts of its blocks of the given kinds."""
    items = F.try_variant_get(F.col(v), path, "array<variant>")
    field = lambda b, name: F.try_variant_get(b, f"$.{name}", "string")
    # without kinds a list's plain strings count too
    plain = lambda b: F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string"))
    said = lambda b: F.when(field(b, "type").isin(*kinds), field(b, "text")) if kinds else F.coalesce(plain(b), field(b, "text"))
    keep = F.filter(F.transform(items, said), lambda t: F.coalesce(t, F.lit("")) != "")
    is_list = F.schema_of_variant(F.try_variant_get(F.col(v), path, "variant")).startswith("ARRAY")
    return F.when(is_list, F.array_join(keep, glue)).otherwise(_s(v, path))


def parse_sessions(whole: DataFrame) -> DataFrame:
    """JSONL sessions of four shapes: each object next to its successor, the first shape that both have wins."""
    rows = lines(whole)
    w = Window.partitionBy("path").orderBy("pos")
    rows = rows.withColumn("n", F.lead("v").over(w)).withColumn("at", F.row_number().over(w) - 1)
    plain = lambda kind, ask, answer, field: F.when((_s("v", f"$.{kind}") == ask) & _s("n", f"$.{kind}").isin(*answer) & _content("v", f"$.{field}").isNotNull(), F.struct(_content("v", f"$.{field}").alias("u"), _content("n", f"$.{field}").alias("a")))
    shapes = F.coalesce(
        plain("type", "human", ("assistant",), "content"),
        plain("role", "user", ("assistant",), "content"),
        plain("sender", "human", ("claude", "assistant"), "message"),
        plain("sender", "human", ("claude", "assistant"), "content"),
        plain("type", "user", ("assistant",), "message.content"),
    )
    rows = rows.select("path", "at", shapes.alias("p"))
    return rows.select("path", "at", F.col("p.u").alias("user_input"), F.col("p.a").alias("ai_response")).where("user_input <> '' and ai_response <> ''")


def parse_items(whole: DataFrame) -> DataFrame:
    """JSONL of response items: messages of user and assistant, blank ones dropped before pairing."""
    rows = lines(whole)
    item = _s("v", "$.type") == "response_item"
    role = F.when(item, F.when(_s("v", "$.payload.type") == "message", _s("v", "$.payload.role"))).otherwise(x.first_filled(_s("v", "$.role"), _s("v", "$.type")))
    body = F.when(item, _content("v", "$.payload.content", ("input_text", "output_text"), "\n")).otherwise(F.coalesce(_content("v", "$.content"), _content("v", "$.message")))
    stripped = F.array_join(F.filter(F.transform(F.split(body, "\n"), x.strip), lambda t: t != ""), "\n")
    turns = rows.select("path", "pos", role.alias("role"), stripped.alias("text")).where("role in ('user', 'assistant') and text <> ''")
    w = Window.partitionBy("path").orderBy("pos")
    turns = turns.withColumn("n", F.lead("role").over(w)).withColumn("ai_response", F.lead("text").over(w))
    return turns.where("role = 'user' and n = 'assistant'").select("path", "pos", F.col("text").alias("user_input"), "ai_response")


_MESSAGES = "struct<sessionId:string,messages:array<struct<type:string,content:string,timestamp:string,thoughts:array<struct<subject:string,description:string>>>>>"


def parse_session_json(whole: DataFrame) -> DataFrame:
    """Session JSON: adjacent user and model messages, thoughts flattened, the file's stem where no session id is given."""
    rows = whole.withColumn("j", F.from_json("value", _MESSAGES)).where("j.messages is not null")
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    turns = rows.select("path", x.first_filled(F.col("j.sessionId"), stem).alias("session_id"), F.posexplode("j.messages").alias("pos", "m"))
    w = Window.partitionBy("path").orderBy("pos")
    turns = turns.withColumn("n", F.lead("m").over(w)).where("m.type = 'user' and n.type = 'gemini' and m.content <> '' and n.content <> ''")
    thought = lambda t: F.concat(F.coalesce(t["subject"], F.lit("")), F.lit(": "), F.coalesce(t["description"], F.lit("")))
    return turns.select("path", "session_id", "pos", F.col("m.content").alias("user_input"), F.col("n.content").alias("ai_response"), F.coalesce(F.array_join(F.transform("n.thoughts", thought), " | "), F.lit("")).alias("thinking"), F.col("m.timestamp").alias("timestamp"))


_EXPORT = "array<struct<id:string,title:string,create_time:double,mapping:map<string,struct<message:struct<author:struct<role:string>,content:struct<parts:array<variant>>,create_time:double>>>>>"


def export_turns(whole: DataFrame) -> DataFrame:
    """Export arrays: messages of each conversation with text, by time (null first), ties in the order of the file."""
    talks = whole.select("path", F.posexplode(F.from_json("value", _EXPORT)).alias("place", "c"))
    # of conversations of one id the last counts; those without an id are each their own
    talks = talks.withColumn("talk", F.coalesce(x.first_filled(F.col("c.id")), F.concat(F.lit("\x1f"), F.col("place").cast("string"))))
    last = F.row_number().over(Window.partitionBy("path", "talk").orderBy(F.desc("place")))
    talks = talks.withColumn("last", last).where("last = 1")
    rows = talks.select("path", "c.id", "c.title", F.posexplode(F.map_entries("c.mapping")).alias("pos", "e"), "talk")
    # a part is text only if it is a string itself
    strings = F.filter(F.col("e.value.message.content.parts"), lambda p: F.schema_of_variant(p) == "STRING")
    body = F.array_join(F.transform(strings, lambda p: F.try_variant_get(p, "$", "string")), "")
    turns = rows.select("path", "id", "title", "pos", F.col("e.value.message.author.role").alias("role"), body.alias("text"), F.coalesce("e.value.message.create_time", F.lit(0.0)).alias("time"), "talk").where(x.strip(F.col("text")) != "")
    w = Window.partitionBy("path", "talk").orderBy("time", "pos")
    return turns.withColumn("index", F.row_number().over(w) - 1).drop("pos")


def parse_export(whole: DataFrame) -> DataFrame:
    turns = export_turns(whole)
    w = Window.partitionBy("path", "talk").orderBy("index")
    turns = turns.withColumn("n", F.lead("role").over(w)).withColumn("ai_response", F.lead("text").over(w))
    return turns.where("role = 'user' and n = 'assistant'").select("path", F.col("id").alias("conversation_id"), "title", "index", F.col("text").alias("user_input"), "ai_response")


def parse_notes(whole: DataFrame, vaults: Sequence[str] = ()) -> DataFrame:
    """Markdown with front matter: keys of plain lines, quotes taken off; tags cut at commas; the stem as title; the vault
    is the first of the given names that the path contains."""
    parts = F.split("value", "---", 3)
    has = F.col("value").startswith("---") & (F.size(parts) == 3)
    keyed = F.filter(F.split(F.try_element_at(parts, F.lit(2)), "\n"), lambda line: line.contains(":") & ~F.ltrim(line).startswith("-"))
    entry = lambda line: F.struct(x.strip(F.substring_index(line, ":", 1)).alias("k"), F.regexp_replace(x.strip(F.regexp_replace(line, "^[^:]*:", "")), "^[\"']+|[\"']+$", "").alias("v"))
    filled = F.filter(F.transform(keyed, entry), lambda e: (e["v"] != "") & (e["k"] != ""))
    meta = F.when(has, F.aggregate(filled, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"]))))
    rows = whole.select("path", meta.alias("m"), x.strip(F.when(has, F.try_element_at(parts, F.lit(3))).otherwise(F.col("value"))).alias("body"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    tags = F.filter(F.transform(F.split(get("tags"), ","), x.strip), lambda t: t != "")
    vault = reduce(lambda rest, v: F.when(F.col("path").contains(v), v).otherwise(rest), reversed(vaults), F.lit("unknown"))
    return rows.select("path", x.first_filled(get("title"), stem).alias("title"), tags.alias("tags"), get("status").alias("status"), get("type").alias("type"), get("created").alias("created"), get("updated").alias("updated"), vault.alias("vault"), F.try_element_at(F.split("path", "/"), F.lit(-2)).alias("directory"), "body").where(F.length("body") >= x.MIN_RESPONSE_CHARS)


def with_format(whole: DataFrame) -> DataFrame:
    """Adds format: by suffix, by the first JSON line, or by marks in a file's head."""
    first = F.try_parse_json(F.try_element_at(F.filter(F.split("value", "\n"), lambda t: F.trim(t) != ""), F.lit(1)))
    suffix = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    rows = whole.select("*", F.substring("value", 1, HEAD_CHARS).alias("head_"), suffix.alias("suffix_"), F.when(suffix == ".jsonl", first).alias("v_"))
    items = (_s("v_", "$.type") == "response_item") | F.try_variant_get("v_", "$.sessionId", "string").isNotNull()
    lined, whole_json = F.col("suffix_") == ".jsonl", F.col("suffix_") == ".json"
    marked = lambda mark: F.col("head_").contains(mark)
    kind = (
        F.when(F.col("suffix_") == ".md", "markdown")
        .when(lined & F.col("v_").isNotNull(), F.when(F.coalesce(items, F.lit(False)), "codex_jsonl").otherwise("claude_jsonl"))
        .when(whole_json & marked('"sessionId"') & marked('"messages"'), "gemini_json")
        .when(whole_json & (marked('"mapping"') | marked('"conversation_id"')), "openai_json")
        .otherwise("unknown")
    )
    return rows.withColumn("format", kind).drop("head_", "suffix_", "v_")


def detect_format(whole: DataFrame) -> DataFrame:
    """path, format."""
    return with_format(whole).select("path", "format")


def resolve(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """wanted (path) -> path, found: the same path, or else the first file of its name by root order, then path."""
    by_name = known.groupBy(x.basename(F.col("path")).alias("name")).agg(F.min(F.struct("root", "path"))["path"].alias("moved"))
    exact = known.select("path", F.col("path").alias("same")).distinct()
    out = wanted.join(exact, "path", "left").join(by_name, x.basename(F.col("path")) == F.col("name"), "left")
    return out.select("path", F.coalesce("same", "moved").alias("found"))
