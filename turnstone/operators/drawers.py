"""Filed text chunks: browsing, siblings, counts and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstone.functions import text as x
from turnstone.functions.vectors import Embedder
from turnstone.operators import graph
from turnstone.operators import search as vectors
from turnstone.sources import store

MOST_PAGE, MOST_HITS = 200, 50


def where_all(drawers: DataFrame, **equal: str | None) -> DataFrame:
    """Rows that equal every given value; a value of None asks for nothing."""
    conditions = [F.col(c) == v for c, v in equal.items() if v is not None]
    return drawers.where(reduce(lambda a, b: a & b, conditions)) if conditions else drawers


def newest_first(drawers: DataFrame, id_: str) -> DataFrame:
    return drawers.orderBy(F.coalesce("filed_at", F.lit("")).desc(), id_)


def page(drawers: DataFrame, id_: str, limit: int, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MOST_PAGE or offset < 0:
        raise ValueError(f"limit is 1 to {MOST_PAGE}, offset 0 or more")
    return newest_first(drawers, id_).offset(offset).limit(limit)


def browse(drawers: DataFrame, wing: str, room: str, limit: int = 30, offset: int = 0, id_: str = "id", document: str = "document") -> DataFrame:
    """One row: wing, room, offset, limit, total (of all pages) and items, the page's summaries in order."""
    own = where_all(drawers, wing=wing, room=room)
    shown = summary(page(own, id_, limit, offset), id_, document)
    # at most MOST_PAGE rows; newest first, which an ascending sort of structs cannot say, so by a comparison
    newest = lambda p, q: F.when(F.coalesce(p["filed_at"], F.lit("")) > F.coalesce(q["filed_at"], F.lit("")), -1).when(F.coalesce(p["filed_at"], F.lit("")) < F.coalesce(q["filed_at"], F.lit("")), 1).when(p["id"] < q["id"], -1).otherwise(1)
    items = shown.agg(F.array_sort(F.collect_list(F.struct(*shown.columns)), newest).alias("items"))
    total = own.agg(F.count("*").alias("total"))
    head = {"wing": wing, "room": room, "offset": offset, "limit": limit}
    return total.join(F.broadcast(items)).select(*(F.lit(v).alias(k) for k, v in head.items()), "total", "items")  # one row each


def siblings(drawers: DataFrame, id_: str, of: int | str, source: str = "source_file", chunk: str = "chunk_index") -> DataFrame:
    """The chunks of the same source, and which one was asked for."""
    own = drawers.where(F.col(id_) == of).select(source)
    return drawers.join(own, source, "left_semi").withColumn("is_current", F.col(id_) == of).withColumn("chunk", F.coalesce(F.col(chunk), F.lit(0)))


def counts(drawers: DataFrame, *by: str) -> DataFrame:
    return drawers.groupBy(*by).agg(F.count("*").alias("n"))


def top_groups(drawers: DataFrame, by: str, k: int = 6) -> DataFrame:
    return counts(drawers, by).orderBy(F.desc("n"), by).limit(k)


def dashboard(drawers: DataFrame, wing: str, room: str) -> DataFrame:
    return drawers.agg(F.count("*").alias("drawers"), F.count_distinct(wing).alias("wings"), F.count_distinct(room).alias("rooms"))


def overview(drawers: DataFrame, id_: str = "id", document: str = "document", k: int = 6) -> DataFrame:
    """One row: totals, the k largest wings and rooms, the k newest drawers, and the graph's figures."""
    ranked = lambda by: top_groups(drawers, by, k).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), by))), lambda r: F.struct(r[by].alias("name"), (-r["m"]).alias("count"))).alias(f"top_{by}s"))
    items = summary(page(drawers, id_, k), id_, document)
    newest = F.struct(F.coalesce("filed_at", F.lit("")).alias("t"), F.struct(*items.columns).alias("d"))
    last_first = lambda p, q: F.when(p["t"] > q["t"], -1).when(p["t"] < q["t"], 1).when(p["d"]["id"] < q["d"]["id"], -1).otherwise(1)
    shown = items.agg(F.transform(F.array_sort(F.collect_list(newest), last_first), lambda r: r["d"]).alias("recent_drawers"))
    out = dashboard(drawers, "wing", "room")
    graph_ = graph.graph_stats(drawers, "wing", "room")
    for part in (ranked("wing"), ranked("room"), shown, graph_.select(F.struct(*graph_.columns).alias("graph"))):
        out = out.join(F.broadcast(part))  # one row each
    return out


def summary(drawers: DataFrame, id_: str, document: str) -> DataFrame:
    """The nine fields that lists show: texts that are missing are empty, other missing fields null."""
    have = set(drawers.columns)
    field = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    said = lambda c: F.coalesce(field(c, "string"), F.lit("")).alias(c)
    return drawers.select(
        F.col(id_).alias("id"),
        said("wing"),
        said("room"),
        said("source_file"),
        x.basename(F.coalesce(field("source_file", "string"), F.lit(""))).alias("source_name"),
        field("chunk_index", "int").alias("chunk_index"),
        field("filed_at", "string").alias("filed_at"),
        field("added_by", "string").alias("added_by"),
        x.preview(F.col(document)).alias("preview"),
    )


def search(drawers: DataFrame, asked: Sequence[float], wing: str | None = None, room: str | None = None, limit: int = 10, id_: str = "id", document: str = "document", vector: str = "embedding") -> DataFrame:
    """The drawers most like a query's vector, within a wing and room where given: similarity is one less the cosine
    distance, to three places."""
    if not 1 <= limit <= MOST_HITS:
        raise ValueError(f"limit is 1 to {MOST_HITS}")
    found = vectors.top_k(where_all(drawers, wing=wing, room=room), asked, limit, None, id_, vector, 3)
    shown = summary(found.select("*", F.col("score").alias("similarity")), id_, document)
    have = [c for c in shown.columns if c in ("id", "wing", "room", "source_file", "source_name", "preview")]
    return shown.select(*have).join(found.select(F.col(id_).alias("id"), F.col("score").alias("similarity"), F.col(document).alias("content")), "id").orderBy(F.desc("similarity"), "id")


def add(drawers: DataFrame, new: DataFrame, content: str = "document") -> DataFrame:
    """new without what is filed already, by content."""
    key = F.sha2(F.col(content), 256)
    return new.withColumn("h", key).join(drawers.select(key.alias("h")).distinct(), "h", "left_anti").drop("h")


def answers(drawers: DataFrame, new: DataFrame, id_: str = "id", content: str = "document") -> DataFrame:
    """For each of new: whether it would be filed, and duplicate as reason where its content is there."""
    key = F.sha2(F.col(content), 256)
    there = drawers.select(key.alias("h")).distinct().withColumn("there", F.lit(True))
    out = new.withColumn("h", key).join(there, "h", "left")
    return out.select(id_, F.col("there").isNull().alias("success"), F.when(F.col("there"), "duplicate").alias("reason"))


def delete(drawers: DataFrame, gone: DataFrame, id_: str) -> DataFrame:
    """drawers without the ids of gone."""
    return drawers.join(gone.select(id_), id_, "left_anti")


def find(drawers: DataFrame, id_: str, of: int | str) -> DataFrame:
    """The drawer and its siblings in the order of their chunks; raises where there is none."""
    if drawers.where(F.col(id_) == of).isEmpty():
        raise LookupError(f"no drawer {of}")
    return siblings(drawers, id_, of).orderBy("chunk", id_)


def drawer_id(wing: Column, room: Column, content: Column) -> Column:
    return F.concat(F.lit("drawer_"), wing, F.lit("_"), room, F.lit("_"), F.substring(F.md5(content), 1, 16))


#: Columns of a collection of drawers.
DRAWER = "id string, document string, wing string, room string, source_file string, chunk_index int, added_by string, filed_at string, embedding array<float>"


def file_drawer(spark: SparkSession, table: str, wing: str, room: str, content: str, source_file: str | None = None, added_by: str = "web", now: Column | None = None, embedder: Embedder | None = None) -> DataFrame:
    """Appends a drawer, with its vector where there is an embedder, to a store unless one of the same content is there. One
    row: success, drawer_id (of the one that is there, otherwise of the new one) and reason."""
    if not (wing and room and content and added_by):
        raise ValueError("wing, room, content and added_by are not empty")
    stamp = F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd'T'HH:mm:ss")
    new = spark.range(1).select(drawer_id(F.lit(wing), F.lit(room), F.lit(content)).alias("id"), F.lit(content).alias("document"), F.lit(wing).alias("wing"), F.lit(room).alias("room"), F.lit(source_file).cast("string").alias("source_file"), F.lit(0).alias("chunk_index"), F.lit(added_by).alias("added_by"), stamp.alias("filed_at"))
    if embedder is not None:
        new = new.withColumn("embedding", embedder(F.col("document")).cast("array<float>"))
    answer = "success boolean, drawer_id string, reason string"
    if store.exists(spark, f"{table}/drawers"):
        same = store.collection(spark, table, "drawers").where(F.sha2("document", 256) == F.sha2(F.lit(content), 256)).agg(F.min("id").alias("id")).first().id
        if same is not None:
            return spark.createDataFrame([(False, same, "duplicate")], answer)
    store.upsert(table, new.withColumn("batch", F.lit(0)), "drawers")
    return new.select(F.lit(True).alias("success"), F.col("id").alias("drawer_id"), F.lit(None).cast("string").alias("reason"))


def file_diary(spark: SparkSession, table: str, agent: str, entry: str, topic: str = "general", now: Column | None = None) -> DataFrame:
    """Appends a diary entry to a store. One row: success, entry_id, agent, topic, timestamp."""
    if not (agent and entry and topic):
        raise ValueError("agent, entry and topic are not empty")
    new = spark.range(1).select(*write_diary(agent, entry, F.current_timestamp() if now is None else now, topic))
    kept = new.sparkSession.createDataFrame(new.collect(), new.schema)  # one row, so that its time is read once
    kept = kept.withColumn("id", F.concat(F.lit("diary_"), F.md5(F.concat_ws("\x1f", "agent", "timestamp", "topic", "content"))))
    store.upsert(table, kept.withColumn("batch", F.lit(0)), "diary")
    return kept.select(F.lit(True).alias("success"), F.col("id").alias("entry_id"), "agent", "topic", "timestamp")


def write_diary(agent: str, entry: str, now: Column, topic: str = "general") -> list[Column]:
    """The columns of a diary entry; who writes them appends."""
    stamp = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")
    return [F.lit(agent).alias("agent"), F.date_format(now, "yyyy-MM-dd").alias("date"), stamp.alias("timestamp"), F.lit(topic).alias("topic"), F.lit(entry).alias("content")]


def read_diary(diary: DataFrame, agent: str, last: int = 10) -> DataFrame:
    if not 1 <= last <= 100:
        raise ValueError("last is 1 to 100")
    return diary.where(F.col("agent") == agent).orderBy(F.desc("timestamp"), "topic", "content").limit(last)
