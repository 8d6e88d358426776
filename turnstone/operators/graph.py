"""Temporal facts, and the graph of rooms that wings share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from turnstone.sources import scratch


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that hold at a time: from valid_from on, until before valid_to."""
    return facts.where((F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def about(facts: DataFrame, entity: str, direction: str = "both") -> DataFrame:
    out = facts.where(F.col("subject") == entity).withColumn("direction", F.lit("outgoing"))
    into = facts.where(F.col("object") == entity).withColumn("direction", F.lit("incoming"))
    return {"outgoing": out, "incoming": into, "both": out.unionByName(into)}[direction]


def timeline(facts: DataFrame, entity: str | None = None) -> DataFrame:
    rows = facts if entity is None else facts.where((F.col("subject") == entity) | (F.col("object") == entity))
    return rows.orderBy(F.col("valid_from").asc_nulls_first(), "subject", "predicate", "object")


def invalidate(facts: DataFrame, subject: str, predicate: str, object_: str, at: Column) -> DataFrame:
    """Closes the interval of a current fact; the row stays."""
    hit = (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == object_) & F.col("valid_to").isNull()
    return facts.withColumn("valid_to", F.when(hit, at).otherwise(F.col("valid_to")))


def invalidate_all(facts: DataFrame, gone: DataFrame, at: str = "at") -> DataFrame:
    """The same for many facts at once: gone (subject, predicate, object and a time, the earliest of several counts)."""
    key = ["subject", "predicate", "object"]
    ends = gone.groupBy(*key).agg(F.min(at).alias("end_"))
    closed = F.when(F.col("valid_to").isNull(), F.col("end_")).otherwise(F.col("valid_to"))
    return facts.join(ends, key, "left").withColumn("valid_to", closed).select(facts.columns)


def add(facts: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """facts and those of new that are not current already."""
    key = key or ("subject", "predicate", "object")
    current = facts.where(F.col("valid_to").isNull()).select(*key).distinct()
    return facts.unionByName(new.join(current, list(key), "left_anti"), allowMissingColumns=True)


def fact_stats(facts: DataFrame) -> DataFrame:
    entities = facts.select(F.col("subject").alias("e")).union(facts.select("object")).agg(F.count_distinct("e").alias("entities"))
    rest = facts.agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("current_facts"), F.count_if(F.col("valid_to").isNotNull()).alias("expired_facts"), F.array_join(F.array_sort(F.collect_set("predicate")), ",").alias("relationship_types"))
    return entities.join(F.broadcast(rest))  # one row each


def tunnels(drawers: DataFrame, wing: str, room: str, hall: str | None = None, filed: str | None = None) -> DataFrame:
    """Rooms that two wings or more share: their wings, halls, number of drawers, and when the last was filed."""
    halls = F.col(hall) if hall else F.lit(None).cast("string")
    last = F.max(filed) if filed else F.lit(None).cast("string")
    rooms = drawers.groupBy(F.col(room).alias("room")).agg(F.array_sort(F.collect_set(wing)).alias("wings"), F.array_sort(F.collect_set(halls)).alias("halls"), F.count_if(F.col(wing).isNotNull()).alias("count"), last.alias("recent"))
    return rooms.where(F.size("wings") >= 2)


def tunnels_between(drawers: DataFrame, wing: str, room: str, a: str, b: str) -> DataFrame:
    return drawers.where(F.col(wing) == a).select(room).intersect(drawers.where(F.col(wing) == b).select(room))


def graph_stats(drawers: DataFrame, wing: str, room: str, top: int = 10) -> DataFrame:
    """One row: rooms, those that wings share, pairs of wings that rooms join, rooms of each wing (a map), and the rooms of
    most wings, then of most drawers, then by name."""
    both = drawers.where(F.col(wing).isNotNull()).groupBy(F.col(room).alias("room"), F.col(wing).alias("wing")).agg(F.count("*").alias("n"))
    rooms = both.groupBy("room").agg(F.array_sort(F.collect_list("wing")).alias("wings"), F.sum("n").alias("count"))
    w = F.size("wings")
    totals = rooms.agg(F.count("*").alias("total_rooms"), F.count_if(w >= 2).alias("tunnel_rooms"), F.coalesce(F.sum(w * (w - 1) / 2), F.lit(0)).cast("bigint").alias("total_edges"))
    wings = both.groupBy("wing").agg(F.count("*").alias("rooms")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("wing", "rooms")))).alias("rooms_per_wing"))
    first = rooms.where(w >= 2).orderBy(F.desc(w), F.desc("count"), "room").limit(top)
    order = F.struct((-w).alias("w"), (-F.col("count")).alias("n"), "room", "wings", "count")
    most = first.agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: F.struct(r["room"].alias("room"), r["wings"].alias("wings"), r["count"].alias("count"))).alias("top_tunnels"))
    return totals.join(F.broadcast(wings)).join(F.broadcast(most))  # one row each


def traverse(drawers: DataFrame, wing: str, room: str, start: str, depth: int) -> DataFrame:
    """Rooms reached from a room by at most depth steps over shared wings, and in how many.

    A frontier walks: each round joins only the rooms that the last one reached, over wings not walked before, and appends the
    rooms that are new to one table. A round's plan is the same at any depth, and what does not reach further ends it."""
    spark = drawers.sparkSession
    links = scratch.stage(drawers.where(F.col(wing).isNotNull() & F.col(room).isNotNull()).select(F.col(room).alias("room"), F.col(wing).alias("wing")).distinct())
    rooms, wings = scratch.folder(spark), scratch.folder(spark)
    read = lambda path, schema: spark.read.schema(schema).parquet(path)
    spark.createDataFrame([(start, 0)], "room string, hops int").write.parquet(rooms)
    spark.createDataFrame([], "wing string, hops int").write.parquet(wings)
    for hop in range(1, depth + 1):
        seen, walked = read(rooms, "room string, hops int"), read(wings, "wing string, hops int")
        new = seen.where(F.col("hops") == hop - 1).join(links, "room").select("wing").distinct().join(walked, "wing", "left_anti")
        new.select(F.col("wing").cast("string").alias("wing"), F.lit(hop).alias("hops")).write.mode("append").parquet(wings)
        step = read(wings, "wing string, hops int").where(F.col("hops") == hop).join(links, "wing").select("room").distinct().join(seen, "room", "left_anti")
        reached = Observation()
        step.select(F.col("room").cast("string").alias("room"), F.lit(hop).alias("hops")).observe(reached, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(rooms)
        if not reached.get["n"]:
            break
    return read(rooms, "room string, hops int")
