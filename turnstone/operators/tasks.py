"""Tasks, and the files that name them: listing, the next one for someone, status changes, and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States, and priorities from the most urgent.
STATES = ("inbox", "ready", "in_progress", "waiting", "blocked", "done", "cancelled")
PRIORITIES = ("P0", "P1", "P2", "P3")
_OPEN = ("inbox", "ready")


def rank(value: Column, ordered: Sequence[str]) -> Column:
    """The place of a value in an order, counted from 0; after all of them where it is none."""
    at = F.array_position(F.array(*map(F.lit, ordered)), value)
    return F.when(at > 0, at - 1).otherwise(len(ordered)).cast("int")


def listed(tasks: DataFrame, **equal: str | None) -> DataFrame:
    from turnstone.operators.drawers import where_all

    return where_all(tasks, **equal)


def next_for(tasks: DataFrame, assignee: str, k: int = 1) -> DataFrame:
    """The most urgent open tasks of an assignee, or of nobody; ties by id."""
    own = tasks.where(F.col("assignee").isNull() | (F.col("assignee") == assignee)).where(F.col("status").isin(*_OPEN))
    return own.orderBy(rank(F.col("priority"), PRIORITIES), "task_id").limit(k)


def move(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Applies wanted (task_id, status, by, at) to tasks with a log: who moved what when. One change a task: of several,
    the last by at; a state that does not exist changes nothing."""
    one = wanted.where(F.col("status").isin(*STATES)).groupBy("task_id").agg(F.max(F.struct("at", "status", "by")).alias("w"))
    line = F.concat_ws(" ", F.col("w.at").cast("string"), F.col("w.by"), F.concat(F.col("status"), F.lit("->"), F.col("w.status")))
    log = F.when(F.col("w").isNull(), F.col("log")).otherwise(F.array_append(F.coalesce("log", F.array().cast("array<string>")), line))
    rest = [c for c in tasks.columns if c not in ("status", "log")]
    return tasks.join(one, "task_id", "left").select(*rest, F.coalesce("w.status", "status").alias("status"), log.alias("log"))


def boards(tasks: DataFrame, by: Sequence[str] = ("assignee", "project"), status: str = "status") -> DataFrame:
    """The dashboards in one pass: board (all, or the column counted by), key, active (neither done nor cancelled) and n."""
    live = F.when(F.col(status).isin("done", "cancelled"), 0).otherwise(1)
    rows = tasks.select(*by, live.alias("live_"))
    out = rows.groupingSets([[], *[[c] for c in by]], *by).agg(F.grouping_id().alias("g_"), F.sum("live_").cast("bigint").alias("active"), F.count("*").alias("n"))
    board, key = F.lit("all"), F.lit(None).cast("string")
    for i, c in enumerate(by):
        own = F.col("g_") == (1 << len(by)) - 1 - (1 << len(by) - 1 - i)
        board, key = F.when(own, c).otherwise(board), F.when(own, F.col(c).cast("string")).otherwise(key)
    return out.select(board.alias("board"), key.alias("key"), "active", "n")


def named(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds stamp, node and kind from names like 2026-01-02-150405-node-kind.md; null where a name has another form. The
    kind is what follows the last hyphen."""
    form = r"(?:^|/)(\d{4}-\d{2}-\d{2}-\d{6})-([^/]+)-([^/-]+)\.md$"
    part = lambda n: F.nullif(F.regexp_extract(path, form, n), F.lit(""))
    return files.select("*", F.try_to_timestamp(part(1), F.lit("yyyy-MM-dd-HHmmss")).alias("stamp"), part(2).alias("node"), part(3).alias("kind"))


def doctor(tasks: DataFrame, projects: DataFrame) -> DataFrame:
    """task_id, problem: states and priorities that do not exist, and projects that are not there."""
    checks = [(~F.col("status").isin(*STATES), "unknown status"), (~F.col("priority").isin(*PRIORITIES), "unknown priority"), (F.col("assignee").isNull() & F.col("status").eqNullSafe("in_progress"), "nobody on it")]
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(True)), name) for bad, name in checks)))
    wrong = tasks.select("task_id", F.explode(found).alias("problem"))
    orphans = tasks.join(projects.select("project"), "project", "left_anti").select("task_id", F.lit("orphan").alias("problem"))
    return wrong.unionByName(orphans)
