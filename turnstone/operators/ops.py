"""Collections, export, health and the state of tasks and broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstone.functions import text as x


def collection_stats(points: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """A row for each registered collection: points, and whether it is there."""
    found = points.groupBy(key).agg(F.count("*").alias("n"))
    return registry.join(found, key, "left").withColumn("available", F.col("n").isNotNull())


def totals(points: DataFrame, key: str) -> DataFrame:
    return points.rollup(key).agg(F.count("*").alias("n"))


# Names that the sides of a pair go by in payloads, in order of preference.
USER_FIELDS, ANSWER_FIELDS = ("user_input", "user"), ("valther", "assistant", "alexko_response", "ai_response", "ai")


def sides(points: DataFrame) -> tuple[Column, Column]:
    """The first filled field of either side among those that points have."""
    have = set(points.columns)
    one = lambda names: x.first_filled(*(F.col(n) for n in names if n in have), F.lit(""))
    return one(USER_FIELDS), one(ANSWER_FIELDS)


def training_rows(pairs: DataFrame, user: Column, answer: Column, meta: dict[str, Column], secrets: Sequence[tuple[str, str]] = x.SECRETS) -> DataFrame:
    """{messages, meta} rows, redacted (no secrets: as they are), without empty sides."""
    clean = lambda c: x.strip(x.redact(c, secrets)) if secrets else x.strip(c)
    rows = pairs.select("*", clean(user).alias("u_"), clean(answer).alias("a_")).where("u_ <> '' and a_ <> ''")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.select(F.array(message("user", "u_"), message("assistant", "a_")).alias("messages"), F.struct(*(v.alias(k) for k, v in meta.items())).alias("meta"))


def fingerprint(files: DataFrame, path: Column, changed: Column, *by: str) -> DataFrame:
    """A hash over path:time of all files, by directory: the MD5 of their number and of the four sums of the 32-bit words
    of each line's MD5. Sums need no order, so nothing is gathered."""
    lines = files.select(*by, F.md5(F.concat(path, F.lit(":"), changed.cast("string"))).alias("h"))
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("bigint")).cast("string") for i in range(4)]
    return lines.groupBy(*by).agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), *words)).alias("fingerprint"))


def health_score(checks: DataFrame) -> DataFrame:
    """checks (layer, ok, weight) -> score, possible and whether all is well."""
    return checks.agg(F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0.0)).alias("score"), F.sum("weight").alias("possible"), F.min(F.col("ok").cast("int")).alias("all_ok"))


def health(counts: DataFrame, required: Sequence[str]) -> DataFrame:
    """counts (layer, available, total, path) -> one row: ok (all required are available), and the layers in order of name."""
    layer = F.struct("layer", "available", F.coalesce("total", F.lit(0)).cast("bigint").alias("total"), "path")
    there = F.count_if(F.col("layer").isin(*required) & F.col("available")) if required else F.lit(0)
    return counts.agg((there == len(required)).alias("ok"), F.array_sort(F.collect_list(layer)).alias("layers"))


def recent(rows: DataFrame, time: str, hours: int = 48, now: Column | None = None) -> DataFrame:
    """Rows of the last hours before now, or before the last of them."""
    if now is not None:
        return rows.where(F.col(time) >= now - F.make_dt_interval(hours=F.lit(hours)))
    last = rows.agg(F.max(time).alias("last_"))  # one row, so the join is no product
    return rows.join(F.broadcast(last)).where(F.col(time) >= F.col("last_") - F.make_dt_interval(hours=F.lit(hours))).drop("last_")


# Access levels from the least to the most restricted.
LEVELS = ("L1", "L2", "L3", "L4", "L5")


def _level(x_: Column) -> Column:
    """From 1; beyond all for what is no level, so it is shown to nobody."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), x_)
    return F.when(at > 0, at).otherwise(len(LEVELS) + 1)


def visible(rows: DataFrame, clearance: str, level: str = "level") -> DataFrame:
    """Rows of a level up to the clearance."""
    return rows.where(_level(F.col(level)) <= LEVELS.index(clearance) + 1)


def elevate(rows: DataFrame, wanted: Column, level: str = "level") -> DataFrame:
    """Rows with the higher of their level and the wanted one: levels go up, never down."""
    return rows.withColumn(level, F.when(wanted.isNotNull() & (_level(wanted) <= len(LEVELS)) & (_level(wanted) > _level(F.col(level))), wanted).otherwise(F.col(level)))


def missing(required: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return required.join(present, key, "left_anti")


def unacknowledged(broadcasts: DataFrame, acks: DataFrame, *key: str) -> DataFrame:
    return broadcasts.join(acks, list(key), "left_anti")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by order: the largest of a struct, so a hot key is pre-aggregated."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("m")).select(key, "m.*")
