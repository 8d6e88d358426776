"""Joins on time: points in validity intervals, and the last value before each point, for many dates at once.

Interval join: an interval belongs to the level of the least power of FACTOR seconds that it fits in, where it covers two
buckets at most; intervals open at an end, or wider than the last level, are at the top, in one bucket. A point looks into one
bucket of each level that intervals use, LEVELS at most. So the join is by equal (key, level, bucket), with the bounds as
a residual: no nested loop, no replication that grows with an interval's length, and a key that holds a third of all rows
is dealt by its times. Rows of the top bucket of a hot key are the ones that Spark's skew join has to split.

As-of join: a key's times are cut into buckets. Within a bucket a window carries the last value on; what came before a
bucket is carried over summaries of one row a bucket. So a hot key is as many window partitions as it has buckets, not one.

Null keys match nothing; null ends are open; an interval that ends at or before its start holds at no time; a point with a null
time matches nothing. Ties of the as-of join go to the value that order puts last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FACTOR, LEVELS = 8, 12
_TOP = LEVELS


def _seconds(at: Column) -> Column:
    """A time as seconds, rounded down."""
    return F.unix_seconds(at.cast("timestamp"))


def within(points: DataFrame, facts: DataFrame, key: str, at: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Every point with each fact of its key that holds at its time: from start on, until before end."""
    length = _seconds(F.col(end)) - _seconds(F.col(start)) + 1
    closed = F.col(start).isNotNull() & F.col(end).isNotNull()
    # a power of two, so that a width is exact
    level = F.when(closed, F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double")) / F.log2(F.lit(float(FACTOR)))))).otherwise(_TOP)
    placed = facts.where(~closed | (F.col(start) < F.col(end))).withColumn("l_", F.least(level, F.lit(_TOP)).cast("int"))
    width = F.pow(F.lit(float(FACTOR)), F.col("l_").cast("double")).cast("long")
    bucket = lambda s: F.when(F.col("l_") < _TOP, F.floor(s / width)).otherwise(0).cast("long")
    both = F.array_distinct(F.array(bucket(_seconds(F.col(start))), bucket(_seconds(F.col(end)))))
    placed = placed.withColumn("b_", F.explode(F.when(F.col("l_") < _TOP, both).otherwise(F.array(F.lit(0).cast("long")))))
    used = [r.l_ for r in placed.select("l_").distinct().collect()]  # LEVELS + 1 rows at most
    asked = points.where(F.col(at).isNotNull()).withColumn("l_", F.explode(F.array(*map(F.lit, sorted(used))).cast("array<int>")))
    asked = asked.withColumn("b_", bucket(_seconds(F.col(at))))
    hold = (F.col(start).isNull() | (F.col(start) <= F.col(at))) & (F.col(end).isNull() | (F.col(end) > F.col(at)))
    return asked.join(placed, [key, "l_", "b_"]).where(hold).drop("l_", "b_")


def last_before(points: DataFrame, facts: DataFrame, key: str, at: str, since: str, values: Sequence[str], order: Sequence[str] = (), bucket: int = 86_400) -> DataFrame:
    """points with since and values of the last fact of their key at or before their time, null where there is none. Facts of
    one time are in the order of order, then of values. bucket is the width of a bucket in seconds."""
    own = points.columns
    fact = F.struct(F.col(since).alias("t"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).alias(f"v{i}") for i, c in enumerate(values)))
    facts = facts.where(F.col(since).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(since).alias("t"), F.floor(_seconds(F.col(since)) / bucket).alias("b"), fact.alias("f"))
    asked = points.select(F.struct(*own).alias("p"), F.col(key).alias("k"), F.col(at).alias("t"))
    there = asked.where(F.col("k").isNotNull() & F.col("t").isNotNull()).withColumn("b", F.floor(_seconds(F.col("t")) / bucket))
    none = asked.where(F.col("k").isNull() | F.col("t").isNull()).select("p", F.lit(None).cast(facts.schema["f"].dataType).alias("f"))
    # of equal times, facts come before points
    both = facts.select("k", "b", "t", "f", F.lit(None).cast(there.schema["p"].dataType).alias("p")).unionByName(there.select("k", "b", "t", F.lit(None).cast(facts.schema["f"].dataType).alias("f"), "p"))
    inside = Window.partitionBy("k", "b").orderBy("t", F.col("p").isNotNull(), "f").rowsBetween(Window.unboundedPreceding, 0)
    inner = both.withColumn("f", F.last("f", True).over(inside)).where("p is not null")
    # one row a bucket: what is last in it, then what is last before it
    buckets = facts.groupBy("k", "b").agg(F.max("f").alias("f")).unionByName(there.select("k", "b").distinct().withColumn("f", F.lit(None).cast(facts.schema["f"].dataType)))
    buckets = buckets.groupBy("k", "b").agg(F.max("f").alias("f"))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("c", F.last("f", True).over(before)).select("k", "b", "c")
    found = inner.join(carried, ["k", "b"]).select("p", F.coalesce("f", "c").alias("f")).unionByName(none)
    return found.select(*(F.col("p")[c].alias(c) for c in own), F.col("f.t").alias(since), *(F.col("f")[f"v{i}"].alias(c) for i, c in enumerate(values)))
