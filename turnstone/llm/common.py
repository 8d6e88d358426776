"""What the operators of this subpackage share: staged tables, batches of bounded size, connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstone.sources.scratch import tidy

# What the task contracts call white space and a word, as Java, RE2 and DuckDB patterns.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_staged: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, only a local master may go
    on, with a folder of its own (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints"


def track(spark: SparkSession, path: str) -> None:
    """From now on settle() and the end of the driver delete the path, as they do what stage() writes."""
    _staged.append((spark, path))


def stage(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/turnstone-{uuid.uuid4().hex}"
    track(spark, path)
    writer = df.write.option("compression", "zstd")
    with tidy(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in frames:
        _delete(df.sparkSession, df.staged_path)


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """The staged result of make, without the tables that make staged on the way. Not for several threads at once."""
    before = {path for _, path in _staged}
    out = stage(make())
    for spark, path in list(_staged):
        if path not in before and path != out.staged_path:
            _delete(spark, path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _staged[:] = [x for x in _staged if x[1] != path]


@atexit.register
def _clean() -> None:
    for spark, path in list(_staged):
        try:
            _delete(spark, path)
        except Exception:  # its session may have ended; the shared folder's owner then clears it
            continue


def slots(spark: SparkSession) -> int:
    """Partitions for data dealt by key: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a binary column that hold at most limit bytes, or one row."""
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, len(column))
        at = to


def binary(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as UTF-8 bytes, nulls as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    column = column.cast(pa.binary()) if column.type != pa.binary() else column
    return column.fill_null(b"") if column.null_count else column


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives memory back to the system when a task ends: workers are kept for later tasks, and what an idle
    one holds is still its executor's."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # glibc alone has it
                ctypes.CDLL(None).malloc_trim(0)

    return outer


def only(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns alone, cast: extra columns never clash with an operator's own."""
    return df.select(*(F.col(f"`{c}`").cast(k).alias(c) for c, k in kinds.items()))


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(names: Iterable[str], prefix: str) -> str:
    """A prefix, longer than the given one if need be, that no name begins with: columns under it clash with none."""
    names = [n.lower() for n in names]
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    return prefix


#: A key that over one in so many rows have is joined by broadcast.
HEAVY = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """The inner join of rows with table, which holds one row a key and in the column weight how many rows have it.

    Keys with over 1 in HEAVY of all weight are fewer than HEAVY, whatever the input: they are broadcast, and their rows
    are dealt by their whole contents instead of by key, so no key's rows meet in one task."""
    p = fresh([*rows.columns, *table.columns], "k_")
    values = [c for c in table.columns if c not in keys]
    total = table.agg(F.sum(weight).alias(f"{p}total"))  # one row, so the join below is no product
    heavy = table.join(F.broadcast(total)).where(F.col(weight) * HEAVY > F.col(f"{p}total")).select(*keys, F.struct(*values).alias(f"{p}heavy"))
    dealt = rows.join(F.broadcast(heavy), keys, "left")
    dealt = dealt.withColumn(f"{p}deal", F.when(F.col(f"{p}heavy").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*columns_of(rows)).bitwiseOR(F.lit(1))))
    # 0, but no literal, which Catalyst would take out of the join's keys
    light = table.select(*keys, F.struct(*values).alias(f"{p}light"), F.least(F.col(weight), F.lit(0)).cast("long").alias(f"{p}deal"))
    found = dealt.join(light, [*keys, f"{p}deal"], "left").withColumn(f"{p}found", F.coalesce(f"{p}heavy", f"{p}light")).where(F.col(f"{p}found").isNotNull())
    return found.select(*columns_of(rows), *(F.col(f"{p}found")[v].alias(v) for v in values))


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Connected components of edges (a, b), any comparable type: rows (v, component), one for each vertex, where
    component is the smallest vertex. Loops (a = b) make a vertex.

    Contraction: in each round every vertex joins the neighbour of least priority, which is random but for the first round,
    where the vertex itself is it, so stars around a least vertex contract at once; edges are rewritten to the
    joined vertices and made distinct, so they shrink by a constant factor; the joins are then undone from the last
    round to the first. Minima are pre-aggregated, a hot vertex is a skewed join that AQE splits, and every round is
    staged, so no lineage grows and nothing of the graph reaches the driver but one flag a round."""
    kind = edges.schema["a"].dataType
    edges = stage(edges.select("a", "b"))  # what makes the edges runs once
    vertices = edges.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    live = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    joins, frames = [], [edges, live]
    for salt in range(rounds):
        if live.isEmpty():
            break
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        priority = lambda c: F.struct((F.xxhash64(F.lit(salt), c) if salt else F.lit(0).cast("long")).alias("h"), F.col(c).alias("b"))  # noqa: B023, E731
        near = both.groupBy("a").agg(F.min(priority("b")).alias("m"))
        own = priority("a")
        join = stage(near.select(F.col("a").alias("v"), F.least(own, "m")["b"].alias("to")))
        joins.append(join)
        left, right = (join.select(F.col("v").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        moved = live.join(left, "a").join(right, "b").where("to_a <> to_b")
        live = stage(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        frames.append(live)
    else:
        raise RuntimeError("components: not done after the given rounds")
    root = None
    for join in reversed(joins):
        root = join if root is None else join.select("v", F.col("to").alias("t")).join(root.select(F.col("v").alias("t"), F.col("to").alias("r")), "t", "left").select("v", F.coalesce("r", "t").alias("to"))
    if root is None:
        out = stage(vertices.select("v", F.col("v").alias("component")))
    else:
        # vertices of loops alone are in no join
        root = vertices.join(root, "v", "left").select("v", F.coalesce("to", "v").alias("to"))
        least = root.groupBy("to").agg(F.min("v").alias("component"))
        out = stage(root.join(least, "to").select("v", F.col("component").cast(kind)))
    unstage(*frames, *joins)
    return out


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def empty_guard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold rows."""
    return (b for b in batches if b.num_rows)
