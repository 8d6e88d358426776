"""Embedding near-dedup: rows of one label whose vectors have a cosine of at least a bound link up; one of each group stays.

1. Equal vectors of a label are one class (by two 64-bit hashes of label and components); only classes go on, with their sizes, so
   a vector repeated a million times costs one row.
2. Random-hyperplane signs: TABLES words of BITS signs each. A class has a key for each table, its label and word; two classes
   at an angle t share a given key with probability (1 - t / pi) ^ BITS. Keys that one class has alone are dropped.
3. In a bucket, pairs whose whole codes of TABLES * BITS signs differ in few enough places are candidates: at the bound itself a
   pair passes that by five standard deviations. A bucket gives the edges of a spanning forest of its candidates, no pairs.
4. Connected components of these edges gather what may link. Vectors move once, to their component, where every pair is
   verified by its exact cosine: so a pair counts once however many buckets it shares, also one that no bucket holds.
   Components give a forest again and, for each class, the summed sizes of the classes that it links with.
5. Connected components of verified links, and n_links, go back to the rows of each class.

Buckets and components of more than BLOCK members are dealt into parts, and every two parts meet in a task of their own, so no
group is held by one task; hot keys join by broadcast of their own row (common.lookup). What reaches the driver is one flag a
round of components.

At a cosine of 0.98, with 16 tables of 16 signs, a pair shares no bucket in about one of 900 cases, at 0.99 one of 30,000;
most of these are found all the same, as members of one component. No pair under the bound is linked.

Nulls and edge cases: rows with a null label, a vector that is null, zero, or of another length than most have, or any null or
non-finite component link with nothing and are their own component. A row with a null id links with nothing, has a null
component and is kept. Rows that repeat an id are rows of their own: equal ones link. Extra columns are ignored; an empty table
gives an empty result."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, lookup, settle, slots, stage
from .vectors import clean, width_of

TABLES, BITS, SEED = 16, 16, 13
#: Members of a part of a bucket or component; rows that a task compares at a time; sides of a tile.
BLOCK, BUFFER, TILE = 8192, 32768, 1024


def units(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nonzero rows at length one, and which these are."""
    most = np.abs(values).max(axis=1, initial=0)
    own = np.flatnonzero(most > 0)
    rows = values[own] / most[own, None]
    return rows / np.linalg.norm(rows, axis=1, keepdims=True), own


def most_differing(cosine: float) -> int:
    """Places in which the codes of a pair at the bound differ, five standard deviations up."""
    p, n = math.acos(max(-1.0, min(1.0, cosine))) / math.pi, TABLES * BITS
    return math.ceil(n * p + 5 * math.sqrt(n * p * (1 - p)))


def _hash(points: DataFrame, label: str, vector: str) -> Column:
    return F.xxhash64(points[f"`{label}`"], points[f"`{vector}`"])


def signed(points: DataFrame, width: int, id_: str, label: str, vector: str) -> DataFrame:
    """id, h, h2 (of label and vector), label (a hash) and code (null for a row that links with nothing) of every row."""
    v, group = F.col(f"`{vector}`"), F.col(f"`{label}`")
    rows = points.select(F.col(f"`{id_}`").cast("long").alias("id"), _hash(points, label, vector).alias("h"), F.xxhash64(F.lit(1), v, group).alias("h2"), F.xxhash64(group).alias("label"), F.when(group.isNotNull() & F.col(f"`{id_}`").isNotNull(), v).alias("v"))
    planes = np.random.default_rng(SEED).standard_normal((width, TABLES * BITS))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, own = clean(batch.column(4), width)
            rows, there = units(values)
            signs = np.packbits(rows @ planes > 0, axis=1)
            code = np.full(batch.num_rows, None, object)
            for at, row in zip(own[there].tolist(), signs, strict=True):
                code[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(code, pa.binary())], ["id", "h", "h2", "label", "code"])

    return rows.mapInArrow(codes, "id long, h long, h2 long, label long, code binary")


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j: root holds for each place the least of its set, in place."""
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low < high
        if not apart.any():
            return
        i, j, low, high = i[apart], j[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def compare(rows: np.ndarray, group: np.ndarray, part: np.ndarray, cross: np.ndarray, weight: np.ndarray, alike) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group: the least place of each row's set of alike rows, and the summed weights of the rows alike to it.
    In a cross group, only rows of different parts are compared."""
    n = len(rows)
    root, links = np.arange(n), np.zeros(n, np.int64)

    def note(i: np.ndarray, j: np.ndarray) -> None:
        own = ~cross[i] | (part[i] != part[j])
        i, j = i[own], j[own]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        _joined(root, i, j)

    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    ends = np.r_[starts[1:], n]
    large = ends - starts > 32
    small = np.repeat(~large, ends - starts)
    for d in range(1, 32):  # all small groups at once
        i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
        if not len(i):
            break
        i = i[alike(rows[i], rows[i + d], True)]
        note(i, i + d)
    for a, b in zip(starts[large].tolist(), ends[large].tolist(), strict=True):
        for p in range(a, b, TILE):
            for q in range(p, b, TILE):
                i, j = np.nonzero(alike(rows[p : min(p + TILE, b)], rows[q : min(q + TILE, b)], False))
                i, j = i + p, j + q
                note(i[i < j], j[i < j])
    return root, links


def _differ_little(most: int):
    """Whether codes differ in at most so many places; paired: row by row, else every one with every one."""

    def alike(x: np.ndarray, y: np.ndarray, paired: bool) -> np.ndarray:
        x = x if paired else x[:, None]
        return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= most

    return alike


def _at_least(cosine: float):
    def alike(x: np.ndarray, y: np.ndarray, paired: bool) -> np.ndarray:
        return (np.einsum("ij,ij->i", x, y) if paired else x @ y.T) >= cosine

    return alike


def forest(members: DataFrame, key: str, sizes: DataFrame, alike, decode) -> DataFrame:
    """rep, h, links, root_rep, root_h: of each member (rep, h, n, data) in each group of its key (with its count in sizes), the
    summed n of members alike to it and the least member that it hangs together with, for each two parts of the group."""
    found = lookup(members, sizes, [key], "count")
    parts = F.ceil(F.col("count") / BLOCK).cast("int")
    found = found.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("rep", "h"), F.col("parts")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col(key).alias("key"), F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "rep", "h", "n", "data")
    dealt = found.repartition(slots(members.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b")
    # component keys are structs: a hash of them keeps groups apart, as neighbours in the sort
    dealt = dealt.withColumn("key", F.xxhash64("key"))

    def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        key, a, b, part, rep, h, n = (t.column(i).to_numpy() for i in range(7))
        new = np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        root, links = compare(decode(t.column(7)), np.cumsum(new), part, a != b, n, alike)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rep, h, links, rep[root], h[root])], ["rep", "h", "links", "root_rep", "root_h"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, BUFFER rows or one group at a time."""
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero(np.r_[last is None or (key[0] != last).any(), (key[1:] != key[:-1]).any(axis=1)])
            at = 0
            for cut in cuts.tolist():
                if rows + cut - at >= BUFFER:
                    held.append(batch.slice(at, cut - at))
                    yield out(held)
                    held, rows, at = [], 0, cut
            held.append(batch.slice(at))
            rows, last = rows + batch.num_rows - at, key[-1]
        if rows:
            yield out(held)

    return dealt.mapInArrow(runs, "rep long, h long, links long, root_rep long, root_h long")


def _edges(found: DataFrame) -> DataFrame:
    node = lambda rep, h: F.struct(F.col(rep).alias("rep"), F.col(h).alias("h"))
    return found.where("rep <> root_rep or h <> root_h").select(node("root_rep", "root_h").alias("a"), node("rep", "h").alias("b"))


def near_duplicates(points: DataFrame, cosine: float = 0.98, id_: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """One row for each of points: id_, n_links, component_id, kept."""
    width = width_of(points, vector)
    rows = stage(signed(points, max(width, 1), id_, label, vector))
    linking = rows.where("code is not null")
    classes = stage(linking.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("code").alias("code")))

    word = BITS // 8
    code = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)
    keyed = classes.select("rep", "h", "n", F.col("code").alias("data"), "label", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("table"))
    keyed = keyed.withColumn("key", F.xxhash64("table", "label", F.substring(F.col("data"), F.col("table") * word + 1, F.lit(word)))).drop("table", "label")
    shared = keyed.groupBy("key").count().where("count > 1")
    near = forest(keyed, "key", shared, _differ_little(most_differing(cosine)), code)
    gathered = components(_edges(near))

    unit = lambda column: units(clean(column.combine_chunks(), width)[0])[0]
    own = points.select(F.col(f"`{id_}`").cast("long").alias("rep"), _hash(points, label, vector).alias("h"), F.col(f"`{vector}`").alias("data"))
    there = gathered.select("v.rep", "v.h", F.col("component").alias("key")).join(own, ["rep", "h"]).groupBy("rep", "h").agg(F.first("key").alias("key"), F.first("data").alias("data"))
    members = stage(there.join(classes.select("rep", "h", "n"), ["rep", "h"]))
    found = stage(forest(members, "key", members.groupBy("key").count(), _at_least(cosine), unit))
    links = found.groupBy("rep", "h").agg(F.sum("links").alias("links"))
    groups = components(_edges(found)).select("v.rep", "v.h", F.col("component.rep").alias("least"))

    told = classes.join(links, ["rep", "h"], "left").join(groups, ["rep", "h"], "left")
    told = told.select("h", "h2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    linked = lookup(linking.select("id", "h", "h2"), told, ["h", "h2"], "n").select("id", "n_links", "component_id")
    rest = rows.where("code is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.select(F.col("id").alias(id_), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector with its links, its component and whether it stays."""
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    return settle(lambda: near_duplicates(points))


ORACLE = """
WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT links.b, reach.c FROM reach JOIN links ON reach.v = links.a WHERE reach.c < links.b),
least AS (SELECT v, min(c) AS component_id FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v AS vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v = component_id AS kept FROM least LEFT JOIN n ON n.a = v
"""
