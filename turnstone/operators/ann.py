"""A vector index in inverted lists: approximate nearest neighbours by cosine, exactly re-ranked.

Centroids are k-means centres of unit vectors, fitted on a bounded sample (SAMPLE_A_LIST rows a list, those of least hash of
their id). Every row of the collection is in the list of its nearest centroid. Lists are a partition column, so a query reads
the files of its nprobe nearest lists alone; a list's rows are packed in blocks of BLOCK, and writing rebalances, so a list
that holds a third of all rows is many files. Scores are exact cosines of the vectors as given: with nprobe of all lists
the answer is that of a full scan. What the driver holds is the centroids: lists x width numbers.

Null vectors, zero vectors, vectors of another width and rows with a null id are in no list and never found."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions.vectors import matrix
from turnstone.sources import store

LISTS, SAMPLE_A_LIST, STEPS, BLOCK, QUERIES = 64, 64, 10, 1024, 256


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


@dataclass
class Ivf:
    """Where an index is, and its centroids."""

    path: str
    centroids: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def probes(self, asked: np.ndarray, nprobe: int) -> np.ndarray:
        """For each query the nprobe lists of nearest centroids, the nearest first; none for queries of another width."""
        if asked.shape[1] != self.centroids.shape[1]:
            return np.zeros((len(asked), 0), np.int64)
        return np.argsort(-(_unit(asked) @ self.centroids.T), axis=1, kind="stable")[:, :nprobe]


def _centres(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means; the first distinct rows of the sample, which is in random order, begin."""
    _, first = np.unique(sample, axis=0, return_index=True)
    centres = sample[np.sort(first)[:lists]]
    for _ in range(STEPS):
        near = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, _unit(sums), centres)
    return centres


def build(points: DataFrame, path: str, lists: int = LISTS, id_: str = "vec_id", vector: str = "embedding") -> Ivf:
    """Writes the index of all points to a new folder."""
    rows = points.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and size(v) > 0")
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths.w if widths else 1
    sample = rows.where(F.size("v") == width).orderBy(F.xxhash64("id"), "id").limit(lists * SAMPLE_A_LIST).collect()
    drawn = np.array([r.v for r in sample], float).reshape(-1, width)
    drawn = drawn[np.isfinite(drawn).all(axis=1) & drawn.any(axis=1)]
    centroids = _centres(_unit(drawn), lists) if len(drawn) else np.zeros((1, width))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, own = matrix(batch.column(1), width)
            there = np.isfinite(v).all(axis=1) & v.any(axis=1)
            take = pa.array(own[there])
            near = (_unit(v[there]) @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], ["list", "id", "v"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one list in a row, BLOCK at most."""
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            spans = [(i, min(i + BLOCK, b)) for a, b in zip(cuts, cuts[1:], strict=False) for i in range(a, b, BLOCK)]
            offsets = np.array([0, *(b for _, b in spans)], np.int32)
            vectors = batch.column(2).flatten()
            yield pa.RecordBatch.from_arrays([pa.array(at[offsets[:-1]]), pa.ListArray.from_arrays(pa.array(offsets), batch.column(1)), pa.ListArray.from_arrays(pa.array(offsets * width), vectors)], ["list", "ids", "vectors"])

    kind = rows.schema["v"].dataType.simpleString()
    flat = rows.mapInArrow(listed, f"list int, id long, v {kind}")
    # rebalance deals a large list over several tasks and gathers small ones
    blocks = flat.hint("rebalance", "list").sortWithinPartitions("list", "id").mapInArrow(packed, f"list int, ids array<long>, vectors {kind}")
    blocks.write.partitionBy("list").parquet(f"{path}/lists")
    spark = points.sparkSession
    spark.createDataFrame([(json.dumps(centroids.tolist()),)], "value string").coalesce(1).write.text(f"{path}/centroids")
    return Ivf(path, centroids)


def load(spark: SparkSession, path: str) -> Ivf:
    return Ivf(path, np.array(json.loads(spark.read.text(f"{path}/centroids").first()[0])))


def _blocks(spark: SparkSession, index: Ivf) -> DataFrame:
    if not store.names(spark, f"{index.path}/lists") or not any(n.startswith("list=") for n in store.names(spark, f"{index.path}/lists")):
        return spark.createDataFrame([], "ids array<long>, vectors array<float>, list int")
    return spark.read.parquet(f"{index.path}/lists")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each column, ties by id."""
    return np.lexsort((np.broadcast_to(ids[:, None], scores.shape), -scores), axis=0)[:k]


def search(spark: SparkSession, index: Ivf, asked: Sequence[float], k: int, nprobe: int, digits: int = 4) -> DataFrame:
    """id, score: the k best of the query's nprobe lists; only their files are read, and k rows a block leave a task."""
    q = np.asarray(asked, float)
    lists = index.probes(q[None, :], nprobe)[0].tolist()
    unit = _unit(q[None, :])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, v in zip(batch.column(0), batch.column(1), strict=True):
                ids = own.values.to_numpy()
                s = np.round(_unit(v.values.to_numpy().astype(float).reshape(len(ids), -1)) @ unit.T, digits)
                at = _best(ids, s, k)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(s[at, 0])], ["id", "score"])

    near = _blocks(spark, index).where(F.col("list").isin(lists)).select("ids", "vectors")
    return near.mapInArrow(score, "id long, score double").orderBy(F.desc("score"), "id").limit(k)


def search_many(index: Ivf, queries: DataFrame, k: int, nprobe: int, id_: str = "vec_id", vector: str = "embedding", digits: int = 4) -> DataFrame:
    """query_id, id, score, rank for a table of queries: each but itself. Queries go to their lists in packed blocks and meet
    the list's blocks in a join, which Spark splits where a list is hot; nothing of them passes the driver."""
    width = index.centroids.shape[1]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, QUERIES):
                batch = whole.slice(at, QUERIES)
                v, own = matrix(batch.column(1), width)
                there = np.isfinite(v).all(axis=1) & v.any(axis=1)
                v, ids = v[there], batch.column(0).to_numpy(zero_copy_only=False)[own[there]]
                lists = index.probes(v, nprobe)
                for list_ in np.unique(lists):
                    mine = (lists == list_).any(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([list_], pa.int32()), pa.array([ids[mine].astype(np.int64).tolist()], pa.list_(pa.int64())), pa.array([v[mine].ravel().tolist()], pa.list_(pa.float64()))], ["list", "q_ids", "q_vectors"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, v, q_own, q_v in zip(*batch.columns, strict=True):
                ids, q_ids = own.values.to_numpy(), q_own.values.to_numpy()
                s = np.round(_unit(v.values.to_numpy().astype(float).reshape(len(ids), -1)) @ _unit(q_v.values.to_numpy().reshape(len(q_ids), -1)).T, digits)
                s[ids[:, None] == q_ids] = -np.inf
                at = _best(ids, s, k)
                q = np.broadcast_to(np.arange(len(q_ids)), at.shape)
                keep = np.isfinite(s[at, q])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q[keep]]), pa.array(ids[at[keep]]), pa.array(s[at, q][keep])], ["query_id", "id", "score"])

    asked = queries.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null")
    asked = asked.mapInArrow(dealt, "list int, q_ids array<long>, q_vectors array<double>")
    pairs = _blocks(queries.sparkSession, index).join(asked, "list").select("ids", "vectors", "q_ids", "q_vectors")
    found = pairs.mapInArrow(score, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """One row: queries, and the share of the exact k nearest that are found."""
    hit = exact.where(F.col("rank") <= k).join(found.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def enough_probes(index: Ivf, queries: DataFrame, exact: DataFrame, k: int, least: float = 0.9, id_: str = "vec_id", vector: str = "embedding") -> int:
    """The fewest probes, of the powers of two and three quarters of all lists, that reach a recall; all lists otherwise."""
    for n in sorted({*(1 << i for i in range(index.lists.bit_length())), max(1, index.lists * 3 // 4)}):
        if n < index.lists and (recall(search_many(index, queries, k, n, id_, vector), exact, k).first().recall or 0) >= least:
            return n
    return index.lists
