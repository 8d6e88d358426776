"""Vector search and what is built from its hits.

Queries are scored with one matrix product a batch; only the vectors go to Python, and TakeOrderedAndProject keeps k rows a
task. Collections are a partition column, so a persona prunes files."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions import text as x
from turnstone.functions.vectors import cosines, matrix


def top_k(points: DataFrame, query: Sequence[float], k: int, where: Column | None = None, id_: str = "vec_id", vector: str = "embedding", digits: int = 4) -> DataFrame:
    """The k points most alike, ties by id, after the filter."""
    rows = points if where is None else points.where(where)
    return rows.withColumn("score", F.round(cosines(query)(F.col(vector)), digits)).orderBy(F.desc_nulls_last("score"), id_).limit(k)


def top_k_by_group(points: DataFrame, query: Sequence[float], k: int, group: str, id_: str = "vec_id", vector: str = "embedding", digits: int = 4) -> DataFrame:
    scored = points.select(id_, group, F.round(cosines(query)(F.col(vector)), digits).alias("score"))
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("score"), id_)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best (id, score) of each of many queries, ties by id, of scores that come in parts: a task holds k rows a query and
    one part."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.queries = k, queries
        self.q, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        #: Of each query what a score must reach.
        self.floor = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(q):
            return
        q, ids, scores = np.concatenate((self.q, q)), np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        rank = np.arange(len(q)) - np.searchsorted(q, np.arange(self.queries))[q]
        full = rank == self.k - 1
        self.floor[q[full]] = scores[full]
        self.q, self.ids, self.scores = (x[rank < self.k] for x in (q, ids, scores))

    def batches(self, query_ids: pa.Array, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """query_id, id, score of what is kept."""
        for i in range(0, len(self.q), rows):
            part = slice(i, i + rows)
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(self.q[part])), pa.array(self.ids[part]), pa.array(self.scores[part])], ["query_id", "id", "score"])


def search_block(points: DataFrame, queries: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", block: int = 4096, cells: int = 1 << 20) -> DataFrame:
    """query_id, id, score, rank: the k points most alike to each query but itself. Queries go out in blocks of bounded
    size, each a scan that keeps k rows a task and query before anything shuffles; a task scores at most so many cells, points by
    queries, at a time."""
    spark = points.sparkSession
    rows = points.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    found = None
    it = queries.select(id_, vector).toLocalIterator()
    while chunk := [r for _, r in zip(range(block), it, strict=False)]:
        ids = np.array([r[0] for r in chunk], np.int64)
        asked = np.array([r[1] for r in chunk], float)
        asked /= np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)

        def score(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, matrix_: np.ndarray = asked) -> Iterator[pa.RecordBatch]:
            best, step = Best(len(ids), k), max(1, cells // len(ids))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    batch = whole.slice(at, step)
                    v, there = matrix(batch.column(1), matrix_.shape[1])
                    own = batch.column(0).to_numpy()[there]
                    s = np.round(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) @ matrix_.T, 4)
                    s[own[:, None] == ids[None, :]] = -np.inf
                    at_, q = np.nonzero((s >= best.floor) & np.isfinite(s))
                    best.add(q, own[at_], s[at_, q])
            yield from best.batches(pa.array(ids))

        part = rows.mapInArrow(score, "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "query_id long, id long, score double")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours(points: DataFrame, k: int, id_: str = "vec_id", vector: str = "embedding", block: int = 1 << 16, cells: int = 1 << 20) -> DataFrame:
    """search_block with every point as a query, none of them through the driver: points are dealt into blocks of about so many,
    and a group is a block of queries and one of points, of which k rows a query go on. All pairs are scored, so the
    work is the square of the points, and what shuffles the points times their blocks. Points without a vector of the
    table's width neither ask nor are found."""
    rows = points.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    many, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    slots = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-many // block), math.isqrt(slots), 1)  # groups enough for all slots
    own, other = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = rows.select(own.alias("i"), other.alias("j"), "id", "v")
    there = rows.select(other.alias("i"), own.alias("j"), "id", "v")

    def score(queries: pa.Table, found: pa.Table) -> pa.Table:
        (q, q_ids), (v, ids) = (_unit(t, width) for t in (queries, found))
        parts = []
        for at in range(0, len(q_ids), 4096):
            of, own = q[at : at + 4096], q_ids[at : at + 4096]
            best, step = Best(len(own), k), max(1, cells // max(1, len(own)))
            for a in range(0, len(ids), step):
                some = ids[a : a + step]
                s = np.round(v[a : a + step] @ of.T, 4)
                s[some[:, None] == own[None, :]] = -np.inf
                at_, who = np.nonzero((s >= best.floor) & np.isfinite(s))
                best.add(who, some[at_], s[at_, who])
            parts += best.batches(pa.array(own))
        return pa.Table.from_batches(parts, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))

    found = asked.groupBy("i", "j").cogroup(there.groupBy("i", "j")).applyInArrow(score, "query_id long, id long, score double")
    return _ranked(found, k)


def _unit(rows: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of norm one, and their ids, of the rows (id, v) whose vectors have the width."""
    v, there = matrix(rows.column("v").combine_chunks(), width)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300), rows.column("id").to_numpy()[there]


def by_id(points: DataFrame, wanted: DataFrame, id_: str = "id") -> DataFrame:
    """The wanted ids with their points, and point_not_found as error where there is none."""
    found = points.withColumn("there_", F.lit(True)).join(wanted.select(id_).distinct(), id_, "right")
    return found.withColumn("error", F.when(F.col("there_").isNull(), "point_not_found")).drop("there_")


def project(hits: DataFrame, id_: Column, user: Column, answer: Column, source: Column, *more: Column | str, conversation: Column | None = None) -> DataFrame:
    """The fields of a result, and more; its full context is there to be read where a source or a conversation is named."""
    full = x.first_filled(source, *([] if conversation is None else [conversation])).isNotNull()
    return hits.select(id_.cast("string").alias("point_id"), "score", F.substring(F.coalesce(user, F.lit("Unknown")), 1, x.RESULT_INPUT_CHARS).alias("user_input"), F.substring(F.coalesce(answer, F.lit("...")), 1, x.RESULT_RESPONSE_CHARS).alias("ai_response"), F.coalesce(source, F.lit("unknown")).alias("source_file"), x.source_label(source).alias("source_label"), full.alias("has_full_context"), *more)


def prompt(hits: DataFrame, title: str, persona: str, question: str, id_: str = "point_id") -> DataFrame:
    """One row: the prompt that hands the hits, best first, and the question to a persona."""
    block = F.concat(F.lit("[Relevance: "), F.format_string("%.2f", F.round(F.col("score"), 2)), F.lit("]\nUser: "), "user_input", F.lit(f"\n{persona}: "), "ai_response", F.lit("\n"))
    rows = hits.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col(id_).alias("i"), block.alias("b")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r["b"]), "\n")
    return rows.select(F.concat(F.lit(f"# {title}\n\n"), body, F.lit(f"\nCurrent query: {question}")).alias("prompt"))


def plain_prompt(memories: DataFrame, title: str, persona: str, question: str) -> DataFrame:
    """One row: the prompt of the command line, with memories (score, point_id, user_input, ai_response) whole, and
    listing, a line and an excerpt for each."""
    block = F.concat(F.lit("User: "), "user_input", F.lit(f"\n{persona}: "), "ai_response", F.lit("\n---\n"))
    line = F.concat(F.lit("[Score: "), F.format_string("%.2f", F.round(F.col("score"), 2)), F.lit(f"]\n{persona}: "), F.substring("ai_response", 1, x.EXCERPT_CHARS), F.lit("...\n"))
    rows = memories.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("point_id").alias("i"), block.alias("b"), line.alias("l")))).alias("rows"))
    join = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "")
    return rows.select(F.concat(F.lit(f"You are {title}. These are your memories:\n\n"), join("b"), F.lit(f"\nCurrent query: {question}")).alias("prompt"), join("l").alias("listing"))


def recall_at_k(neighbours: DataFrame, relevant: Column, k: int) -> DataFrame:
    """Share of queries with a relevant hit among the first k, and the mean share of relevant hits."""
    hits = neighbours.where(F.col("rank") <= k).groupBy("query_id").agg(F.max(relevant.cast("int")).alias("any"), F.avg(relevant.cast("double")).alias("share"))
    return hits.agg(F.round(F.avg("any"), 4).alias("recall"), F.round(F.avg("share"), 4).alias("precision"))


def ndcg(neighbours: DataFrame, gain: Column, k: int, relevant: DataFrame | None = None) -> DataFrame:
    """Mean over queries of gains discounted by rank over those of the best order: the gains found, sorted, or, where
    relevant (query_id, total) tells how many points are, gains of one at the first ranks of as many."""
    rows = neighbours.where(F.col("rank") <= k).select("query_id", gain.cast("double").alias("gain"), "rank")
    discounted = lambda g, at: g / F.log2(at + 1)
    by = rows.groupBy("query_id").agg(F.sum(discounted(F.col("gain"), F.col("rank"))).alias("dcg"), F.sort_array(F.collect_list("gain"), False).alias("best"))  # at most k
    if relevant is not None:
        by = by.join(relevant, "query_id").withColumn("best", F.array_repeat(F.lit(1.0), F.least(F.col("total"), F.lit(k)).cast("int")))
    ideal = F.aggregate(F.transform("best", lambda g, i: discounted(g, i + 1)), F.lit(0.0), lambda s, g: s + g)
    return by.agg(F.round(F.avg(F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0)), 4).alias("ndcg"))


def hybrid(points: DataFrame, query: Sequence[float], words: Sequence[str], k: int, keyword_weight: float = 0.3, id_: str = "vec_id", vector: str = "embedding", text: str = "text", digits: int = 4) -> DataFrame:
    """Cosine plus the weighted share of the query's words that the text holds: the k best, ties by id."""
    wanted = sorted({w.lower() for w in words})
    has = F.size(F.array_intersect(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), F.array(*map(F.lit, wanted)))) / F.lit(max(len(wanted), 1))
    score = F.round((1 - keyword_weight) * cosines(query)(F.col(vector)) + keyword_weight * has, digits)
    return points.withColumn("score", score).orderBy(F.desc_nulls_last("score"), id_).limit(k)
