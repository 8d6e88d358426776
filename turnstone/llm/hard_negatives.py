"""Hard-negative mining: for each anchor and positive, the best rows of other labels within a window of scores.

Scores are integer inner products. Method, one-dimensional distance keys:

1. Augmentation makes inner products distances: a row x becomes (x, sqrt(M - |x|^2)), M the largest squared norm, and an
   anchor q becomes (q, 0); then |q - x|^2 = |q|^2 + M - 2 q.x, so the best score is the nearest row.
2. Pivots are k-means centres of a bounded sample (SAMPLE rows of least hash). Every row gets the key (pivot, distance to
   it), its nearest pivot. Rows are stored sorted by key, in packed blocks, bucketed by cell: an interval of keys of one
   pivot. What the driver holds of the index are counts and bounds of PIVOTS x RINGS cells at most. A cell of more than
   CHUNK rows, such as that of a vector repeated a million times, is dealt into parts by id.
3. By the triangle inequality a row in an interval [a, b] of a pivot at distance D from the anchor is at least
   max(0, D - b, a - D) and at most D + b away. A search goes through the cells from the nearest bound on: the first round
   scans the annuli that hold SHARES[0] of all rows, the last all others, and each time only cells whose bounds allow a
   score of the window that is not under the k-th best found. What remains is certified not to matter. On
   data without structure bounds exclude little, and the last round is a full scan in blocks.
4. Anchors go out in blocks to the cells they want and meet the index in a co-located join; a matrix product scores a block
   against a block, and k rows a task and search remain before anything shuffles.

Two searches run so: the best rows of the anchor's label, then with their scores those of other labels.

Nulls and edge cases: rows with a null id or label, a vector that is null or of another length than most have, or any null or
non-finite component take no part. Ties go to the smaller id. Of anchors that repeat an id the one of least label and vector
counts; other repeated rows are rows of their own, and rows of the anchor's own id are never its positive or negative. A
positive score under 0 has an empty window. Components are clamped to 2^26 in magnitude, so scores are exact. Fewer rows
than asked for give as many as there are; an empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import settle, shared_folder, slots, stage, track
from .vectors import clean, floors, width_of

PIVOTS, SAMPLE, RINGS, STEPS = 64, 4096, 128, 8
#: Rows of a cell's part at most, and at least where there are enough tasks; rows of a packed block; anchors of one.
CHUNK, LEAST, BLOCK, ANCHORS = 1 << 16, 512, 4096, 512
#: Of all rows, the share that a search has looked at after each round unless bounds exclude them.
SHARES = (1 / 16, 1.0)

_LONG = np.iinfo(np.int64)


def _pack(rows: np.ndarray) -> bytes:
    """Two bytes a component where they suffice, else eight."""
    return rows.astype(np.int16 if not len(rows) or np.abs(rows).max() < 1 << 15 else np.int64).tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * width else np.int64).reshape(n, width)


def _stack(column: pa.Array, width: int) -> np.ndarray:
    """Packed rows, one a value, as longs."""
    return np.stack([_unpack(b, 1, width)[0] for b in column.to_pylist()]).astype(np.int64) if len(column) else np.zeros((0, width), np.int64)


def prepare(points: DataFrame, width: int, id_: str, label: str, vector: str) -> DataFrame:
    """id, label, v (packed) and norm (squared) of the rows that take part."""
    kind = points.select(F.col(f"`{label}`")).schema[0].dataType
    code = F.col(f"`{label}`").cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(F.col(f"`{label}`"))
    rows = points.where(F.col(f"`{id_}`").isNotNull() & F.col(f"`{label}`").isNotNull() & F.col(f"`{vector}`").isNotNull())
    rows = rows.select(F.col(f"`{id_}`").cast("long").alias("id"), code.alias("label"), F.col(f"`{vector}`").alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, own = clean(batch.column(2), width)
            whole = floors(values)
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([_pack(r) for r in whole], pa.binary()), pa.array((whole * whole).sum(axis=1))], ["id", "label", "v", "norm"])

    return rows.mapInArrow(packed, "id long, label long, v binary, norm long")


@dataclass
class Index:
    """Pivots, cells and the name of the table of blocks. Arrays have one entry a pivot or a cell, so their size is bounded."""

    width: int
    top: float  # M
    pivots: np.ndarray  # (pivot, width + 1)
    pivot: np.ndarray  # of each cell
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    parts: np.ndarray
    table: str

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor and cell the least distance, and the greatest and least score that a row may have."""
        own = (asked * asked).sum(axis=1, dtype=float)
        squared = own[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * asked.astype(float) @ self.pivots[:, :-1].T
        at = np.sqrt(np.maximum(squared, 0))[:, self.pivot]
        slack = 1e-6 * np.sqrt(self.top + own)[:, None] + 1e-6
        near = np.maximum(np.maximum(at - self.high, self.low - at) - slack, 0)
        far = at + self.high + slack
        half = lambda d: (own[:, None] + self.top - d * d) / 2
        return near, half(near), half(far)

    def wanted(self, asked: np.ndarray, low: np.ndarray, high: np.ndarray, share: tuple[float, float]) -> np.ndarray:
        """Anchor by cell: whether the cell lies between the two shares of all rows, the nearest first, and may hold a score
        from low to high of one of the anchor's windows."""
        near, most, least = self.bounds(asked)
        order = np.argsort(near, axis=1, kind="stable")
        before = np.empty(near.shape)
        counts = self.rows[order]
        np.put_along_axis(before, order, np.cumsum(counts, axis=1) - counts, axis=1)
        total = self.rows.sum()
        here = (before >= share[0] * total) & (before < share[1] * total)
        fits = np.zeros(near.shape, bool)
        for w in range(low.shape[1]):
            fits |= (most >= low[:, w, None]) & (least <= high[:, w, None]) & (low[:, w] <= high[:, w])[:, None]
        return here & fits


def _pivots(sample: np.ndarray) -> np.ndarray:
    """k-means centres of augmented rows; the first rows of the sample, which is in random order, begin."""
    centres = np.unique(sample[:PIVOTS], axis=0)
    for _ in range(STEPS):
        near = (sample @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def build(rows: DataFrame, width: int) -> Index | None:
    """The index of prepared, staged rows; None where there is none."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v", "norm").collect()
    if not first:
        return None
    total, top = rows.agg(F.count("*"), F.max("norm")).first()
    sample = np.stack([_unpack(r.v, 1, width)[0] for r in first]).astype(float)
    sample = np.c_[sample, np.sqrt(top - np.array([r.norm for r in first], float))]
    pivots = _pivots(sample)
    half = (pivots**2).sum(axis=1) / 2

    def key(x: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = np.c_[x, np.sqrt(np.maximum(top - norm, 0))] @ pivots.T - half
        at = p.argmax(axis=1)
        return at, np.sqrt(np.maximum(top - 2 * p[np.arange(len(at)), at], 0))

    edges = np.unique(np.quantile(key(sample[:, :-1], np.array([r.norm for r in first], float))[1], np.linspace(0, 1, RINGS + 1)[1:-1]))

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                pivot, d = key(_stack(batch.column(0), width), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(pivot), pa.array(np.searchsorted(edges, d)), pa.array(d)], ["pivot", "ring", "d"])

    found = rows.select("v", "norm").mapInArrow(rings, "pivot long, ring long, d double").groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    chunk = min(CHUNK, max(LEAST, total // (4 * slots(spark))))
    cells: list[list] = []  # pivot, low, high, rows
    cell_of = np.zeros((len(pivots), len(edges) + 1), np.int64)
    for r in sorted(found.collect(), key=lambda r: (r.pivot, r.ring)):  # PIVOTS x RINGS rows at most
        if cells and cells[-1][0] == r.pivot and cells[-1][3] + r.n <= chunk:
            cells[-1][2], cells[-1][3] = r.high, cells[-1][3] + r.n
        else:
            cells.append([r.pivot, r.low, r.high, r.n])
        cell_of[r.pivot, r.ring] = len(cells) - 1
    pivot, low, high, n = (np.array(c) for c in zip(*cells, strict=True))
    parts = -(-n // chunk)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d = key(_stack(batch.column(2), width), batch.column(3).to_numpy())
                cell = cell_of[at, np.searchsorted(edges, d)]
                part = (batch.column(4).to_numpy() >> 1 & 0x7FFFFFFF) % parts[cell]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part), pa.array(d), *batch.columns[:3]], ["cell", "part", "d", "id", "label", "v"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal (cell, part) in packed blocks."""
        held: list[pa.RecordBatch] = []

        def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows).combine_chunks()
            ids, labels, v = (t.column(c).combine_chunks() for c in ("id", "label", "v"))
            return pa.RecordBatch.from_arrays([t["cell"].slice(0, 1).combine_chunks(), t["part"].slice(0, 1).combine_chunks(), *(pa.array([x.to_numpy().astype(np.int64).tobytes()], pa.binary()) for x in (ids, labels)), pa.array([_pack(_stack(v, width))], pa.binary())], ["cell", "part", "ids", "labels", "vectors"])

        count, now = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.c_[batch.column(0).to_numpy(), batch.column(1).to_numpy()]
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if now != tuple(keys[a]):
                    if held:
                        yield out(held)
                    held, count, now = [], 0, tuple(keys[a])
                while a < b:
                    step = min(b - a, BLOCK - count)
                    held.append(batch.slice(a, step))
                    a, count = a + step, count + step
                    if count == BLOCK:
                        yield out(held)
                        held, count = [], 0
        if held:
            yield out(held)

    keyed = rows.select("id", "label", "v", "norm", F.xxhash64("id", "v").alias("h")).mapInArrow(dealt, "cell long, part long, d double, id long, label long, v binary")
    stored = keyed.repartition(slots(spark), "cell", "part").sortWithinPartitions("cell", "part", "d", "id").mapInArrow(blocks, "cell long, part long, ids binary, labels binary, vectors binary")
    name = f"turnstone_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    track(spark, path)
    # one file a bucket, as rows are dealt by the buckets' own hash
    stored.write.bucketBy(slots(spark), "cell", "part").sortBy("cell", "part").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return Index(width, float(top), pivots, pivot.astype(int), low, high, n, parts, name)


def _asked(index: Index, searches: DataFrame, share: tuple[float, float]) -> DataFrame:
    """Blocks of anchors for the cells that they want. searches: id, label, v, low, high (arrays, a window each)."""
    width = index.width

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ANCHORS):
                batch = whole.slice(at, ANCHORS)
                ids, labels = (batch.column(i).to_numpy() for i in (0, 1))
                v = _stack(batch.column(2), width)
                low, high = (np.stack(batch.column(i).to_pylist()).astype(np.int64) for i in (3, 4))
                want = np.concatenate([index.wanted(v[i : i + 64], low[i : i + 64].astype(float), high[i : i + 64].astype(float), share) for i in range(0, len(v), 64)])
                for cell in np.flatnonzero(want.any(axis=0)):
                    own = want[:, cell]
                    n = int(index.parts[cell])
                    data = [x.tobytes() for x in (ids[own], labels[own])] + [_pack(v[own])] + [x[own].tobytes() for x in (low, high)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, cell)), pa.array(np.arange(n)), *(pa.array([d] * n, pa.binary()) for d in data)], ["cell", "part", "q_ids", "q_labels", "q_vectors", "q_low", "q_high"])

    return searches.select("id", "label", "v", "low", "high").mapInArrow(out, "cell long, part long, q_ids binary, q_labels binary, q_vectors binary, q_low binary, q_high binary")


def best(scores: np.ndarray, ids: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each column where may is set, ties by smaller id."""
    n = len(ids)
    place = np.empty(n, np.int64)
    place[np.argsort(ids, kind="stable")] = np.arange(n)[::-1]
    if float(np.abs(scores).max(initial=0)) * n < 2.0**52:  # score and place in one exact number
        order = np.where(may, scores * n + place[:, None], -np.inf)
        rows = np.argpartition(-order, k - 1, axis=0)[:k] if k < n else np.broadcast_to(np.arange(n)[:, None], order.shape)
        row, column = rows.ravel(), np.tile(np.arange(scores.shape[1]), len(rows))
        own = may[row, column]
        return row[own], column[own]
    row, column = np.nonzero(may)
    order = np.lexsort((-place[row], -scores[row, column], column))
    row, column = row[order], column[order]
    starts = np.searchsorted(column, np.arange(scores.shape[1]))
    own = np.arange(len(row)) - starts[column] < k
    return row[own], column[own]


def search(index: Index, searches: DataFrame, k: int, same: bool) -> DataFrame:
    """anchor, slot, id, score, rank: for each anchor and window (slot) the k best rows of its label (same) or of others."""
    width = index.width

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}  # of an anchor and each window, a score that k rows of this task reach
        for batch in batches:
            for ids, labels, v, q_ids, q_labels, q_v, q_low, q_high in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "vectors", "q_ids", "q_labels", "q_vectors", "q_low", "q_high")), strict=True):
                ids, labels, q_ids, q_labels = (np.frombuffer(x, np.int64) for x in (ids, labels, q_ids, q_labels))
                x, y = _unpack(v, len(ids), width), _unpack(q_v, len(q_ids), width)
                low, high = (np.frombuffer(b, np.int64).reshape(len(q_ids), -1) for b in (q_low, q_high))
                exact = float(np.abs(x.astype(np.int64)).max()) * float(np.abs(y.astype(np.int64)).max()) * width < 2.0**52
                scores = (x.astype(float) @ y.astype(float).T) if exact else x.astype(np.int64) @ y.astype(np.int64).T
                fits = (labels[:, None] == q_labels) == same
                fits &= ids[:, None] != q_ids
                floor = np.stack([np.maximum(known[q], lo) if q in known else lo for q, lo in zip(q_ids.tolist(), low, strict=True)])
                for slot in range(low.shape[1]):
                    row, column = best(scores, ids, fits & (scores >= floor[:, slot]) & (scores <= high[:, slot]), k)
                    if not len(row):
                        continue
                    s = scores[row, column].astype(np.int64)
                    full = np.bincount(column, minlength=len(q_ids)) >= k
                    least = np.full(len(q_ids), _LONG.max)
                    np.minimum.at(least, column, s)
                    floor[full, slot] = np.maximum(floor[full, slot], least[full])
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[column]), pa.array(np.full(len(row), slot)), pa.array(ids[row]), pa.array(s)], ["anchor", "slot", "id", "score"])
                if len(known) > 200_000:
                    known.clear()
                known.update(zip(q_ids.tolist(), floor, strict=True))

    found, left = None, 0.0
    for share in SHARES:
        asked = _asked(index, searches, (left, share))
        pairs = asked.hint("merge").join(searches.sparkSession.table(index.table), ["cell", "part"])
        new = pairs.mapInArrow(scored, "anchor long, slot long, id long, score long")
        w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
        merged = new if found is None else new.unionByName(found.drop("rank"))
        found, left = stage(merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)), share
        # the next round has to reach what is found already
        reached = found.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
        searches = searches.drop("reached").join(reached.withColumnRenamed("anchor", "id"), "id", "left")
        at = lambda lo, i: F.coalesce(F.greatest(lo, F.element_at("reached", i.cast("long"))), lo)
        searches = stage(searches.withColumn("low", F.transform("low", at)).drop("reached"))
    return found


def mine(points: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), id_: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. anchors tells which ids (column id) are. A
    negative scores from low to high times the positive's score, exactly."""
    spark = points.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = width_of(points, vector)
    if not width:
        return empty
    rows = stage(prepare(points, width, id_, label, vector))
    index = build(rows, width)
    if index is None:
        return empty
    try:
        own = rows.where(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
        any_ = own.select("*", F.array(F.lit(int(_LONG.min))).alias("low"), F.array(F.lit(int(_LONG.max))).alias("high"))
        best_same = search(index, stage(any_), positives, True)
        floor = lambda x, n, d: F.call_function("div", x * n - F.pmod(x * n, F.lit(d).cast("long")), F.lit(d).cast("long"))
        least, most = -floor(-F.col("score"), *low), floor(F.col("score"), *high)
        windows = best_same.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", least.alias("low"), most.alias("high")))).alias("w"))  # positives at most
        padded = lambda c, v: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("w", i)[c], F.lit(v).cast("long")))
        searches = own.join(windows, own["id"] == windows["anchor"]).select("id", "label", "v", padded("low", 1).alias("low"), padded("high", 0).alias("high"))
        others = search(index, stage(searches), negatives, False)
        pairs = best_same.select("anchor", (F.col("rank") - 1).cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        return stage(others.join(pairs, ["anchor", "slot"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {index.table}")


def relabelled(points: DataFrame) -> DataFrame:
    """The query's labels: those of ids divisible by 7 go up by one, modulo 10."""
    return points.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    points = relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return settle(lambda: mine(points, F.col("id") % 100 == 0))


ORACLE = """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, e.vec_id AS b, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER w)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) QUALIFY row_number() OVER w <= 10
"""
