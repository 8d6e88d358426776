"""Vector code compression: product codes of integer vectors, assigned by partial-distance search.

A vector is floored to integers and cut into consecutive parts; each part position has a codebook, and a part's code is its
nearest entry. fit() runs Lloyd rounds: tasks assign their rows and pre-sum them by (part, entry, position), so a round
shuffles one row for each of these and task, and what reaches the driver is PARTS x ENTRIES entries at most, whatever the
input. encode() assigns once more. No row shuffles in either.

Partial-distance search (nearest): a row's best complete distance begins with the entry nearest in the first dimension.
Dimensions go by descending variance of the codebook. Entries come in blocks; within a block every (row, entry) pair that is
left accumulates the next dimension's squared difference, and a vectorised mask drops pairs whose accumulated distance
strictly exceeds the row's best complete one. Pairs that live to the last dimension are complete and lower it for the next
block. Equal distances go to the lower index, and as only strictly greater ones drop, the result is that of a full search.

Nulls and edge cases: rows whose vector is null, empty, of another length than most vectors have, or holds null or
non-finite components are dropped. Components are clamped to 2^26 in magnitude, so distances are exact. Ties go to the lower
entry. Equal smallest ids are taken in the order of their vectors. Repeated rows count each. A null label is a label of its
own; a null vec_id sorts last. Where fewer rows than ENTRIES are kept, the codebooks are as short; where the width is
no multiple of parts, parts differ by one component in length. Extra columns are ignored; an empty table gives an empty
result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle, stage
from .vectors import clean, floors, width_of

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries that are compared before the best distance is lowered.
BLOCK = 16


@dataclass
class Codebooks:
    """entries: one integer matrix (entry, position) for each part."""

    width: int
    entries: list[np.ndarray]

    def cuts(self) -> list[int]:
        return [i * self.width // len(self.entries) for i in range(len(self.entries) + 1)]

    def sha256(self) -> str:
        """Of all components in decimal by part, entry, position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for book in self.entries for v in book.ravel().tolist()).encode()).hexdigest()

    def decode(self, code: bytes) -> np.ndarray:
        """The vector that a code stands for, in the floats' scale (the middle of each integer's range)."""
        return (np.concatenate([book[i] for book, i in zip(self.entries, code, strict=True)]) + 0.5) / 256


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the index of the nearest entry and the squared distance."""
    if not rows.shape[1]:
        return np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    order = np.argsort(-book.var(axis=0), kind="stable")
    lead = order[0]
    at = np.abs(rows[:, lead, None] - book[None, :, lead]).argmin(axis=1)
    best = ((rows - book[at]) ** 2).sum(axis=1)
    for low in range(0, len(book), BLOCK):
        block = book[low : low + BLOCK]
        first = (rows[:, lead, None] - block[None, :, lead]) ** 2
        row, entry = np.nonzero(first <= best[:, None])
        sums = first[row, entry]
        for dim in order[1:]:
            sums = sums + (rows[row, dim] - block[entry, dim]) ** 2
            left = sums <= best[row]
            row, entry, sums = row[left], entry[left], sums[left]
        if not len(row):
            continue
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(sums, starts)
        # the first of a row's pairs with the least distance has the lowest index
        hit = np.flatnonzero(sums == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        r, e, d = row[hit], entry[hit] + low, sums[hit]
        better = (d < best[r]) | (e < at[r])  # d is at most best[r]
        at[r[better]], best[r[better]] = e[better], d[better]
    return at, best


def assign(rows: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, part) and squared distances summed over parts."""
    cuts = books.cuts()
    codes, error = np.zeros((len(rows), len(books.entries)), np.int64), np.zeros(len(rows), np.int64)
    for p, book in enumerate(books.entries):
        codes[:, p], d = nearest(rows[:, cuts[p] : cuts[p + 1]], book)
        error += d
    return codes, error


def fit(points: DataFrame, id_: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks that begin with the kept rows of smallest ids and are refined over all rows; None where no row is kept."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    width = width_of(points, vector)
    if not width:
        return None
    rows = points.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{vector}`").alias("v"))
    usable = F.size("v") == width
    usable &= ~F.exists("v", lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    first = rows.where(usable).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # entries rows at most
    if not first:
        return None
    vectors = floors(np.array([r.v for r in first], float))
    cuts = [i * width // parts for i in range(parts + 1)]
    books = Codebooks(width, [vectors[:, a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
    for _ in range(rounds):
        books = _refined(rows.select("v"), books)
    return books


def _refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One Lloyd round: every entry becomes the floored mean of the parts assigned to it."""
    cuts, size = books.cuts(), len(books.entries[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((size, books.width), np.int64), np.zeros((size, len(books.entries)), np.int64)
        for batch in batches:
            values, _ = clean(batch.column(0), books.width)
            whole = floors(values)
            codes, _ = assign(whole, books)
            for p in range(len(books.entries)):
                np.add.at(total[:, cuts[p] : cuts[p + 1]], codes[:, p], whole[:, cuts[p] : cuts[p + 1]])
                count[:, p] += np.bincount(codes[:, p], minlength=size)
        part = np.repeat(np.arange(len(books.entries)), np.diff(cuts))
        entry, place = np.nonzero(count[:, part])
        if len(entry):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (entry, place, total[entry, place], count[entry, part[place]])], ["entry", "place", "total", "n"])

    parts = rows.mapInArrow(sums, "entry long, place long, total long, n long").groupBy("entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = [book.copy() for book in books.entries]
    part = np.repeat(np.arange(len(out)), np.diff(cuts))
    for r in parts.collect():  # entries x width rows at most
        out[part[r.place]][r.entry, r.place - cuts[part[r.place]]] = r.total // r.n
    return Codebooks(books.width, out)


def encode(points: DataFrame, books: Codebooks, *keep: str, vector: str = "embedding") -> DataFrame:
    """The kept columns with code (one byte a part) and error of every row that takes part."""
    columns = points.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{vector}`").alias("v_"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = clean(batch.column(batch.num_columns - 1), books.width)
            if not len(rows):
                continue
            code, error = assign(floors(values), books)
            bytes_ = code.astype(np.uint8).tobytes()
            parts = code.shape[1]
            own = [pa.array([bytes_[i : i + parts] for i in range(0, len(bytes_), parts)], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(rows)) for i in range(batch.num_columns - 1)), *own], [*keep, "code", "error"])

    kinds = points.select(*(F.col(f"`{c}`") for c in keep)).schema
    return columns.mapInArrow(codes, kinds.add("code", "binary").add("error", "long"))


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error: error summed over the rows of equal label, nulls together. Sums are pre-aggregated, and a hot
    label's rows get theirs by broadcast."""
    own = {"k_null": F.col(label).isNull(), "k_label": F.coalesce(F.col(label).cast("string"), F.lit(""))}
    sums = coded.groupBy(*(c.alias(k) for k, c in own.items())).agg(F.sum("error").alias("label_error"), F.count("*").alias("k_rows"))
    return lookup(coded.withColumns(own), sums, list(own), "k_rows").drop("k_rows", *own)


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Every kept vector's code and error, its label's error, and the codebooks' digest."""
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")

    def made() -> DataFrame:
        books = fit(points)
        if books is None:
            return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
        coded = with_label_error(stage(encode(points, books, "vec_id", "label")))
        return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

    return settle(made)


def _oracle() -> str:
    """Two Lloyd rounds unrolled."""
    near = "SELECT vec_id, label, part, s, (d % 64)::INT AS entry, d // 64 AS d FROM (SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.s) AS s, min(list_sum(list_transform(list_zip(p.s, b.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + b.entry) AS d FROM parts p JOIN {book} b ON p.part = b.part GROUP BY p.vec_id, p.part)"
    means = "SELECT part, entry, list(m ORDER BY place) AS s FROM (SELECT part, entry, place, floor(sum(s[place])::DOUBLE / count(*))::BIGINT AS m FROM {near}, (SELECT unnest(range(1, w // 16 + 1)) AS place FROM wide) GROUP BY part, entry, place) GROUP BY part, entry"
    book = "SELECT b.part, b.entry, coalesce(m.s, b.s) AS s FROM {book} b LEFT JOIN ({means}) m USING (part, entry)"
    steps, books = [], "book0"
    for n in range(ROUNDS):
        steps += [f"near{n} AS MATERIALIZED ({near.format(book=books)})", f"book{n + 1} AS MATERIALIZED ({book.format(book=books, means=means.format(near=f'near{n}'))})"]
        books = f"book{n + 1}"
    return f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
wide AS (SELECT max(len(v)) AS w FROM kept),
parts AS MATERIALIZED (SELECT vec_id, label, p AS part, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS s FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (SELECT part, entry, s FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) USING (vec_id)),
{', '.join(steps)},
final AS MATERIALIZED ({near.format(book=books)}),
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {books})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""


ORACLE = _oracle()
