"""Exact dedup in two passes over a Bloom filter, with DataFrame functions alone.

Pass 1 hashes every text and sets PROBES bits for each; a bit that two rows or more set goes into a bitmap (rows
of 32768 bits). What shuffles here is each row's places, as numbers, and neither texts nor hashes; a hot text's places
collapse in the partial counts. A place set by two rows of different partitions is in neither's own bitmap, so bitmaps
of partitions alone, combined by OR, could not tell such bits. Pass 2 tests every row's bits: a row with a bit that no
other row set is alone and passes straight through; only the rows that pass the test shuffle, are grouped by the SHA-256
of their whole text and decided, a hot group's rows by broadcast of its verdict. False positives of the filter are
groups of one, so the result is exact.

The bitmap has BITS_A_ROW bits a row, rounded up to a power of two, so at most one in 16 unique rows is a false positive
as long as it stays under MOST_BITS; beyond that the filter is less sharp, never wrong. Its size is proven: bits / 8
bytes. Up to BROADCAST_BITS (128 MB, 67 million rows) it is broadcast; beyond that rows meet it in a join by its row
number, and then they shuffle too.

Texts are equal when they are identical after deleting white space ([\\x20\\x09-\\x0D]). Of equal texts the row with the
most code points stays, then the smallest doc_id (null ids last), then the first read of repeated rows.

Nulls and edge cases: null text counts as empty, and empty texts are equal to each other; a null doc_id keeps its row;
extra columns stay; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, columns_of, fresh, lookup, settle, stage

PROBES = 2
BITS_A_ROW = 16
ROW_BITS = 32768
MOST_BITS, BROADCAST_BITS = 1 << 36, 1 << 30


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def with_hash(docs: DataFrame, p: str = "x_") -> DataFrame:
    """docs with p + sha and p + chars."""
    return docs.select("*", F.sha2(F.regexp_replace(_text(), f"{SPACE_CLASS}+", "").cast("binary"), 256).alias(f"{p}sha"), F.length(_text()).alias(f"{p}chars"))


def _place(sha: str, probe: int, bits: int) -> Column:
    """The bit that a probe sets: 60 bits of the hash for each."""
    return F.pmod(F.conv(F.substring(sha, 1 + 15 * probe, 15), 16, 10).cast("long"), F.lit(bits))


def bits_for(rows: int) -> int:
    return min(MOST_BITS, max(ROW_BITS, 1 << max(1, rows * BITS_A_ROW - 1).bit_length()))


def shared_bits(hashed: DataFrame, sha: str, bits: int) -> DataFrame:
    """row, bitmap: the places that more than one row's probes hit."""
    places = hashed.select(F.explode(F.array_distinct(F.array(*(_place(sha, n, bits) for n in range(PROBES))))).alias("place"))
    twice = places.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    # the SQL functions number rows from 1 and places within them from 0
    return twice.select(F.expr("bitmap_bucket_number(place)").alias("row"), F.expr("bitmap_bit_position(place)").alias("bit")).groupBy("row").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def suspects(hashed: DataFrame, hashes: DataFrame, p: str = "x_") -> DataFrame:
    """hashed with p + maybe: whether the filter of hashes (staged, p + sha) holds all bits of a row."""
    bits = bits_for(hashes.count())
    bitmap = stage(shared_bits(hashes, f"{p}sha", bits))
    out = hashed.withColumn(f"{p}maybe", F.lit(True))
    for n in range(PROBES):
        row, bit, map_ = f"{p}row", f"{p}bit", f"{p}map"
        own = bitmap.select(F.col("row").alias(row), F.col("bitmap").alias(map_))
        place = _place(f"{p}sha", n, bits)
        out = out.withColumn(row, F.call_function("bitmap_bucket_number", place)).withColumn(bit, F.call_function("bitmap_bit_position", place))
        out = out.join(F.broadcast(own) if bits <= BROADCAST_BITS else own, row, "left")
        byte = F.conv(F.hex(F.substring(F.col(map_), (F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), F.col(bit) % 8).cast("int")) > 0, F.lit(False))
        out = out.withColumn(f"{p}maybe", F.col(f"{p}maybe") & hit).drop(row, bit, map_)
    return out


def decide(docs: DataFrame, p: str = "x_", texts: bool = True) -> DataFrame:
    """docs (without text where texts are not wanted) with p + sha, keep_id, size (rows of equal text) and kept. No
    column of docs may begin with p."""
    if fresh(docs.columns, p) != p:
        raise ValueError(f"a column begins with {p}")
    # without texts, both passes and the decision read a staged table; with texts, staging them would cost as much disk as
    # they take, so pass 1 stages the hashes alone and pass 2 hashes again
    hashed = with_hash(docs, p) if texts else stage(with_hash(docs, p).drop("text"))
    found = suspects(hashed, stage(hashed.select(f"{p}sha")) if texts else hashed, p)
    alone = found.where(~F.col(f"{p}maybe")).withColumns({f"{p}keep_id": F.col("doc_id"), f"{p}size": F.lit(1).cast("long"), f"{p}kept": F.lit(True)})
    maybe = stage(found.where(f"{p}maybe").withColumn(f"{p}rid", F.monotonically_increasing_id()))
    best = F.struct((-F.col(f"{p}chars")).alias("c"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(f"{p}rid").alias("r"))
    groups = maybe.groupBy(f"{p}sha").agg(F.min(best).alias(f"{p}best"), F.count("*").alias(f"{p}size"))
    told = lookup(maybe, groups, [f"{p}sha"], f"{p}size").withColumns({f"{p}keep_id": F.col(f"{p}best.d"), f"{p}kept": F.col(f"{p}rid") == F.col(f"{p}best.r")})
    inner = [f"{p}{c}" for c in ("maybe", "chars", "rid", "best")]
    return alone.drop(*inner).unionByName(told.drop(*inner))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, columns as they are."""
    p = fresh(docs.columns, "x_")
    return decide(docs, p).where(f"{p}kept").select(columns_of(docs))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the copy of it that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return settle(lambda: decide(docs, texts=False).select("doc_id", F.col("x_keep_id").alias("keep_id"), F.col("x_size").alias("group_size"), F.col("x_kept").alias("kept"), F.col("x_sha").alias("text_sha256")))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS sha FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY sha) AS n
  FROM d WINDOW w AS (PARTITION BY sha ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, n::BIGINT AS group_size, rn = 1 AS kept, sha AS text_sha256 FROM k
"""
