"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the words of all documents; a source's
target stops at EPOCHS times its words and the excess goes to the others by weight, until none is above (water filling,
in closed form: sources sorted by cap over weight are capped as long as the level of the rest is above theirs).
A target is first filled with complete epochs over the source; what is left is a budget for a weighted sample without
replacement: each document draws the key -ln(u) / quality, documents are sorted by key, and the sorted sizes are
prefix-summed to the budget; the document at the bound is in if more of it lies below than above.

No source is sorted in one task: keys fall into BINS, bins are summed with partial sums, and only the documents of the
bin that holds the bound are sorted. A bin is a step of 1 - exp(-LEAST_QUALITY * key), so whatever a source's qualities,
no bin draws more than 1 in BINS * LEAST_QUALITY of its documents (1,638). u is a hash of SEED and doc_id, so reruns agree.

Quality is 1 minus SYMBOL_WEIGHT times the share of symbol characters, at least LEAST_QUALITY.

Nulls and edge cases: null text has size 0 and is never taken; null sources are a source of their own, last; a null
doc_id draws by its text; repeated rows are documents each (equal keys; equal sizes make them exchangeable);
extra columns stay, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, columns_of, fresh, settle, stage

EPOCHS = 3
WEIGHTS = (1, 2, 3)
BINS = 8192
SEED = "mix-1"
SYMBOL_WEIGHT, LEAST_QUALITY = 5, 0.2
# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _key(doc_id, text, quality):
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), own)), 1, 13), 16, 10).cast("double") + 1) / float((1 << 52) + 1)
    return -F.log(u) / quality


def targets(sizes: DataFrame) -> DataFrame:
    """m_source, source_size -> and weight, target. One row a source, so a window over all of them is small."""
    ordered = Window.orderBy(F.col("m_source").asc_nulls_last())
    weighed = sizes.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in WEIGHTS)), ((F.row_number().over(ordered) - 1) % len(WEIGHTS) + 1).cast("int")))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("m_source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    filled = weighed.withColumn("left", F.sum("source_size").over(every) - EPOCHS * F.coalesce(F.sum("source_size").over(before), F.lit(0).cast("long")))
    filled = filled.withColumn("weights", F.sum("weight").over(rest))
    capped = EPOCHS * F.col("source_size") * F.col("weights") <= F.col("left") * F.col("weight")
    # the level is that of the first source that is not capped
    first = F.min(F.when(~capped, F.struct(F.col("source_size") / F.col("weight"), F.col("weights"), F.col("left")))).over(every)
    filled = filled.withColumn("capped", capped).withColumn("level", first)
    return filled.select("m_source", "source_size", F.when(F.col("capped"), (EPOCHS * F.col("source_size")).cast("double")).otherwise((F.col("level.left") * F.col("weight")).cast("double") / F.col("level.weights").cast("double")).alias("target"))


def mix(docs: DataFrame, slim: bool = False, p: str = "m_") -> DataFrame:
    """docs with columns p + size, source_size, target, times (how often a document is taken); slim: without text. No
    column of docs may begin with p."""
    if fresh(docs.columns, p) != p:
        raise ValueError(f"a column begins with {p}")
    text = F.col("text").cast("string")
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    quality = F.greatest(F.lit(LEAST_QUALITY), 1 - F.lit(float(SYMBOL_WEIGHT)) * F.coalesce(symbols / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)))
    size, key, bin_ = (f"{p}{c}" for c in ("size", "key", "bin"))
    drawn = docs.select("*", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias(size), _key(F.col("doc_id"), text, quality).alias(key))
    drawn = drawn.withColumn(bin_, F.least(F.floor((1 - F.exp(-LEAST_QUALITY * F.col(key))) * BINS), F.lit(BINS - 1)).cast("int")).drop(*["text"] * slim)
    drawn = stage(drawn)

    bins = drawn.groupBy(F.col("source").alias("m_source"), F.col(bin_).alias("m_bin")).agg(F.sum(size).alias("words"))
    plan = targets(bins.groupBy("m_source").agg(F.sum("words").alias("source_size")))
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("m_source").orderBy("m_bin").rowsBetween(Window.unboundedPreceding, 0)
    ends = bins.withColumn("end", F.sum("words").over(upto)).join(plan.withColumnRenamed("m_source", "s"), F.col("m_source").eqNullSafe(F.col("s"))).drop("s")
    # the first bin that ends beyond the budget holds the bound; the bins before it are in, those after it out
    bound = ends.where(F.col("end") > F.col("budget")).groupBy("m_source").agg(F.min(F.struct("m_bin", (F.col("end") - F.col("words")).alias("before"))).alias("at"))
    plan = plan.join(bound.withColumnRenamed("m_source", "b"), F.col("m_source").eqNullSafe(F.col("b")), "left")
    own = {"plan": F.col("m_source"), "source_size": F.col("source_size"), "target": F.col("target"), "epochs": F.col("epochs"), "budget": F.col("budget"), "bound": F.coalesce("at.m_bin", F.lit(BINS)), "before": F.col("at.before")}
    plan = stage(plan.select(*(x.alias(f"{p}{c}") for c, x in own.items())))

    known = drawn.join(plan, F.col("source").eqNullSafe(F.col(f"{p}plan"))).drop(f"{p}plan")
    inside = known.where(F.col(bin_) == F.col(f"{p}bound"))
    above = Window.partitionBy("source").orderBy(key, F.col("doc_id").asc_nulls_first(), size).rowsBetween(Window.unboundedPreceding, 0)
    taken = 2 * (F.col(f"{p}before") + F.sum(size).over(above)) - F.col(size) <= 2 * F.col(f"{p}budget")
    decided = known.where(F.col(bin_) != F.col(f"{p}bound")).withColumn(f"{p}in", F.col(bin_) < F.col(f"{p}bound"))
    out = decided.unionByName(inside.withColumn(f"{p}in", taken))
    return out.withColumn(f"{p}times", F.when(F.col(size) > 0, F.col(f"{p}epochs") + F.col(f"{p}in").cast("long")).otherwise(0))


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return settle(lambda: mix(docs, slim=True).select("doc_id", F.col("m_size").alias("size"), F.col("m_source_size").cast("long").alias("source_size"), F.col("m_target").alias("target"), (F.col("m_size") * F.col("m_times")).cast("long").alias("taken")))


def repeat_taken(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: a row for each time, none for those left out; columns as they are."""
    p = fresh(docs.columns, "m_")
    times = f"{p}times"
    return mix(docs, p=p).where(f"{times} > 0").withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(columns_of(docs))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    greatest({LEAST_QUALITY}::DOUBLE, 1 - {SYMBOL_WEIGHT}::DOUBLE * coalesce((length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(length(text), 1), 0)) AS quality,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '|' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 1) / {float((1 << 52) + 1)!r}::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () - {EPOCHS} * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
c AS (SELECT *, {EPOCHS} * source_size * weights <= rest * weight AS capped FROM f),
l AS (SELECT rest AS level_rest, weights AS level_weights FROM c WHERE NOT capped ORDER BY source_size::DOUBLE / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN ({EPOCHS} * source_size)::DOUBLE ELSE (level_rest * weight)::DOUBLE / level_weights::DOUBLE END AS target FROM c LEFT JOIN l ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.quality, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN 2 * upto - size <= 2 * budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""
