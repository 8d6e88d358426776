"""From documents to packed training sequences: toxic documents go, exact copies go, of near copies one stays, sources
are mixed to their targets, and what the mix takes is packed.

A stage is (spark, docs, sf_dir) -> DataFrame. run() writes each stage's result as Parquet to the shared folder and reads
it back as the next one's docs; what a stage stages on its way goes when its result is there, and a result goes when the
next one is. All but the last return the columns of documents, whatever others there are; a document that the mix takes
twice stands in its result twice.

Nulls and edge cases, in every stage: a null or empty text is not toxic, is one with all other empty ones, has no near copy
and no words, so the mix leaves it out; rows of a null doc_id go through the stages like others, and none is a near copy;
repeated rows are exact copies; ties go to the smaller doc_id; very long texts are read whole; without labels of both kinds
nothing is toxic; empty tables give an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnstone.llm import best_fit_packing, exact_dedup, jaccard_join, source_mixing, toxicity
from turnstone.llm.common import settle, unstage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model of the labelled ones calls toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return jaccard_join.keep_one_of_each(docs, k=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return source_mixing.repeat_taken(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    import public_tokenizers  # no other stage needs it

    return best_fit_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("source_mixing", mix_sources), ("packing", pack)]

#: A trained model and any numbers of sequences are not for SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, step in STAGES:
        docs = settle(lambda: step(spark, docs, sf_dir))  # noqa: B023
        if before is not None:
            unstage(before)
        before = docs
    return docs
