"""Sequences of turns: pairing, matching, context frames and indexes.

A conversation is a window partition; only its own turns meet in a task."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from turnstone.functions import text as x


def pair(turns: DataFrame, key: str, order: Sequence[str], role: str = "role", content: str = "text", asks: Sequence[str] = ("user",), answers: Sequence[str] = ("assistant",), only: Column | None = None, filled: bool = True) -> DataFrame:
    """Each asking turn whose next turn answers: key, order columns, user_text, assistant_text.

    only filters turns before adjacency, so what it drops no longer separates a pair; filled drops pairs with an empty side."""
    rows = turns if only is None else turns.where(only)
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.select(key, *order, F.col(role).alias("r"), F.col(content).alias("user_text"), F.lead(role).over(w).alias("next_r"), F.lead(content).over(w).alias("assistant_text"))
    rows = rows.where(F.col("r").isin(*asks) & F.col("next_r").isin(*answers)).drop("r", "next_r")
    return rows.where("user_text <> '' and assistant_text <> ''") if filled else rows


def long_enough(pairs: DataFrame, chars: int = x.MIN_RESPONSE_CHARS) -> DataFrame:
    return pairs.where(F.length("assistant_text") >= chars)


def chronological(turns: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """Adds index: by time, null as 0, ties in the given order."""
    w = Window.partitionBy(key).orderBy(F.coalesce(F.col(time), F.lit(0.0)), tie)
    return turns.withColumn("index", F.row_number().over(w) - 1)


def match_exact(turns: DataFrame, key: str, index: str, needle: str, content: str = "text") -> DataFrame:
    """The first turn of each conversation that contains the needle's head, ignoring case; null where none does."""
    head = F.substring(F.lower(F.lit(needle)), 1, x.NEEDLE_CHARS)
    return turns.groupBy(key).agg(F.min(F.when(F.lower(content).contains(head), F.col(index))).alias("matched"))


def match_fuzzy(turns: DataFrame, key: str, index: str, needle: str, content: str = "text") -> DataFrame:
    """The exact match, or else the turn most alike by Ratcliff-Obershelp ratio (first of equals)."""

    wanted = needle.lower()[: x.NEEDLE_CHARS]

    def ratios(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from difflib import SequenceMatcher

        best: dict[str, float] = {}
        for keys, texts in batches:
            out = []
            for key, text in zip(keys, texts, strict=True):
                matcher = SequenceMatcher(None, wanted, (text or "").lower()[: x.HAYSTACK_CHARS])
                # bounds by length and by letters; what cannot beat its conversation's best so far is not compared
                least = best.get(key, -1.0)
                ratio = -1.0 if matcher.real_quick_ratio() < least or matcher.quick_ratio() < least else matcher.ratio()
                best[key] = max(least, ratio)
                out.append(ratio)
            if len(best) > 100_000:
                best.clear()
            yield pd.Series(out, dtype=float)

    ratio = F.pandas_udf(ratios, "double")
    exact = match_exact(turns, key, index, needle, content)
    missing = turns.join(exact.where("matched is null").select(key), key)
    fuzzy = missing.withColumn("ratio", ratio(F.col(key).cast("string"), F.col(content))).groupBy(key).agg(F.max(F.struct("ratio", -F.col(index))).alias("m"))
    best = F.coalesce("matched", -F.col("m.col2"))
    return exact.join(fuzzy, key, "left").select(key, best.alias("matched"), F.coalesce(F.col("m.ratio"), F.lit(1.0)).alias("ratio"))


def context(turns: DataFrame, centers: DataFrame, key: str, index: str, k: int) -> DataFrame:
    """The turns up to k away from each conversation's center (key, center)."""
    return turns.join(centers, key).where(F.col(index).between(F.col("center") - k, F.col("center") + k))


def frames(turns: DataFrame, key: str, index: str, k: int, content: str = "text") -> DataFrame:
    """Every turn with the lengths and bounds of the frame of k turns around it."""
    w = Window.partitionBy(key).orderBy(index).rowsBetween(-k, k)
    return turns.select(key, index, F.min(index).over(w).alias("from_turn"), F.max(index).over(w).alias("to_turn"), F.sum(F.length(content)).over(w).alias("frame_chars"))


def full_context(turns: DataFrame, centers: DataFrame, key: str, index: str, k: int, role: str = "role", content: str = "text") -> DataFrame:
    """One row a center: totals, the matched index, the first and last index shown and the turns in order; an error where
    nothing is found."""
    totals = turns.groupBy(key).agg(F.count("*").alias("total_turns"))
    near = context(turns, centers, key, index, k).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(index).alias("index"), F.col(role).alias("role"), F.col(content).alias("content")))).alias("turns"))
    out = centers.join(totals, key, "left").join(near, key, "left")
    last = F.least(F.col("total_turns") - 1, F.col("center") + k)
    return out.select(key, "total_turns", F.col("center").alias("matched_turn_index"), F.array(F.greatest(F.lit(0), F.col("center") - k), last).alias("context_range"), "turns", F.when(F.col("total_turns").isNull(), F.lit("no_turns_found")).alias("error"))
