"""Suffix-array dedup: every byte that lies in a 200-byte string which also starts anywhere else is removed.

A full suffix array over a corpus moves each suffix's leading bytes, 200 times the input. This one is sparse and exact:

1. Anchors. Each 200-byte window is given to the position inside it whose K-gram hash is least (leftmost of equals).
   Equal windows have their anchors at the same offset with equal K-grams, so anchors whose K-gram is unique in the
   corpus need no look. About one position in 50 is an anchor; each stands for a run of successive windows, and the
   bytes those cover are its string.
2. Equal strings of anchors are counted first (partial sums before the shuffle, so hot passages collapse): where a
   string occurs twice, all its windows do. Strings are equal when two 64-bit hashes with nothing in common are, that of
   the K-gram and that of the whole string; everything else is compared by its bytes.
3. What is left, strings that occur once and one of each class that repeats, are suffixes to sort: Spark samples
   splitters and range-partitions them by their leading bytes from the anchor on; each bucket takes them in that order,
   sorts its windows by a multikey quicksort (radix 8 bytes, groups of one drop out), and neighbours of equal 200 bytes
   are repeats. Equal leading bytes and K-grams are never split by a range, so a bucket's bounds need no look across.
   Where one K-gram has over HOT strings, too many for a bucket, these are cut into their single windows instead, which
   are counted by SHA-256 and so spread over all tasks again: the exact way for what a bucket cannot hold.
4. Spans go back to their rows, which merge them, cut them out and hash what is left.

Rows are numbered when the table is staged, so repeated doc_ids and repeated rows are separate texts (equal ones repeat
each other). Null and empty texts have 0 bytes and hash as the empty string; texts under 200 bytes hold no window and are
left alone; very long texts are scanned in overlapping cuts; a null doc_id is carried through; extra columns are ignored;
an empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as scan
from .common import binary, lookup, only, pieces, slots, stage, unstage

#: Length of a repeat, and of the K-gram that anchors carry.
LENGTH, KGRAM = 200, 100
#: Window starts that a worker expands at a time, and bytes of strings that it sorts at a time.
PIECE, SORTED = 1 << 18, 1 << 20
#: Strings of one K-gram that a bucket sorts together; beyond it windows are counted one by one.
HOT = 20_000

_U = np.uint64


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = KGRAM) -> tuple[np.ndarray, ...]:
    """Of every row's windows: row, anchor, first and last window start (bytes from the row's start), hash of the
    K-gram, hash of the string from the first window's start to the last one's end."""
    if len(buf) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, _U) for _ in range(2))
    hashes = scan.grams(buf, k)
    # least of each window of w grams, by hash, then by place: minima of blocks from the left and from the right
    w, n = length - k + 1, len(hashes)
    keyed = (hashes & ~_U(0xFFFFFFF)) | np.arange(n, dtype=_U)
    padded = np.full(-(-n // w) * w, ~_U(0), _U)
    padded[:n] = keyed
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    starts = np.arange(n - w + 1)
    best = (np.minimum(right[starts], left[starts + w - 1]) & _U(0xFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[starts]
    inside = starts + length <= offsets[row + 1]
    starts, best, row = starts[inside], best[inside], row[inside]
    new = np.ones(len(starts), bool)
    new[1:] = (best[1:] != best[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    row, anchor, lo, hi = row[first], best[first], starts[first], starts[last]
    whole = scan.Hashes(buf, salt=1).of(lo, hi + length) ^ scan.mix((anchor - lo).astype(_U))
    base = offsets[row]
    return row, anchor - base, lo - base, hi - base, hashes[anchor], whole


def _cuts(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Row ranges, their bytes and offsets, and where in its row they begin: a long text comes in overlapping cuts."""
    for at, to in pieces(text, PIECE):
        buf, offsets = scan.view(text, at, to)
        if to - at > 1 or len(buf) <= 2 * PIECE:
            yield at, to, buf, offsets, 0
        else:
            for begin in range(0, len(buf), PIECE):
                part = buf[begin : begin + PIECE + LENGTH - 1]
                yield at, to, part, np.array([0, len(part)]), begin


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, rids = binary(batch, "text"), batch.column(batch.schema.get_field_index("rid")).to_numpy()
        for at, _, buf, offsets, begin in _cuts(text):
            row, anchor, lo, hi, gram, whole = anchors(buf, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(rids[at + row]), pa.array((anchor + begin).astype(np.int64)), pa.array((lo + begin).astype(np.int64)), pa.array((hi + begin).astype(np.int64)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))], ["rid", "anchor", "lo", "hi", "gram", "whole"])


_FOUND = "rid long, anchor long, lo long, hi long, gram long, whole long"


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rid, text, wanted (array of anchor, lo, hi, gram) -> a row for each with its string."""
    for batch in batches:
        text, rids, wanted = binary(batch, "text"), batch.column(batch.schema.get_field_index("rid")), batch.column(batch.schema.get_field_index("wanted"))
        for i in range(batch.num_rows):
            items = wanted.slice(i, 1).flatten()
            lo, hi = (items.field(c).to_numpy() for c in (1, 2))
            buf = memoryview(text[i].as_buffer())
            rid = pa.array(np.full(len(lo), rids[i].as_py(), np.int64))
            for at in range(0, len(lo), 20_000):  # strings are six times their text
                part = slice(at, at + 20_000)
                strings = pa.array([bytes(buf[a : b + LENGTH]) for a, b in zip(lo[part], hi[part], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([rid[part], *(items.field(c)[part] for c in (0, 1, 3)), items.field(4)[part], strings], ["rid", "anchor", "lo", "gram", "hot", "string"])


_STRINGS = "rid long, anchor long, lo long, gram long, hot boolean, string binary"


def repeated(buf: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which suffixes (places in buf) have their first length bytes in common with another one of their group: a
    multikey quicksort that takes eight bytes at a step, all groups at once; groups of one are done and drop out."""
    out = np.zeros(len(suffix), bool)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(padded) - 7,), ">u8", padded.tobytes(), strides=(1,))
    live = np.arange(len(suffix))
    order = np.argsort(group, kind="stable")
    live, rank = live[order], group[order]
    for depth in range(0, length, 8):
        depth = min(depth, length - 8)
        word = eight[suffix[live] + depth].astype(_U)
        order = np.lexsort((word, rank))
        live, word, rank = live[order], word[order], rank[order]
        new = np.ones(len(live) + 1, bool)
        new[1:-1] = (word[1:] != word[:-1]) | (rank[1:] != rank[:-1])
        alone = new[:-1] & new[1:]
        rank = np.cumsum(new[:-1])
        live, rank = live[~alone], rank[~alone]
        if not len(live):
            return out
    out[live] = True
    return out


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's strings, in order of gram: rows rid, lo, hi of repeated window runs. K-grams come whole."""

    def flush(rids: list, anchors_: list, los: list, grams: list, strings: list) -> pa.RecordBatch | None:
        if len(strings) < 2:
            return None
        buf = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.cumsum([len(x) for x in strings])
        starts = np.concatenate(([0], ends[:-1]))
        many = ends - starts - LENGTH + 1
        of = np.repeat(np.arange(len(strings)), many)
        step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        # windows that can be equal have the same K-gram at the same distance
        distance = np.array(anchors_)[of] - np.array(los)[of] - step
        group = np.unique(np.array(grams, np.int64), return_inverse=True)[1][of] * LENGTH + distance
        hit = repeated(buf, starts[of] + step, group)
        new = hit.copy()
        new[1:] &= ~hit[:-1] | (of[1:] != of[:-1])
        end = hit.copy()
        end[:-1] &= ~hit[1:] | (of[1:] != of[:-1])
        a, b = np.flatnonzero(new), np.flatnonzero(end)
        if not len(a):
            return None
        base = np.array(los)[of[a]]
        return pa.RecordBatch.from_arrays([pa.array(np.array(rids)[of[a]]), pa.array(base + step[a]), pa.array(base + step[b])], ["rid", "lo", "hi"])

    held: list[list] = [[], [], [], [], []]
    size = 0
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("rid", "anchor", "lo", "gram", "string")]
        for record in zip(*columns, strict=True):
            if size > SORTED and record[3] != held[3][-1]:
                if (found := flush(*held)) is not None:
                    yield found
                held, size = [[], [], [], [], []], 0
            for x, y in zip(held, record, strict=True):
                x.append(y)
            size += len(record[4])
    if (found := flush(*held)) is not None:
        yield found


_RUNS = "rid long, lo long, hi long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, runs (array of lo, hi) -> the figures and the text that is left."""
    for batch in batches:
        text, ids, runs = binary(batch, "text"), batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("runs"))
        out: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            data = text[i].as_py()
            items = runs.slice(i, 1).flatten() if runs[i].is_valid else None
            spans: list[list[int]] = []
            if items is not None and len(items):
                lo, hi = items.field(0).to_numpy(), items.field(1).to_numpy() + LENGTH
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], np.maximum.accumulate(hi[order])
                new = np.concatenate(([True], lo[1:] > hi[:-1]))
                at = np.flatnonzero(new)
                spans = [list(x) for x in zip(lo[at].tolist(), hi[np.append(at[1:], len(lo)) - 1].tolist(), strict=True)]
            left, end = [], 0
            for a, b in spans:
                left.append(data[end:a])
                end = b
            left = b"".join([*left, data[end:]])
            for x, y in zip(out, (len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(left).hexdigest(), left), strict=True):
                x.append(y)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


_CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _runs(steps: Column) -> Column:
    """lo, hi of the runs of successive numbers in a sorted array of at most LENGTH - KGRAM + 1."""
    firsts = F.filter(steps, lambda x: ~F.array_contains(steps, x - 1))
    lasts = F.filter(steps, lambda x: ~F.array_contains(steps, x + 1))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a.alias("lo"), b.alias("hi")))


def suffix_dedup(docs: DataFrame, texts: bool = True, hot: int = HOT) -> DataFrame:
    """_CUT for every row of docs (doc_id, text); kept holds the bytes that are left (dropped without texts)."""
    spark = docs.sparkSession
    parts = slots(spark)
    table = stage(only(docs, doc_id="long", text="string").withColumn("rid", F.monotonically_increasing_id()))
    found = stage(table.select("rid", "text").mapInArrow(_find, _FOUND))
    grams = found.groupBy("gram").agg(F.count("*").alias("strings")).where("strings > 1")
    suspects = stage(lookup(found, grams, ["gram"], "strings").drop("strings"))
    unstage(found)
    classes = stage(suspects.groupBy("gram", "whole").agg(F.count("*").alias("copies"), F.min(F.struct("rid", "lo", "anchor", "hi")).alias("one")))
    crowd = classes.groupBy("gram").agg(F.count("*").alias("classes")).where("classes > 1")
    repeats = lookup(suspects, classes.where("copies > 1").select("gram", "whole", "copies"), ["gram", "whole"], "copies").select("rid", "lo", "hi")
    ones = lookup(classes.select("gram", "one"), crowd, ["gram"], "classes").select("gram", "one.*", (F.col("classes") > hot).alias("hot"))
    wanted = ones.groupBy("rid").agg(F.collect_list(F.struct("anchor", "lo", "hi", "gram", "hot")).alias("wanted"))
    strings = stage(table.select("rid", "text").join(wanted, "rid").mapInArrow(_strings, _STRINGS))
    dealt = strings.where("not hot").drop("hot").withColumn("lead", F.expr("substring(string, cast(anchor - lo + 1 as int), 16)"))
    runs = dealt.repartitionByRange(parts, "lead", "gram").sortWithinPartitions("lead", "gram").drop("lead").mapInArrow(_sort, _RUNS)

    windows = strings.where("hot").select("rid", "lo", "string", F.explode(F.expr(f"sequence(0, cast(octet_length(string) as int) - {LENGTH})")).alias("step"))
    windows = windows.select("rid", "lo", "step", F.expr(f"unhex(sha2(substring(string, step + 1, {LENGTH}), 256))").alias("content"))
    twice = windows.groupBy("content").agg(F.count("*").alias("n")).where("n > 1")
    steps = lookup(windows, twice, ["content"], "n").groupBy("rid", "lo").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    runs = runs.unionByName(steps.select("rid", "lo", F.explode(_runs(F.col("steps"))).alias("r")).select("rid", (F.col("lo") + F.col("r.lo")).alias("lo"), (F.col("lo") + F.col("r.hi")).alias("hi")))

    # a text's runs are fewer than one in (LENGTH - KGRAM) / 2 of its bytes, unless it repeats itself at once
    spans = repeats.unionByName(runs).groupBy("rid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    out = table.join(spans, "rid", "left").select("doc_id", "text", "runs").mapInArrow(_cut, _CUT)
    out = stage(out if texts else out.drop("kept"))
    unstage(table, suspects, classes, strings)
    return out


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What repeats of 200 bytes leave of every document."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)
