"""N-gram Jaccard join: documents whose sets of k-word shingles have a Jaccard similarity of at least num/den link up.

Method, a count-vector R-tree:

1. Each text gives its set of shingle hashes. Documents of equal sets are one class; only classes go on.
2. A set's shingles are hashed into groups. A pair that links differs in at most tau = (a + b)(den - num)/(den + num)
   shingles, which spoil at most tau groups; with more than tau groups filled, some filled group is the same in both.
   Group contents are therefore lossless keys: what shares no key cannot link. Sizes are cut into levels (each 1.5 times
   the last) that fix the number of groups; a set also takes part in the next level if a partner may lie there.
   Shingles that are frequent in a bounded sample stay out of the groups, so a common line makes no key (any choice of
   such shingles is lossless; the sample moves the cost, not the result). Groups of two or more shingles are keys if over
   tau groups are such, else all filled groups are; a set with tau or fewer filled groups, mostly common lines, also
   gives the groups of all its shingles, and failing those too meets the others of its level that fail.
3. Connected components of classes and keys (stars, not pairs; keys that repeat within a batch are joined there, so a hot
   key hardly shuffles) in a level are its trees. A tree of several leaves is split first: what links shares many keys, so each
   class lets as many of its commonest keys go, and components of the rest are trees; texts of a tree that no longer has any
   are dealt nowhere. Each tree becomes one R-tree; one that still is large is dealt at random into leaves of
   bounded size, of which each also gets the tree's few pivots, so what is connected becomes so through them.
4. What a large tree may still hold are links between different components, and such a pair shares a key. So the tree as
   one block, or each of its keys of more than one component as a block, whichever moves fewer sets, is dealt again: the
   classes of a block's largest component are compared with all others, and the others among themselves, in leaves of
   bounded size; never one component's classes with each other. A group of near copies, however large, is thus dealt
   twice, and a tree that keys alone hold together costs its keys, not its square.
5. In a leaf the points are vectors of shingle counts by group. For a query, the sum of coordinate minima with a node's
   upper corner bounds the overlap with all points below it, then the sum with each point the overlap with that point.
   Pairs that pass and are not yet connected are verified on the sets; only links that connect go out.

No pairs of a group are written, no set of keys, links or components reaches the driver, and nothing is capped.

Nulls and edge cases: null or blank text has no shingle and links with nothing; a null doc_id links with nothing and
has a null component; rows that repeat a doc_id count as one vertex; extra columns are ignored; an empty table gives an
empty result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textscan as scan
from .common import binary, columns_of, components, lookup, only, pieces, released, slots, stage, unstage

#: Bytes of text a worker expands at a time.
PIECE = 1 << 20
#: Documents and shingles in a leaf, and about how many pivots a tree of several leaves has.
LEAF_DOCS, LEAF_SHINGLES, PIVOTS = 2048, 2_000_000, 64
#: The sample that tells frequent shingles: documents and their characters, documents that make one frequent, and how many.
SAMPLE, SAMPLE_CHARS, MANY, MOST = 12_000, 20_000, 3, 500_000
#: Keys in a packed row, and deals of a partition, each of which is held in memory alone.
PACKED, DEALS = 1 << 16, 8
#: Bits that keys of one deal and vertices differ in: what is equal by chance is compared for nothing, and no more.
BITS = 40
#: How often what is large still is split.
SPLITS = 3
#: Coordinates of a point, and points in a node.
COORDINATES, NODE = 128, 32

_U = np.uint64


def levels(num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper sizes of the levels up to most (and one beyond), their tau, and their number of groups."""
    def next_(top: int) -> int:
        return max(top + 1, top * 3 // 2, -(-top * den // num))

    tops = [1]
    while tops[-1] <= most * den // num + 1:
        tops.append(next_(tops[-1]))
    tops.append(next_(tops[-1]))
    top = np.array(tops, np.int64)
    tau = 2 * top * (den - num) // (den + num)
    return top, tau, tau + 3 + tau // 5


def signatures(h: np.ndarray, first: np.ndarray, num: int, den: int, frequent: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The level of each set, and for that level and the next the keys of each set: hashes, and each set's first. Sets
    that only their equals can link with have none. frequent is sorted."""
    level, both = told_signatures(h, first, num, den, frequent)
    return level, [(key, at) for key, at, _ in both]


def told_signatures(h: np.ndarray, first: np.ndarray, num: int, den: int, frequent: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """signatures, and with the keys of each set how many of them it shares with whatever it links with, at least.

    Sizes a and b that link differ in (a + b)(den - num)/(den + num) shingles at most, which is less than tau allows for all sizes
    of a level. What these do not spoil of a set's groups of two or more shingles, if such are its keys, are keys of both; if all
    filled groups are its keys, a partner's may be groups of two or more alone, but of these it has over tau. One less is told,
    as two keys of a set may be equal by chance; sets of few groups are told 1."""
    n = np.diff(first)
    rows = np.arange(len(n))
    top, tau, groups = levels(num, den, int(n.max(initial=1)))
    level = np.searchsorted(top, n)
    rare = np.ones(len(h), bool)
    if len(frequent) and len(h):
        rare = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] != h
    out = []
    for up in (0, 1):
        at = np.minimum(level + up, len(top) - 1)
        # a partner in the next level is larger than this level ends; it may be up to n * den / num
        joins = (n > 0) & (tau[at] > 0) & ((up == 0) | (top[at - 1] * num < n * den))
        g = np.where(joins, groups[at], 0)
        base = np.concatenate(([0], np.cumsum(g)))
        of = np.repeat(rows, g)
        number = np.arange(base[-1]) - base[of]

        def grouped(keep: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
            """Size and key of each group of each set."""
            keep = keep & np.repeat(joins, n)
            row = np.repeat(rows, n)[keep]
            own = scan.mix(h[keep] + at[row].astype(_U) * _U(0x9E3779B97F4A7C15) + _U(salt))
            group = base[row] + (own >> _U(33)).astype(np.int64) % g[row]
            low = np.bincount(group, (own & _U(0xFFFFFFFF)).astype(np.float64), base[-1]).astype(_U)
            high = np.bincount(group, (own >> _U(32)).astype(np.float64), base[-1]).astype(_U)
            key = scan.mix((low + (high << _U(32))) ^ scan.mix(at[of].astype(_U) * _U(1 << 32) + number.astype(_U) + _U(salt)))
            return np.bincount(group, minlength=base[-1]), key

        owner, keys, need = [np.zeros(0, np.int64)], [np.zeros(0, _U)], np.ones(len(n), np.int64)
        if base[-1]:
            size, key = grouped(rare, 0)
            least = np.where(np.bincount(of[size > 1], minlength=len(n)) > tau[at], 2, 1)
            use = size >= least[of]
            few = joins & (np.bincount(of[size > 0], minlength=len(n)) <= tau[at])
            differ = (n + np.minimum(n * den // num, top[at])) * (den - num) // (den + num)
            held = np.where(least == 2, np.bincount(of[use], minlength=len(n)), tau[at] + 1)
            need = np.where(few, 1, np.maximum(held - differ - 1, 1))
            owner.append(of[use])
            keys.append(key[use])
            if few.any():
                size, key = grouped(np.repeat(few, n), 1)
                use = (size > 0) & few[of]
                last = np.flatnonzero(few & (np.bincount(of[size > 0], minlength=len(n)) <= tau[at]))
                owner += [of[use], last]
                keys += [key[use], scan.mix(at[last].astype(_U) + _U(0xD1B54A32D192ED03))]
        who, key = np.concatenate(owner), np.concatenate(keys)
        order = np.argsort(who, kind="stable")
        out.append((key[order], np.searchsorted(who[order], np.arange(len(first))), need))
    return level, out


def set_keys(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    out = []
    for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(scan.mix(h ^ _U(salt)))))
        out.append(scan.mix(sums[first[1:]] - sums[first[:-1]]).astype(np.int64))
    return out[0], out[1]


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int64)))


Batches = Iterator[pa.RecordBatch]
_SETS = "doc_id long, n long, k1 long, k2 long, items array<long>"
_CLASSES = "doc_id long, n long, k1 long, k2 long, level int"
_KEYS = "v long, key long, lo long"
_PACKED = "deal int, n int, m int, key binary, v binary, times binary, lo binary"


def _shingled(batches: Batches, k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the batches with their rows' shingles and set keys."""
    for batch in batches:
        text = binary(batch, "text")
        for at, to in pieces(text, PIECE):
            h, first = scan.shingles(*scan.view(text, at, to), k)
            yield batch.slice(at, to - at), h, first, *set_keys(h, first)


def _sets(k: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for rows, h, first, k1, k2 in _shingled(batches, k):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(first)), pa.array(k1), pa.array(k2), _lists(h, first)], ["doc_id", "n", "k1", "k2", "items"])

    return run


def _classes(k: int, num: int, den: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for rows, _, first, k1, k2 in _shingled(batches, k):
            n = np.diff(first)
            level = np.searchsorted(levels(num, den, int(n.max(initial=1)))[0], n).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n), pa.array(k1), pa.array(k2), pa.array(level)], ["doc_id", "n", "k1", "k2", "level"])

    return run


def vertices(k1: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A class is a vertex of its own in either of its levels; classes of one vertex by chance are in one tree."""
    return (scan.mix(k1.view(_U) + scan.mix(level.astype(_U) + _U(0x2545F4914F6CDD1D))) >> _U(64 - BITS)).view(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers as the least of them, and the bytes that their distances to it need."""
    least = x.min()
    far = x.view(_U) - least.view(_U)
    width = max(1, (int(far.max()).bit_length() + 7) // 8)
    return least.tobytes() + far.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8, offset=8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return (out.view(_U).ravel() + np.frombuffer(data, _U, 1)).view(np.int64)


def _roots(v: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each row the least vertex that its own reaches through groups (rows of a group stand together)."""
    if not len(v):
        return v
    vertex, place = np.unique(v, return_inverse=True)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    size = np.diff(np.append(starts, len(v)))
    label = np.arange(len(vertex))
    while True:
        least = label.copy()
        np.minimum.at(least, place, np.repeat(np.minimum.reduceat(label[place], starts), size))
        least = least[least]
        if (least == label).all():
            return vertex[label[place]]
        label = least


def _packs(deal: np.ndarray, v: np.ndarray, key: np.ndarray, lo: np.ndarray | None) -> pa.RecordBatch:
    """_PACKED: the n rows of each deal as the bytes of their columns, a vertex of successive rows once, as its distance to
    the one before, with its times; m are they."""
    order = np.lexsort((v, deal))
    deal, v, key = deal[order], v[order], key[order]
    new = np.ones(len(v), bool)
    new[1:] = deal[1:] != deal[:-1]
    starts = np.flatnonzero(new)
    bounds = [(x, min(x + PACKED, b)) for a, b in zip(starts, np.append(starts, len(v))[1:], strict=True) for x in range(a, b, PACKED)]
    keys, vertices_, times, many = [], [], [], []
    for a, b in bounds:
        first = np.flatnonzero(np.diff(v[a:b], prepend=~v[a]))
        keys.append(_narrow(key[a:b]))
        vertices_.append(v[a : a + 1].tobytes() + _narrow(np.diff(v[a:b][first], prepend=v[a])))
        times.append(_narrow(np.diff(np.append(first, b - a))))
        many.append(len(first))
    least = [b""] * len(bounds) if lo is None else [lo[order[a:b]].tobytes() for a, b in bounds]
    kinds = (*[pa.int32()] * 3, *[pa.binary()] * 4)
    columns = ([int(deal[a]) for a, _ in bounds], [b - a for a, b in bounds], many, keys, vertices_, times, least)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["deal", "n", "m", "key", "v", "times", "lo"])


def named(deal: np.ndarray, key: np.ndarray) -> np.ndarray:
    """BITS of a key with its deal above them, so keys of different deals differ and those of one are near each other."""
    return (deal.astype(np.int64) << BITS) | key & ((1 << BITS) - 1)


def _keys(k: int, num: int, den: int, frequent: np.ndarray, deals: int) -> Callable[[Batches], Batches]:
    """The vertices of each key, dealt by key and packed. Where a batch holds a key more than once, only its least
    vertex is dealt so; all of them also go out with the key and the least vertex that keys of the batch connect them with,
    dealt at random."""

    def part(x: np.ndarray) -> np.ndarray:
        return ((scan.mix(x ^ _U(0x8EBC6AF09C88C6E3)) >> _U(20)) % _U(deals)).astype(np.int32)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for _, h, first, k1, _ in _shingled(iter([batch]), k):
                level, both = signatures(h, first, num, den, frequent)
                found += [(key.view(np.int64), np.repeat(vertices(k1, level + up), np.diff(at))) for up, (key, at) in enumerate(both)]
            key, v = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1))
            found.clear()
            order = np.lexsort((v, key))
            key, v = key[order], v[order]
            del order
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (v[1:] != v[:-1])  # copies of a text
            key, v, new = key[new], v[new], np.ones(int(new.sum()), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(key)))
            crowd = np.repeat(many, many) > 1
            held, group, shared = v[crowd], np.cumsum(new)[crowd], key[crowd]
            v, key = v[first], key[first]
            del new, first, many, crowd
            deal = part(key.view(_U))
            yield _packs(deal, v, named(deal, key), None)
            del v, key, deal
            lo, name = _roots(held, group), named(part(shared.view(_U)), shared)
            yield _packs(part(held.view(_U) ^ scan.mix(shared.view(_U))), held, name, lo)

    return run


def _needs(k: int, num: int, den: int, frequent: np.ndarray) -> Callable[[Batches], Batches]:
    """Each vertex of a text with the number of keys that it shares with whatever it links with, at least."""

    def run(batches: Batches) -> Batches:
        for _, h, first, k1, _ in _shingled(batches, k):
            level, both = told_signatures(h, first, num, den, frequent)
            for up, (_, _, need) in enumerate(both):
                yield pa.RecordBatch.from_arrays([pa.array(vertices(k1, level + up)), pa.array(need)], ["v", "need"])

    return run


def _shared(batches: Batches) -> Batches:
    """_PACKED sorted by deal -> _KEYS of the keys of more than one vertex, with the least one as lo, and of the rows that
    have lo already."""

    def told(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["v", "key", "lo"])

    def crowds(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        v, key = (np.concatenate([np.zeros(0, np.int64), *(r[i] for r in rows)]) for i in (0, 1))
        order = np.lexsort((v, key))
        v, key = v[order], key[order]
        new = np.ones(len(v), bool)
        new[1:] = key[1:] != key[:-1]
        of = np.cumsum(new) - 1
        least = v[new][of]
        crowd = np.bincount(of[v != least], minlength=int(new.sum()))[of] > 0
        return told(v[crowd], key[crowd], least[crowd])

    at, rows = None, []
    for batch in batches:
        for r in range(batch.num_rows):
            deal, n, m, key, v, times, lo = (column[r].as_py() for column in batch.columns)
            key, v = _wide(key, n), np.repeat(np.frombuffer(v, np.int64, 1) + np.cumsum(_wide(v[8:], m)), _wide(times, m))
            if lo:
                yield told(v, key, np.frombuffer(lo, np.int64))
                continue
            if deal != at:
                yield crowds(rows)
                at, rows = deal, []
            rows.append((v, key))
    yield crowds(rows)


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles that MANY or more of at most SAMPLE documents of at most SAMPLE_CHARS hold, at most MOST."""
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    some = docs.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), "doc_id").select("doc_id", "text").mapInArrow(released(_sets(k)), _SETS)
    often = some.select(F.explode("items").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= MANY)
    return np.sort(often.orderBy(F.desc("n"), "h").limit(MOST).select("h").toArrow().column("h").to_numpy().astype(np.int64).view(_U))


def tree_links(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, label: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links that connect what num/den connects among the given sets, by an R-tree over their count vectors; sets of two
    sides are joined across alone, and sets of equal labels are connected already."""
    n = np.array([len(s) for s in sets])
    points = np.zeros((len(sets), COORDINATES), np.int32)
    for i, s in enumerate(sets):
        points[i] = np.bincount((scan.mix(s) >> _U(40)).astype(np.int64) % COORDINATES, minlength=COORDINATES)
    # packed by size, then by the first coordinates, as sort-tile-recursive packing orders its leaves
    order = np.lexsort((points[:, 1], points[:, 0], n))
    keys, n, points, side, sets = keys[order], n[order], points[order], side[order], [sets[i] for i in order]
    label = np.unique(label, return_inverse=True)[1][order]
    two = bool(side.any()) and not side.all()
    corner = np.array([points[i : i + NODE].max(0) for i in range(0, len(sets), NODE)])
    least = n[::NODE]
    for i in range(1, len(sets)):
        nodes = np.arange((i + NODE - 1) // NODE)
        nodes = nodes[(den + num) * np.minimum(corner[nodes], points[i]).sum(1) >= num * (n[i] + least[nodes])]
        if not len(nodes):
            continue
        near = (nodes[:, None] * NODE + np.arange(NODE)).ravel()
        near = near[near < i]
        if two:
            near = near[side[near] != side[i]]
        near = near[(label[near] != label[i]) & (n[near] * den >= n[i] * num)]
        near = near[(den + num) * np.minimum(points[near], points[i]).sum(1) >= num * (n[near] + n[i])]
        for j in near[::-1]:
            if label[i] == label[j]:
                continue
            a, b = sets[i], sets[j]
            spots = np.minimum(np.searchsorted(a, b), len(a) - 1)
            both = int((a[spots] == b).sum())
            if den * both >= num * (len(a) + len(b) - both):
                label[label == label[i]] = label[j]
                yield int(keys[i]), int(keys[j])


def _trees(k: int, num: int, den: int) -> Callable[[Batches], Batches]:
    """Rows block, i, j, own, label, k1, k2, text, sorted by the first three -> links a, b. A text of other keys, of a row
    that repeats the doc_id, is passed over."""

    def links(key: tuple[int, int, int], rows: dict[int, tuple[np.ndarray, bool, int]]) -> Iterator[tuple[int, int]]:
        if len(rows) > 1:
            sets, side, label = zip(*rows.values(), strict=True)
            yield from tree_links(np.array(list(rows), np.int64), list(sets), np.array(side), np.array(label, np.int64), num, den)

    def run(batches: Batches) -> Batches:
        at, rows, out = None, {}, []
        for some, h, first, k1, k2 in _shingled(batches, k):
            block, i, j, own, label, own_k1, own_k2 = (some.column(c).to_numpy(zero_copy_only=False).tolist() for c in range(7))
            right = (k1 == np.array(own_k1, np.int64)) & (k2 == np.array(own_k2, np.int64))
            for r in np.flatnonzero(right).tolist():
                key = (block[r], i[r], j[r])
                if key != at:
                    out += links(at, rows)
                    at, rows = key, {}
                if own_k1[r] not in rows:
                    rows[own_k1[r]] = (h[first[r] : first[r + 1]].copy(), own[r] == j[r] and i[r] != j[r], label[r])
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        out += links(at, rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _links(texts: DataFrame, places: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links a, b among places (k1, k2, block, first, last, own, label): a class meets those of its block that own what is
    between its first and last. Texts are dealt, not their sets, which are larger and do not compress."""
    # a fixed share of the corpus has places: merged at every size, so the plan of a small input is that of a large one
    dealt = texts.hint("merge").join(places, ["k1", "k2"]).select("*", F.explode(F.sequence("first", "last")).alias("other"))
    dealt = dealt.select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "label", "k1", "k2", "text")
    return dealt.repartition(slots(texts.sparkSession), "block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(released(_trees(k, num, den)), "a long, b long")


def _leaves(docs, shingles, leaf_docs: int, leaf_shingles: int):
    return F.greatest(F.ceil(docs / leaf_docs), F.ceil(shingles / leaf_shingles), F.lit(1)).cast("int")


def _sides(rows: DataFrame, block: str, leaf_docs: int, leaf_shingles: int) -> DataFrame:
    """For each block of rows (label, n) with more than one component: members m, the largest component top, its leaves p,
    the leaves of all others q, and how many sets move if the others meet it and each other."""
    each = rows.groupBy(block, "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    both = each.groupBy(block).agg(F.max(F.struct("m", "label", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("labels"))
    p = _leaves(F.col("top.m"), F.col("top.s"), leaf_docs, leaf_shingles)
    q = _leaves(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s"), leaf_docs, leaf_shingles)
    sides = both.select(block, "m", "labels", F.col("top.label").alias("top"), F.col("top.m").alias("one"), p.alias("p"), q.alias("q"))
    return sides.withColumn("sets", F.when(F.col("labels") > 1, F.col("one") * F.col("q") + (F.col("m") - F.col("one")) * (F.col("p") + F.col("q"))).otherwise(0)).drop("one")


def _places(rows: DataFrame, sides: DataFrame, block: str) -> DataFrame:
    """Where the classes of blocks with more than one component go: the largest component's meet all others."""
    mixed = lookup(rows, sides, [block], "m").where("labels > 1")
    one, spot = F.col("label") == F.col("top"), F.xxhash64("k1")
    own = F.when(one, F.pmod(spot, "p")).otherwise(F.col("p") + F.pmod(spot, "q")).cast("int")
    return mixed.select("k1", "k2", F.col(block).alias("block"), F.when(one, F.col("p")).otherwise(0).alias("first"), (F.col("p") + F.col("q") - 1).alias("last"), own.alias("own"), "label")


def _split(members: DataFrame, keyed: DataFrame, needs: DataFrame, leaf_docs: int, leaf_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Large trees (members) as the smaller ones that their rarest keys hold together: the members of these, and the keys
    (v, key) that hold those of them that still are large. keyed (v, key) are all keys that members share.

    What links shares need keys, so the rarest of these, in one order of all keys, is not among the need - 1 commonest keys
    of either: each vertex lets these go. A vertex that shares fewer keys is in no tree any more. In a smaller tree keys are
    rarer, so what still is large is split again, unless the last time left more than half of it: a group of near copies is
    one tree whatever its keys."""
    frames, done, rest, before = [], members.limit(0), members, members.count()
    for _ in range(SPLITS):
        own = keyed.join(rest.select("v", "tree").distinct(), "v")
        many = own.groupBy("tree", "key").agg(F.count("*").alias("many")).where("many > 1")
        common = Window.partitionBy("v").orderBy(F.desc("many"), F.desc("key"))
        ranked = lookup(own, many, ["tree", "key"], "many").join(needs, "v").withColumn("place", F.row_number().over(common))
        kept = stage(ranked.where("place >= need").select("v", "tree", "key"))
        least = kept.groupBy("tree", "key").agg(F.min("v").alias("lo"), F.count("*").alias("many")).where("many > 1")
        bound = stage(lookup(kept, least, ["tree", "key"], "many").select("v", "key", "lo"))
        trees = components(bound.where("v <> lo").select(F.col("lo").alias("a"), F.col("v").alias("b")).distinct())
        parts = stage(rest.drop("tree").join(trees.select("v", F.col("component").alias("tree")), "v"))
        sizes = _sizes(parts, leaf_docs, leaf_shingles)
        frames += [kept, bound, trees, parts, sizes]
        dealt = lookup(parts, sizes, ["tree"], "members")
        done, rest = done.unionByName(dealt.where("leaves = 1").select(members.columns)), dealt.where("leaves > 1").select(members.columns)
        left = sizes.where("leaves > 1").agg(F.sum("members")).first()[0] or 0
        if not left or left * 2 > before:
            break
        before = left
    out = stage(done.unionByName(rest)), stage(bound.select("v", "key"))
    unstage(*frames)
    return out


def _sizes(members: DataFrame, leaf_docs: int, leaf_shingles: int) -> DataFrame:
    return stage(members.groupBy("tree").agg(_leaves(F.count("*"), F.sum("n"), leaf_docs, leaf_shingles).alias("leaves"), F.count("*").alias("members")))


def jaccard_components(docs: DataFrame, k: int, num: int, den: int, leaf_docs: int = LEAF_DOCS, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text): component_id is the smallest doc_id that
    links of a similarity of at least num/den reach."""
    parts = slots(docs.sparkSession)
    docs = only(docs, doc_id="long", text="string")
    found = stage(docs.mapInArrow(released(_classes(k, num, den)), _CLASSES))
    # copies of one text are many rows, of which a class is one
    classes = found.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n", "level").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    frames = [found]

    frequent = frequent_shingles(docs, k)
    rows = docs.where("doc_id is not null").mapInArrow(released(_keys(k, num, den, frequent, parts * DEALS)), _PACKED)
    # a batch sends a key once, so no key's rows are many
    shared = stage(rows.repartitionById(parts, F.col("deal") % parts).sortWithinPartitions("deal").mapInArrow(released(_shared), _KEYS))
    trees = components(shared.where("v <> lo").select(F.col("lo").alias("a"), F.col("v").alias("b")).distinct())
    frames += [shared, trees]

    places = classes.select("k1", "k2", "n", "rep", F.explode(_both(F.col("k1"), F.col("level"))).alias("v"))
    members = stage(places.join(trees.select("v", F.col("component").alias("tree")), "v"))
    sizes = _sizes(members, leaf_docs, leaf_shingles)
    frames += [members, sizes]
    # the texts of all trees, kept for both deals; the second needs those of large trees alone
    dealt = lookup(members, sizes, ["tree"], "members")
    held = dealt.groupBy(F.col("rep").alias("doc_id"), "k1", "k2").agg(F.max(F.col("leaves") > 1).alias("large"))
    texts = stage(docs.join(held.hint("merge"), "doc_id").select("k1", "k2", "text", "large"))
    frames.append(texts)

    keyed = shared
    if not sizes.where("leaves > 1").isEmpty():
        needs = stage(texts.where("large").mapInArrow(released(_needs(k, num, den, frequent)), "v long, need long").groupBy("v").agg(F.min("need").alias("need")))
        large = stage(dealt.where("leaves > 1").select(members.columns))
        all_keys = stage(shared.select("v", "key").join(large.select("v"), "v", "left_semi").distinct())
        split, keyed = _split(large, all_keys, needs, leaf_docs, leaf_shingles)
        members = stage(dealt.where("leaves = 1").select(members.columns).unionByName(split))
        sizes = _sizes(members, leaf_docs, leaf_shingles)
        dealt = lookup(members, sizes, ["tree"], "members")
        unstage(needs, large, all_keys, split)
        frames += [keyed, members, sizes]
    own = F.pmod(F.xxhash64("k1"), "leaves").cast("int")
    pivot = (F.col("leaves") > 1) & (F.pmod(F.xxhash64(F.lit(1), "k1"), F.col("leaves") * max(1, leaf_docs // PIVOTS)) == 0)
    first = dealt.select("k1", "k2", F.col("tree").alias("block"), "leaves", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("leaves") - 1)).otherwise(F.array(own))).alias("own"))
    first = first.select("k1", "k2", "block", F.col("own").alias("first"), F.col("own").alias("last"), "own", F.col("k1").alias("label"))
    joined = components(_links(texts, first, k, num, den))
    frames.append(joined)

    large = sizes.where("leaves > 1")
    if not large.isEmpty():
        edges = joined.select(F.col("v").alias("a"), F.col("component").alias("b"))
        some = members.join(large.select("tree"), "tree", "left_semi").join(joined.withColumnRenamed("v", "k1"), "k1", "left")
        some = stage(some.select("v", "tree", "k1", "k2", "n", F.coalesce("component", "k1").alias("label")))
        keyed = stage(keyed.select("v", "key").join(some, "v").distinct())
        frames += [some, keyed]
        # a tree is done as one block or key by key, whichever moves fewer sets
        whole = _sides(some, "tree", leaf_docs, leaf_shingles)
        cost = keyed.groupBy("tree").agg(F.count("*").alias("rows"))
        whole = stage(whole.join(cost, "tree").withColumn("whole", F.col("sets") <= F.col("rows")))
        frames.append(whole)
        by_key = keyed.join(whole.where("not whole").select("tree"), "tree", "left_semi")
        second = _places(some, whole.where("whole").drop("rows", "whole", "sets"), "tree")
        second = second.unionByName(_places(by_key, _sides(by_key, "key", leaf_docs, leaf_shingles).drop("sets"), "key"))
        second = stage(second)
        frames.append(second)
        joined = components(edges.unionByName(_links(texts.where("large"), second, k, num, den)))
        frames.append(joined)

    linked = joined.select(F.col("v").alias("k1"), "component").join(classes.select("k1", "rep"), "k1")
    linked = linked.select("k1", "component").distinct().join(linked.groupBy("component").agg(F.min("rep").alias("root")), "component").select("k1", "root")
    labels = classes.join(linked, "k1", "left").select("k1", "k2", "n", "copies", F.coalesce("root", "rep").alias("label"))
    told = lookup(found.where("n > 0 and doc_id is not null"), labels, ["k1", "k2", "n"], "copies").select("doc_id", "n", "label")
    out = told.unionByName(found.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("label")))
    out = stage(out.select("doc_id", F.col("n").alias("n_shingles"), F.col("label").alias("component_id")))
    unstage(*frames)
    return out


def _both(k1, level):
    """The vertices of a class in its level and the next, as vertices() makes them."""

    @F.pandas_udf("array<long>")
    def pair(k1: pd.Series, level: pd.Series) -> pd.Series:
        a, b = k1.to_numpy(np.int64), level.to_numpy(np.int64)
        return pd.Series(list(np.column_stack((vertices(a, b), vertices(a, b + 1)))))

    return pair(k1, level)


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; all columns stay. Rows of a null doc_id stay."""
    label = jaccard_components(docs, k, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias("doc_id")).distinct()
    return docs.join(label, "doc_id", "left_anti").select(columns_of(docs))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document of the table, linked by 3-word shingles at 90 of 100."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90, 100)
