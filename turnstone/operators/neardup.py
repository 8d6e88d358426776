"""Near-duplicate check before filing: MinHash signatures, banding, exact verification.

A text's shingles are its runs of WORDS words (the whole sequence where it has fewer), as 64-bit hashes. Texts of equal sets are
one class, so copies never multiply; of a class only its least id is compared. BANDS bands of ROWS minima each make a class's
keys: two sets of similarity s share one with probability 1 - (1 - s ^ ROWS) ^ BANDS, 0.9998 at 0.8. A new class that is filed
already is done; any other that shares a key meets the filed classes that have a key of its block, and is verified on the sets.

One pass over the texts leaves hashes and keys alone; the texts of what shares a key are read again. No pairs are made: new
classes are dealt into blocks of bounded size, the filed classes of a block into parts of about HOT, to each of which the block
goes. A task holds one block, takes filed texts one by one, and hands on a row for each new class. So a template that many texts
share costs its texts, and not a row or a pair of sets for each two of them.

Null and blank texts have no shingle and are like nothing, not even each other; rows with a null id take no part."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from turnstone.sources import scratch

WORDS, BANDS, ROWS, HOT, SEED = 5, 16, 4, 1000, 5
#: New classes and shingles of a block, shingles met at a time, bytes of text cut at a time, and bytes of a word hashed in steps.
CLASSES, SHINGLES, CELLS, PIECE, LONG = 2048, 1 << 20, 1 << 20, 1 << 18, 512

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
Batches = Iterator[pa.RecordBatch]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(buf: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that begin at first (and end at its last), and each text's first word."""
    solid, edge = ~_SPACE[buf], np.zeros(len(buf) + 1, bool)
    edge[first] = True
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    # the eight bytes from every place; each step is a bijection of the hash so far, so no pattern of bytes makes equal ones
    eight = np.ndarray((len(buf) + 1,), "<u8", np.concatenate((buf, np.zeros(8, np.uint8))).tobytes(), strides=(1,))
    size = end - start
    h, live, at = _mixed(size.astype(_U) + _ODD), np.flatnonzero(size <= LONG), 0
    while len(live):
        left = size[live] - at
        h[live] = _mixed((h[live] ^ (eight[start[live] + at] & _MASK[np.minimum(left, 8)])) * _ODD)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG):
        h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return h, np.searchsorted(start, first)


def _runs(h: np.ndarray, words: int) -> np.ndarray:
    out = np.full(max(len(h) - words + 1, 0), words, _U)
    for j in range(words):
        out = _mixed(out * _ODD + h[j : j + len(out)])
    return out


def shingles(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Some texts at a time, which are lower-cased: the first's place, their shingle hashes, sorted and distinct in each, and
    each one's first (and the end)."""
    texts = texts.cast(pa.binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        own = offsets[at : to + 1]
        h, first = _words(data[own[0] : own[-1]], own - own[0])
        all_, out = _runs(h, words), []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            run = np.sort(all_[a : b - words + 1]) if b - a >= words else _runs(h[a:b], b - a)[: b - a]
            out.append(run[np.concatenate(([True], run[1:] != run[:-1]))] if len(run) > 1 else run)
        yield at, np.concatenate(out), np.concatenate(([0], np.cumsum([len(x) for x in out])))
        at = to


def names(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, whatever its order."""
    sums = (np.concatenate((np.zeros(1, _U), np.cumsum(_mixed(h ^ _U(salt))))) for salt in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
    h1, h2 = (_mixed(s[first[1:]] - s[first[:-1]]).view(np.int64) for s in sums)
    return h1, h2


def keys(h: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each set's signature; sets are not empty, first is where each begins."""
    r = np.random.default_rng(SEED)
    odd = r.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = r.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    half = (h >> _U(32)).astype(np.uint32)
    own, out = np.empty_like(half), np.empty((len(first), bands), _U)
    for band in range(bands):
        key = np.full(len(first), band, _U)
        for i in range(band * rows, band * rows + rows):
            np.multiply(half, odd[i], out=own)
            np.add(own, add[i], out=own)
            key = _mixed((key ^ np.minimum.reduceat(own, first)) * _ODD)
        out[:, band] = key
    return out.view(np.int64)


def _sign(batches: Batches) -> Batches:
    """id, filed, text -> id, filed, h1, h2, n, keys of the texts that have a shingle."""
    for batch in batches:
        for at, h, first in shingles(batch.column(2)):
            n = np.diff(first)
            full = np.flatnonzero(n)
            if len(full):
                h1, h2 = names(h, first)
                key = keys(h, first[full])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(key.ravel()))
                own = [batch.column(i).take(pa.array(full + at)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(h1[full]), pa.array(h2[full]), pa.array(n[full].astype(np.int32)), lists], ["id", "filed", "h1", "h2", "n", "keys"])


class _Block:
    """New sets, and the filed one most like each, of equals the first."""

    def __init__(self) -> None:
        self.h1, self.h2, self.sets, self.met = [], [], [], False

    def add(self, h1: int, h2: int, own: np.ndarray) -> None:
        self.h1.append(h1)
        self.h2.append(h2)
        self.sets.append(own)

    def meet(self, id_: object, own: np.ndarray) -> None:
        if not self.met:
            self.met, self.n = True, np.array([len(s) for s in self.sets], np.int64)
            all_ = np.concatenate([np.zeros(0, _U), *self.sets])
            order = np.argsort(all_, kind="stable")
            self.h, self.first = np.unique(all_[order], return_index=True)
            self.first, self.owner = np.append(self.first, len(all_)), np.repeat(np.arange(len(self.n)), self.n)[order]
            self.best, self.of = np.zeros(len(self.n)), np.empty(len(self.n), object)
        place = np.searchsorted(self.h, own)
        place = place[place < len(self.h)] if len(place) and place[-1] == len(self.h) else place
        place = place[self.h[place] == own[: len(place)]]
        size = self.first[place + 1] - self.first[place]
        both, end = np.zeros(len(self.n), np.int64), np.cumsum(size)
        at = 0
        while at < len(place):
            to = max(at + 1, int(np.searchsorted(end, end[at] - size[at] + CELLS, "right")))
            some = size[at:to]
            before = np.cumsum(some) - some
            both += np.bincount(self.owner[np.arange(some.sum()) + np.repeat(self.first[place[at:to]] - before, some)], minlength=len(self.n))
            at = to
        alike = both / (self.n + len(own) - both)
        better = alike > self.best
        self.best[better], self.of[better] = alike[better], id_

    def found(self, kind: pa.DataType) -> Batches:
        if self.met and (at := np.flatnonzero(self.best)).size:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(self.h1, np.int64)[at]), pa.array(np.array(self.h2, np.int64)[at]), pa.array(self.of[at].tolist(), kind), pa.array(self.best[at])], ["h1", "h2", "filed", "similarity"])


def _compare(kind: pa.DataType) -> Callable[[Batches], Batches]:
    """block, part, filed, id, h1, h2, text, in this order -> h1 and h2 of the new, filed, similarity."""

    def run(batches: Batches) -> Batches:
        deal, block = None, _Block()
        for batch in batches:
            blocks, parts, filed, ids, h1, h2 = (batch.column(i).to_pylist() for i in range(6))
            for at, h, first in shingles(batch.column(6)):
                n1, n2 = names(h, first)
                for j in range(len(first) - 1):
                    i = at + j
                    if (n1[j], n2[j]) != (h1[i], h2[i]):  # another row of that id
                        continue
                    if (blocks[i], parts[i]) != deal:
                        yield from block.found(kind)
                        deal, block = (blocks[i], parts[i]), _Block()
                    own = h[first[j] : first[j + 1]]
                    if filed[i]:
                        block.meet(ids[i], own)
                    else:
                        block.add(h1[i], h2[i], own)
        yield from block.found(kind)

    return run


def near_duplicates(new: DataFrame, filed: DataFrame, least: float = 0.8, id_: str = "id", text: str = "text") -> DataFrame:
    """id, duplicate_of, similarity: for each new text that is like a filed one, the filed text most like it, ties by id."""
    texts = lambda df, side: df.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), F.lit(side).alias("filed"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    kind = filed.select(id_).schema[0].dataType
    both = texts(new, False).unionAll(texts(filed, True))
    signed = scratch.stage(both.mapInArrow(_sign, f"id {both.schema['id'].dataType.simpleString()}, filed boolean, h1 long, h2 long, n int, keys array<long>"))
    mine, theirs = signed.where("not filed").drop("filed"), signed.where("filed").drop("filed")
    name = ["h1", "h2"]
    # grouped before they are joined, so many copies of a text are few rows by then
    same = theirs.groupBy(name).agg(F.min("id").alias("filed"))
    same = scratch.stage(same.join(mine.select(name).distinct(), name).withColumn("similarity", F.lit(1.0)))
    key = F.explode("keys").alias("key")
    rest = mine.join(same, name, "left_anti").groupBy(name).agg(F.min(F.struct("id", "n", "keys")).alias("r")).select(*name, "r.*")
    rest = scratch.stage(rest.select(*name, "id", "n", key))
    hit = theirs.select("id", *name, key).join(rest.select("key").distinct(), "key").groupBy(*name, "key").agg(F.min("id").alias("id"))
    hit = scratch.stage(hit)
    rest = scratch.stage(rest.join(hit.select("key").distinct(), "key", "left_semi"))
    ours = scratch.stage(rest.groupBy(name).agg(F.min("id").alias("id"), F.min("n").alias("n")))
    classes, held = ours.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-classes // CLASSES), -(-held // SHINGLES))
    block = F.pmod(F.xxhash64(*name), F.lit(blocks)).cast("int").alias("block")
    met = scratch.stage(hit.join(rest.select(block, "key").distinct(), "key").groupBy(*name, "block").agg(F.min("id").alias("id")))
    parts = max(1, -(-met.count() // (blocks * HOT)))
    ours = ours.select(block, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", *name)
    dealt = met.select("block", F.pmod(F.xxhash64(*name), F.lit(parts)).cast("int").alias("part"), "id", *name)
    order = ["block", "part", "filed", "id", *name, "text"]
    rows = texts(new, False).join(ours, "id").select(order).unionAll(texts(filed, True).join(dealt, "id").select(order))
    rows = rows.repartition(blocks * parts, "block", "part").sortWithinPartitions("block", "part", "filed", "id")
    found = rows.mapInArrow(_compare(to_arrow_type(kind)), f"h1 long, h2 long, filed {kind.simpleString()}, similarity double")
    best = found.unionAll(same.select(found.columns)).where(F.col("similarity") >= least).groupBy(name).agg(F.min(F.struct((-F.col("similarity")).alias("s"), "filed")).alias("b"))
    # rows that repeat an id count as one text, as like as its likest
    return mine.join(best, name).groupBy("id").agg(F.min("b").alias("b")).select("id", F.col("b.filed").alias("duplicate_of"), F.round(-F.col("b.s"), 6).alias("similarity"))
