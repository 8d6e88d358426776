"""Packed keys: what is dealt, gathered and told apart equals a dictionary's answer."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa

from turnstone.llm import jaccard_join as join


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


def test_shared_keys(monkeypatch):
    monkeypatch.setattr(join, "PACKED", 16)  # deals of several rows
    rng = np.random.default_rng(0)
    packed, held = [join._packs(np.zeros(0, np.int32), _none(), _none(), None)], defaultdict(set)
    for _ in range(6):
        key, v = rng.integers(-50, 50, 300), rng.integers(-8, 8, 300) * (1 << 60)
        for a, b in zip(key.tolist(), v.tolist(), strict=True):
            held[a].add(b)
        packed.append(join._packs((key % 4).astype(np.int32), v, key, None))
    told = join._packs(np.array([1, 0], np.int32), np.array([7, 8]), np.array([1000, 1001]), np.array([3, 4]))
    batches = pa.Table.from_batches([*packed, told]).sort_by("deal").to_batches(max_chunksize=3)
    got = {row for b in join._shared(iter(batches)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    want = {(v, k, min(s)) for k, s in held.items() if len(s) > 1 for v in s} | {(7, 1000, 3), (8, 1001, 4)}
    assert got == want


def test_no_keys():
    assert sum(b.num_rows for b in join._shared(iter([]))) == 0


def test_packs_stay_small_in_many_deals():
    """A row costs what tells its key and vertex in its deal, however few rows of a vertex a deal has."""
    rng = np.random.default_rng(1)
    deal = np.repeat(np.arange(400, dtype=np.int32), 500)
    key = join.named(deal, rng.integers(-(1 << 63), (1 << 63) - 1, len(deal)))
    v = join.vertices(rng.integers(0, 1 << 62, 2000), np.ones(2000, np.int64))[rng.integers(0, 2000, len(deal))]
    packed = join._packs(deal, v, key, None)
    assert sum(len(x) for c in ("key", "v", "times") for x in packed.column(c).to_pylist()) < 13 * len(deal)
    twice = pa.Table.from_batches([packed, join._packs(deal, v + 1, key, None)]).sort_by("deal").to_batches()
    got = {row for b in join._shared(iter(twice)) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert got == {(a + up, k, a) for a, k in zip(v.tolist(), key.tolist(), strict=True) for up in (0, 1)}
