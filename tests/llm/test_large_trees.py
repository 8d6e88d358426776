"""Large trees of texts that share keys and do not link: what links is in one tree still, and few texts meet others."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import jaccard_join as join


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100)])
def test_what_links_shares_the_told_keys(num, den):
    rng = np.random.default_rng(num)
    shared = 0
    for n in (1, 2, 5, 9, 20, 34, 62, 63, 64, 150, 400, 1000, 4317, 6000):
        for share in (0.0, 0.3, 0.9):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            frequent = np.sort(base[rng.random(n) < share])
            sets = [np.unique(base)]
            for _ in range(12):
                out = rng.integers(0, max(1, n * (den - num) // den) + 1)
                more = rng.integers(0, max(1, n * (den - num) // num) + 1)
                sets.append(np.unique(np.concatenate((rng.permutation(base)[out:], rng.integers(0, 1 << 63, more, dtype=np.uint64) * np.uint64(2)))))
            first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            level, both = join.told_signatures(np.concatenate(sets), first, num, den, frequent)
            told = [[(set(key[at[i] : at[i + 1]].tolist()), need[i]) for key, at, need in both] for i in range(len(sets))]
            for i in range(len(sets)):
                for j in range(i):
                    same = len(np.intersect1d(sets[i], sets[j]))
                    if den * same < num * (len(sets[i]) + len(sets[j]) - same) or len(sets[i]) == len(sets[j]) == same:
                        continue
                    top = max(level[i], level[j])
                    (a, a_need), (b, b_need) = told[i][top - level[i]], told[j][top - level[j]]
                    assert len(a & b) >= max(a_need, b_need, 1), (n, share)
                    shared += max(a_need, b_need) > 1
    assert shared > 100


def test_texts_that_share_passages_do_not_all_meet(spark, monkeypatch):
    """A ring of texts, of which each shares a passage with the next: one tree, no links but those of a few near copies."""
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{i}" for i in rng.integers(0, 10**9, n)]
    passages = [words(190) for _ in range(240)]
    made = [[*passages[i], *words(100), *passages[i - 1]] for i in range(240)]
    rows = [(i, " ".join(x)) for i, x in enumerate(made)]
    rows += [(1000 + i, " ".join([*made[i][:-3], "x", "y", "z"])) for i in range(0, 240, 40)]
    moved, trees, links, sizes = [], [], join._links, join._sizes

    def count(texts, places, *more):
        moved.append(places.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0])
        return links(texts, places, *more)

    def size(*args):
        out = sizes(*args)
        trees.append(out.agg(F.max("members")).first()[0])
        return out

    monkeypatch.setattr(join, "_links", count)
    monkeypatch.setattr(join, "_sizes", size)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in join.jaccard_components(df, 5, 80, 100, leaf_docs=16).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert trees[0] > 100  # keys alone hold this many together
    assert sum(moved) < 2 * len(rows)
