"""The operators on vectors against brute force, and on nulls, ties, repeats, odd lengths, hot groups and empty tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import code_compression as codes
from turnstone.llm import embedding_dedup as dedup
from turnstone.llm import hard_negatives as negatives
from turnstone.llm import vectors

NAN, INF = float("nan"), float("inf")
ODD = [
    (None, [1.0, 0.0, 0.0, 0.0], 1),
    (1, None, 1),
    (2, [], 1),
    (3, [1.0, 0.0], 1),
    (4, [1.0, None, 0.0, 0.0], 1),
    (5, [NAN, 0.0, 0.0, 0.0], 1),
    (6, [INF, 0.0, 0.0, 0.0], 1),
    (7, [0.0, 0.0, 0.0, 0.0], 1),
    (8, [1.0, 0.0, 0.0, 0.0], None),
    (9, [1e30, 0.0, 0.0, 0.0], 1),
    (10, [1.0, 0.0, 0.0, 0.0], 1),
    (10, [1.0, 0.0, 0.0, 0.0], 1),
    (10, [1.0, 0.0, 0.0, 0.0], 2),
    (11, [2.0, 0.01, 0.0, 0.0], 1),
    (100, [1.0, 0.2, 0.0, 0.0], 1),
    (101, [1.0, 0.9, 0.0, 0.0], 2),
    (102, [1.0, 0.9, 0.0, 0.0], 2),
]
CLASH = ("id", "h", "n", "key", "code", "error", "part", "a", "v", "meta.lang")


def table(spark, rows, *more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.select("*", *(F.lit(9).alias(c) for c in more))


def usable(v, width=4):
    return v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)


def cloud(n, width=16, labels=3, seed=1, copies=0, near=0):
    """Random vectors, copies of one, and near copies of another."""
    r = np.random.default_rng(seed)
    v = r.standard_normal((n, width))
    v[:copies] = v[0]
    v[copies : copies + near] = v[copies] + 0.02 * r.standard_normal((near, width))
    return [(i, [float(np.float32(x)) for x in row], int(i % labels) if i >= copies + near else 1) for i, row in enumerate(v)]


# --- partial-distance search ----------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    kept = sorted((r for r in rows if usable(r[1], len(rows[0][1]))), key=lambda r: r[0])
    x = np.floor(256 * np.array([r[1] for r in kept])).astype(int)
    cuts = [i * x.shape[1] // parts for i in range(parts + 1)]
    books = [x[:entries, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    near = lambda: [((x[:, None, a:b] - book) ** 2).sum(2) for book, a, b in zip(books, cuts, cuts[1:])]
    for _ in range(rounds):
        for book, d, a, b in zip(books, near(), cuts, cuts[1:]):
            at = d.argmin(1)
            for e in range(len(book)):
                if (at == e).any():
                    book[e] = x[at == e, a:b].sum(0) // (at == e).sum()
    d = near()
    digest = hashlib.sha256(",".join(str(v) for book in books for v in book.ravel()).encode()).hexdigest()
    return {r[0]: (bytes(int(m[i].argmin()) for m in d), sum(int(m[i].min()) for m in d)) for i, r in enumerate(kept)}, digest


@pytest.mark.parametrize("size", [1, 5, 40, 64])
def test_partial_distances(size):
    """As a full search, ties to the lower index, for entries that repeat and rows far from all."""
    r = np.random.default_rng(size)
    book = r.integers(-4, 5, (size, 4))
    rows = np.concatenate([r.integers(-6, 7, (3000, 4)), book, [[10**6, -(10**6), 0, 1]]])
    full = ((rows[:, None] - book) ** 2).sum(2)
    at, d = codes.nearest(rows, book)
    assert (at == full.argmin(1)).all() and (d == full.min(1)).all()
    assert codes.nearest(rows[:, :0], book[:, :0])[1].sum() == 0


def test_codes(spark):
    rows = cloud(500, copies=50)
    books = codes.fit(table(spark, rows), parts=4, entries=32)
    want, digest = brute_codes(rows, 4, 32, 2)
    got = {r.vec_id: (bytes(r.code), r.error) for r in codes.encode(table(spark, rows), books, "vec_id").collect()}
    assert got == want and books.sha256() == digest
    assert np.abs(books.decode(got[0][0]) - rows[0][1]).max() < 4


def test_codes_of_odd_rows(spark):
    df = table(spark, ODD, *CLASH)
    books = codes.fit(df)
    assert books.width == 4 and len(books.entries) == 16 and [b.shape[1] for b in books.entries].count(1) == 4
    out = codes.with_label_error(codes.encode(df, books, "vec_id", "label")).collect()
    assert len(out) == sum(usable(r[1]) for r in ODD)
    for label in (None, 1, 2):
        own = [r for r in out if r.label == label]
        assert {r.label_error for r in own} == {sum(r.error for r in own)}
    assert codes.fit(df.where("1 = 0")) is None and codes.fit(table(spark, [(1, None, 1), (2, [], 1)])) is None
    short = codes.fit(table(spark, [(1, [1.0, 2.0], 1), (2, [1.0, NAN], 1)]), parts=2)
    assert [b.tolist() for b in short.entries] == [[[256]], [[512]]]


# --- hard negatives -------------------------------------------------------------------------------------------------


def brute_negatives(rows, every=100, positives=5, negatives_=10):
    kept = [(i, np.clip(np.floor(256 * np.array(v)), -vectors.MOST, vectors.MOST).astype(int).tolist(), label) for i, v, label in rows if i is not None and label is not None and usable(v, len(rows[0][1]))]
    out = []
    for a in sorted({r[0] for r in kept if r[0] % every == 0}):
        _, v, label = min((r for r in kept if r[0] == a), key=lambda r: (r[2], r[1]))
        scored = sorted(((-sum(p * q for p, q in zip(v, r[1])), r[0], r[2]) for r in kept if r[0] != a))
        for s, i, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives_]
            out += [(a, i, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fit)]
    return sorted(out)


def mined(df, every=100):
    return sorted(tuple(r) for r in negatives.mine(df, F.col("id") % every == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("least,block", [(512, 4096), (16, 7)])
def test_negatives(spark, monkeypatch, least, block):
    """Small chunks and blocks give what large ones give; copies and ties included."""
    monkeypatch.setattr(negatives, "LEAST", least)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", max(least, 20))
    rows = cloud(600, copies=200, near=50)
    assert mined(table(spark, rows), 20) == brute_negatives(rows, 20)


def test_negatives_of_large_integers(spark):
    """Scores past what doubles hold exactly."""
    rows = [(i, [x * 200_000 for x in v], label) for i, v, label in cloud(120, width=8)]
    assert mined(table(spark, rows), 10) == brute_negatives(rows, 10)


def test_negatives_of_odd_rows(spark):
    df = table(spark, ODD, *CLASH)
    assert mined(df) == brute_negatives(ODD)
    assert mined(df.where("1 = 0")) == [] and mined(df.where("vec_id = 100")) == [] and mined(df.where("vec_id < 3")) == []


def test_bounds_certify():
    """Every row of a cell lies within its bounds; on data with structure most cells are never scanned."""
    r = np.random.default_rng(3)
    centres = r.standard_normal((40, 8)) * 300
    x = np.floor(centres[r.integers(0, 40, 4000)] + r.standard_normal((4000, 8)) * 5).astype(int)
    norm = (x * x).sum(1)
    whole = np.c_[x, np.sqrt(norm.max() - norm)]
    pivots = negatives._pivots(whole[:500])
    d = np.sqrt(((whole[:, None] - pivots) ** 2).sum(2))
    own, near = d.argmin(1), d.min(1)
    index = negatives.Index(8, float(norm.max()), pivots, np.arange(len(pivots)), *(np.array([f(near[own == p]) if (own == p).any() else 0 for p in range(len(pivots))]) for f in (np.min, np.max)), np.bincount(own, minlength=len(pivots)), np.ones(len(pivots), int), "")
    asked = x[:50]
    _, most, least = index.bounds(asked)
    scores = asked @ x.T
    assert (scores <= most[:, own] + 1e-6).all() and (scores >= least[:, own] - 1e-6).all()
    tenth = np.sort(scores, axis=1)[:, -10:-9].astype(float)
    want = index.wanted(asked, tenth, np.full((50, 1), 1e18), (0, 1))
    assert want.mean() < 0.25
    assert all(want[q, own[np.argsort(-scores[q])[:9]]].all() for q in range(50))


# --- near dedup -----------------------------------------------------------------------------------------------------


def brute_near(rows, cosine):
    """Links and the smallest id reachable, by place."""
    width = len(rows[0][1])
    ok = [i for i, (k, v, label) in enumerate(rows) if k is not None and label is not None and usable(v, width) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.max(np.abs(rows[i][1])) for i in ok}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    near = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= cosine] for i in ok}
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((k, len(near.get(i, [])), least, k is None or k == least))
    return sorted(out, key=repr)


def deduped(df, cosine=0.98):
    return sorted((tuple(r) for r in dedup.near_duplicates(df, cosine).select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("block", [8192, 16])
def test_near(spark, monkeypatch, block):
    """Small parts give what large ones give: groups of copies and of near copies that fill many parts."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    rows = cloud(400, copies=120, near=100)
    assert deduped(table(spark, rows)) == brute_near(rows, 0.98)


def test_near_of_odd_rows(spark):
    df = table(spark, ODD, *CLASH)
    assert deduped(df) == brute_near([(k, v if v is None or len(v) == 4 else None, label) for k, v, label in ODD], 0.98)
    assert deduped(df.where("1 = 0")) == []
    assert deduped(table(spark, [(1, None, 1), (None, None, None)])) == [(1, 0, 1, True), (None, 0, None, True)]


def test_recall_at_the_bound(spark):
    """Pairs at the bound itself, each alone: nine in ten at least are found, in fact nearly all."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(500):
        a, b = r.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), 1), (2 * i + 1, (0.9801 * a + np.sqrt(1 - 0.9801**2) * b).tolist(), 1)]
    out = dedup.near_duplicates(table(spark, rows))
    assert out.where("n_links = 1").count() >= 980 and out.where("n_links > 1").isEmpty()


def test_joined_sets():
    root = np.arange(8)
    dedup._joined(root, np.array([5, 3, 1, 6]), np.array([3, 1, 7, 4]))
    assert root.tolist() == [0, 1, 2, 1, 4, 1, 4, 1]
