"""The vector index, keyword search, joins on time, the near-duplicate check and the walk on small fixtures with odd rows."""

import datetime as dt
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.operators import ann, graph, intervals, keyword, neardup, search

NAN = float("nan")


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 30 centres, one vector repeated, and rows that no list takes."""
    r = np.random.default_rng(2)
    centres = r.standard_normal((30, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 30] + r.standard_normal(16)], i % 5) for i in range(1500)]
    rows += [(i, rows[7][1], 1) for i in range(1500, 2000)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [1.0], 1), (2004, [NAN] * 16, 1), (None, rows[0][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_index(spark, tmp_path, clustered):
    """Every usable row is in one list; all lists give the exact answer; a few give nine in ten of it, from fewer files."""
    index = ann.build(clustered, f"file://{tmp_path}/index", lists=20)
    stored = spark.read.parquet(f"{index.path}/lists")
    assert stored.select(F.explode("ids").alias("id")).agg(F.count("id"), F.count_distinct("id")).first()[:] == (2000, 2000)
    usable = clustered.where("vec_id < 2000")
    asked = usable.where("vec_id % 100 = 0")
    exact = search.search_block(usable, asked, 10).cache()
    key = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    loaded = ann.load(spark, index.path)
    assert key(ann.search_many(loaded, asked, 10, loaded.lists)) == key(exact)
    n = ann.enough_probes(loaded, asked, exact, 10)
    assert n < loaded.lists / 2
    got = ann.recall(ann.search_many(loaded, asked, 10, n), exact, 10).first()
    assert got.queries == 20 and got.recall >= 0.9
    one = usable.where("vec_id = 3").first().embedding
    few = ann.search(spark, loaded, one, 5, n)
    assert [r.id for r in few.collect()][:1] == [3]
    assert re.search(r"PartitionFilters: \[[^]]*list", few._jdf.queryExecution().toString())
    none = ann.build(clustered.where("1 = 0"), f"file://{tmp_path}/none")
    assert ann.search(spark, none, one, 5, 1).count() == 0 and ann.search_many(none, asked, 5, 1).count() == 0


def test_bm25_of_odd_rows(spark):
    rows = [(1, "The cat sat. The CAT!"), (2, None), (3, "  "), (None, "cat"), (4, "dog " * 5000 + "cat"), (5, "Cat"), (5, "cat")]
    texts = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(1, "cat cat CAT"), (2, None), (3, "nothing here")], "query_id long, text string")
    got = keyword.bm25(keyword.index(texts), queries, 3).orderBy("rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 5), (1, 1), (1, 4)]
    assert keyword.bm25(keyword.index(texts.where("1 = 0")), queries, 3).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (2, 10, 1)], "query_id long, id long, rank int")
    got = [(r.query_id, r.id, r.rank) for r in keyword.fuse(2, a, b).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, 1), (1, 10, 2), (2, 10, 1)]
    relevant = spark.createDataFrame([(1, 11), (2, 99)], "query_id long, id long")
    assert [(r.ranker, r.recall) for r in keyword.report(1, relevant, a=a, b=b).orderBy("ranker").collect()] == [("a", 0.0), ("b", 0.5)]


# --- time -----------------------------------------------------------------------------------------------------------


def moments(seed, n, entities):
    r = random.Random(seed)
    start = dt.datetime(1969, 12, 1)
    at = lambda: r.choice([None, start + dt.timedelta(seconds=r.choice([r.randrange(100), r.randrange(10**7), r.randrange(3 * 10**9)]))])
    return [(i, r.choice([None, *entities, entities[0], entities[0]]), at(), at()) for i in range(n)]


def test_points_in_intervals(spark):
    """Against all pairs: intervals of seconds and of decades, open at either end, empty ones, times before 1970, nulls."""
    facts, points = moments(1, 300, "abc"), moments(2, 200, "abc")
    f = spark.createDataFrame(facts, "fact long, key string, valid_from timestamp, valid_to timestamp")
    p = spark.createDataFrame([x[:3] for x in points], "point long, key string, at timestamp")
    out = intervals.within(p, f, "key", "at")
    want = sorted((i, j) for i, k, t, _ in points for j, l, a, b in facts if k is not None and k == l and t is not None and (a is None or a <= t) and (b is None or b > t))
    assert sorted((r.point, r.fact) for r in out.collect()) == want and want
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert intervals.within(p, f.where("1 = 0"), "key", "at").count() == 0


def test_last_before(spark):
    """Against a scan, with ties, other bucket widths, and keys and times that are null."""
    facts, points = moments(3, 300, "ab"), moments(4, 200, "abz")
    facts += [(1000 + i, "a", facts[i][2], None) for i in range(0, 100)]
    f = spark.createDataFrame([x[:3] for x in facts], "fact long, key string, since timestamp")
    p = spark.createDataFrame([x[:3] for x in points], "point long, key string, at timestamp")
    want = {}
    for i, k, t, _ in points:
        fit = [(s, j) for j, l, s, _ in facts if k is not None and k == l and t is not None and s is not None and s <= t]
        want[i] = max(fit)[1] if fit else None
    for bucket in (60, 86_400, 10**8):
        got = intervals.last_before(p, f, "key", "at", "since", ["fact"], bucket=bucket)
        assert got.columns == ["point", "key", "at", "since", "fact"]
        assert {r.point: r.fact for r in got.collect()} == want


def test_hot_key_is_dealt_by_time(spark):
    """One key with all rows is many window partitions, and many join keys."""
    t = spark.range(2000).select(F.lit("hot").alias("key"), F.timestamp_seconds(F.col("id") * 3600).alias("at"), "id")
    f = t.select("key", F.col("at").alias("valid_from"), (F.col("at") + F.expr("interval 1 hour")).alias("valid_to"), F.col("id").alias("fact"))
    assert intervals.within(t, f, "key", "at").where("fact = id").count() == 2000
    assert intervals.last_before(t, f.withColumnRenamed("valid_from", "since"), "key", "at", "since", ["fact"]).where("fact = id").count() == 2000


# --- near duplicates ------------------------------------------------------------------------------------------------


def sets(text, n=5):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").lower()) if x]
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("hot", [1000, 5])
def test_near_duplicates(spark, monkeypatch, hot):
    """Against all pairs; with a small bound, a template's keys are dealt over parts."""
    monkeypatch.setattr(neardup, "HOT", hot)
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [" ".join(word() for _ in range(60)) for _ in range(30)]
    template = " ".join(word() for _ in range(120))
    vary = lambda t: " ".join(word() if r.random() < 0.01 else w for w in t.split())
    filed = [(i, vary(t)) for i, t in enumerate(base * 3)] + [(100 + i, f"{template} {word()}") for i in range(40)] + [(200, None), (201, " "), (202, "two words"), (None, base[0]), (203, "x " * 50_000)]
    new = [(i, vary(t)) for i, t in enumerate(base)] + [(50, f"{template} {word()}"), (51, None), (52, ""), (53, "Two  WORDS"), (54, "three more words"), (None, base[1]), (55, "x " * 50_000)]
    df = lambda rows: spark.createDataFrame(rows, "id long, text string")
    got = {x.id: (x.duplicate_of, x.similarity) for x in neardup.near_duplicates(df(new), df(filed)).collect()}
    want = {}
    for i, t in new:
        alike = [(-len(sets(t) & sets(u)) / len(sets(t) | sets(u)), j) for j, u in filed if i is not None and j is not None and sets(t) and sets(u)]
        best = min((x for x in alike if x[0] <= -0.8), default=None)
        if best:
            want[i] = (best[1], round(-best[0], 6))
    assert got == want and {50, 53, 55} <= set(got)
    assert neardup.near_duplicates(df(new), df(filed).where("1 = 0")).count() == 0


# --- the walk -------------------------------------------------------------------------------------------------------


def test_walk_of_a_long_chain(spark):
    """Ten steps down a chain of fifty rooms, and a plan that does not grow with them."""
    rows = [(f"r{i}", f"w{j}") for i in range(50) for j in (i, i + 1)] + [(None, "w1"), ("r1", None)]
    d = spark.createDataFrame(rows, "room string, wing string")
    out = graph.traverse(d, "wing", "room", "r0", 10)
    assert sorted((r.hops, r.room) for r in out.collect()) == [(i, f"r{i}") for i in range(11)]
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(out) - size(graph.traverse(d, "wing", "room", "r0", 2))) < 100
    assert graph.traverse(d, "wing", "room", "absent", 3).count() == 1
