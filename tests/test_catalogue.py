"""Every query of the catalogue runs, and agrees with its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from turnstone.operators import graph
from turnstone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET python_enable_replacements = false")
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=repr)
    if name in catalogue.ORACLE_SQL:
        found = duck.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        want = sorted(([plain(r[names.index(c)]) for c in columns] for r in found.fetchall()), key=repr)
        assert got == want


def test_graph_of_rooms(spark):
    """Rooms of one, two and three wings."""
    rows = [("a", "en"), ("a", "fr"), ("a", "fr"), ("s", "en"), ("b", "fr"), ("b", "de"), ("c", "es"), ("d", "de"), ("d", "it"), ("e", "it"), ("f", None)]
    d = spark.createDataFrame([(i, room, wing, f"h{i}", f"t{i}") for i, (room, wing) in enumerate(rows)], "id long, room string, wing string, hall string, filed_at string")
    got = {(r.room, tuple(r.wings), tuple(r.halls), r["count"], r.recent) for r in graph.tunnels(d, "wing", "room", "hall", "filed_at").collect()}
    assert got == {("a", ("en", "fr"), ("h0", "h1", "h2"), 3, "t2"), ("b", ("de", "fr"), ("h4", "h5"), 2, "t5"), ("d", ("de", "it"), ("h7", "h8"), 2, "t8")}
    assert [r.room for r in graph.tunnels_between(d, "wing", "room", "en", "fr").collect()] == ["a"]
    row = graph.graph_stats(d, "wing", "room", 2).first()
    assert (row.total_rooms, row.tunnel_rooms, row.total_edges, row.rooms_per_wing) == (6, 3, 3, {"en": 2, "fr": 2, "de": 2, "es": 1, "it": 2})
    assert [(r.room, r.wings, r["count"]) for r in row.top_tunnels] == [("a", ["en", "fr"], 3), ("b", ["de", "fr"], 2)]
    assert {tuple(r) for r in graph.traverse(d, "wing", "room", "s", 2).collect()} == {("s", 0), ("a", 1), ("b", 2)}
    empty = graph.graph_stats(d.where("1 = 0"), "wing", "room").first()
    assert (empty.total_rooms, empty.total_edges, empty.rooms_per_wing, empty.top_tunnels) == (0, 0, {}, [])
