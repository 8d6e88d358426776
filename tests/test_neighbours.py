"""Nearest points of every point: none is left out as a query or as a point, in one block or in many."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.operators import search
from turnstone.plans import catalogue


@pytest.mark.parametrize("block", [1 << 16, 60])
def test_every_point_asks(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 330)]
    odd = [(1000, None), (1001, []), (1002, [float("nan")] * 8), (1003, [1.0]), (None, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in search.neighbours(df, 5, block=block, cells=500).collect()}
    usable = df.where("vec_id < 1000")
    assert got == {(r.query_id, r["rank"]): (r.id, r.score) for r in search.search_block(usable, usable, 5).collect()}
    assert len(got) == 330 * 5
    assert search.neighbours(df.limit(0), 5).count() == 0


def test_recall_is_of_every_row(spark, sf):
    all_ = catalogue.table(spark, sf, "embeddings").count()
    assert catalogue._neighbours(spark, sf, all_=True).agg(F.count_distinct("query_id")).first()[0] == all_
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["recall_at_k"]).fetchall()
    assert [tuple(r) for r in catalogue.recall_at_k(spark, sf).collect()] == want
