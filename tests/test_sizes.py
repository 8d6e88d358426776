"""What larger tables showed: times that round, names that are urls' names as well, queries that meet every text."""

import datetime

import duckdb
import pytest

from turnstone.operators import keyword, neardup
from turnstone.plans import catalogue


def agree(spark, folder, name):
    """Rows of a query on a folder of tables, once they are those of its SQL."""
    df = catalogue.QUERIES[name](spark, str(folder))
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in folder.glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    found = c.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    return rows


@pytest.mark.parametrize("name", ["event_windows_late", "kg_asof"])
@pytest.mark.parametrize("last", [3600 * 96 + 1.6, 3600 * 96 + 2.2, 3600 * 96 + 3.0])
def test_times_that_round(spark, tmp_path, name, last):
    """Events around the middle, which lies half a second further on where the ends' seconds round up."""
    start = datetime.datetime(2024, 1, 1)
    at = [0.0, 0.6, *(3600 * 48 + x / 4 for x in range(-8, 16)), *(3600 * 24 + x / 4 for x in range(-8, 16)), last]
    rows = [(i, start + datetime.timedelta(seconds=s), i % 3, "view", 1.0, '{"k": %d}' % i) for i, s in enumerate(at)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert agree(spark, tmp_path, name)


def test_names_of_other_urls(spark, tmp_path):
    """Pages whose number, or name and number, is the name of another page's url; one without a url."""
    urls = [(1, "http://a/en/7/"), (2, "http://a/en/1"), (3, "http://a/en/72"), (4, "http://b/fr/723"), (5, "http://a/en/x"), (6, None), (7, "http://b/fr/72"), (8, "http://a/en/x5"), (13, "http://c/de/"), (21, "http://c/de/1"), (23, "http://a/en/7")]
    spark.createDataFrame(urls, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    rows = agree(spark, tmp_path, "resolve_paths")
    assert ("http://a/en/72", None) in rows and ("http://c/de/", "/moved/13") in rows and (None, None) in rows


def test_best_rows_of_a_task(spark):
    """Of a query whose term every text holds, a task hands on k rows and no more; ids that repeat count once."""
    texts = spark.range(0, 3000, 1, 2).selectExpr("id", "concat('the ', if(id % 7 = 0, 'cat', 'dog')) AS text")
    queries = spark.createDataFrame([(1, "the"), (2, "the cat")], "query_id long, text string")
    found = keyword.bm25(keyword.index(texts.union(texts.where("id = 14"))), queries, 3)
    assert [(r.query_id, r.id) for r in found.orderBy("query_id", "rank").collect()] == [(1, 14), (1, 0), (1, 1), (2, 14), (2, 0), (2, 7)]
    # no scores are summed by query and text after a shuffle
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()


def most_rows(plan):
    """Of the nodes of a plan that has run."""
    kind, metric = plan.getClass().getSimpleName(), plan.metrics().get("numOutputRows")
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return max([metric.get().value() if metric.isDefined() else 0, *map(most_rows, below)])


def test_texts_of_one_template(spark):
    """Near copies of a template, 300 filed and 100 new: as many rows as texts, not as pairs; one is filed already."""
    texts = spark.range(400).selectExpr("id", "concat(array_join(transform(sequence(1, 100), i -> concat('w', i)), ' '), ' x', if(id = 8, 7, id)) AS text")
    found = neardup.near_duplicates(texts.where("id % 4 = 0"), texts.where("id % 4 > 0"))
    assert sorted(map(tuple, found.collect())) == [(i, 7, 1.0) if i == 8 else (i, 1, round(96 / 98, 6)) for i in range(0, 400, 4)]
    assert most_rows(found._jdf.queryExecution().executedPlan()) <= 400
