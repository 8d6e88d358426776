"""What SQL can call by name, bound to the test tables: each query is a statement for spark.sql."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone import sql
from turnstone.operators.memory import Persona
from turnstone.plans.catalogue import _ALL, _HITS, ORACLE_SQL, _two_places, query, table


def _views(spark, sf):
    sql.register(spark)
    for name in ("conversations", "embeddings"):
        table(spark, sf, name).createOrReplaceTempView(f"own_{name}")


@query(_ALL)
def sql_pair_turns(spark, sf):
    _views(spark, sf)
    return spark.sql("SELECT * FROM pair_turns(TABLE(own_conversations) PARTITION BY conv_id ORDER BY turn)")


@query(ORACLE_SQL["context_all_rows"])
def sql_context_frames(spark, sf):
    _views(spark, sf)
    return spark.sql("SELECT * FROM context_frames(TABLE(own_conversations) PARTITION BY conv_id ORDER BY turn, k => 2)")


@query("SELECT label, place::INT AS place, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS place FROM embeddings) GROUP BY ALL")
def label_centroids(spark, sf):
    """A grouped aggregate in two steps, so that a label with a third of all rows is several groups."""
    _views(spark, sf)
    # a last component of one counts the group
    parts = "SELECT label, vector_sum(concat(embedding, array(CAST(1 AS FLOAT)))) AS v FROM own_embeddings GROUP BY label, pmod(hash(vec_id), 16)"
    sums = f"SELECT label, vector_sum(v) AS v FROM ({parts}) GROUP BY label"
    return spark.sql(f"SELECT label, pos + 1 AS place, round(col / n, 6) AS mean FROM (SELECT label, slice(v, 1, size(v) - 1) AS v, element_at(v, -1) AS n FROM ({sums})) LATERAL VIEW posexplode(v) AS pos, col")


def _tools(spark, sf):
    """Documents as memories of persona ann, with the vectors of the embeddings table."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = table(spark, sf, "documents").join(e, "doc_id").select(F.when(F.col("doc_id") % 3 == 0, "bob").otherwise("ann").alias("persona"), F.col("doc_id").alias("id"), "embedding", F.col("lang").alias("user_input"), F.col("text").alias("ai_response"), F.col("source").alias("source_file"))
    sql.register_tools(spark, rows, [Persona("ann", "Ann"), Persona("bob", "Bob", "A painter"), Persona("eve", "Eve")])


@query("SELECT * FROM (VALUES ('ann'), ('bob'), ('eve')) p(persona) LEFT JOIN (SELECT CASE WHEN doc_id % 3 = 0 THEN 'bob' ELSE 'ann' END AS persona, count(*) AS points FROM documents JOIN embeddings ON doc_id = vec_id GROUP BY 1) USING (persona) WHERE points IS NOT NULL UNION ALL SELECT 'eve', 0")
def sql_stats(spark, sf):
    _tools(spark, sf)
    return spark.sql("SELECT persona, points FROM stats()")


@query("SELECT '7' AS point_id, (SELECT lang FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id = 7) AS user_input, NULL::VARCHAR AS error UNION ALL SELECT '-7', NULL, 'point_not_found'")
def sql_retrieve(spark, sf):
    _tools(spark, sf)
    return spark.sql("SELECT point_id, user_input, error FROM retrieve('7', 'Ann') UNION ALL SELECT point_id, user_input, error FROM retrieve('-7', 'ann')")


_OWN = _HITS.replace("FROM embeddings ORDER BY", "FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id IN (SELECT doc_id FROM documents) ORDER BY")


@query(f"SELECT '# Ann' || chr(10) || chr(10) || string_agg('[Relevance: ' || {_two_places('score')} || ']' || chr(10) || 'User: ' || user_input || chr(10) || 'Ann: ' || ai_response || chr(10), chr(10) ORDER BY score DESC, point_id) || chr(10) || 'Current query: what was said' AS prompt FROM ({_OWN})")
def sql_rehydrate(spark, sf):
    """The prompt from SQL; the question's vector is that of vector 0."""
    _tools(spark, sf)
    asked = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]
    values = ", ".join(f"CAST({v!r} AS FLOAT)" for v in asked)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION embed(t STRING) RETURNS ARRAY<FLOAT> RETURN array({values})")
    return spark.sql("SELECT prompt FROM rehydrate('what was said', 'ann', 5)")
