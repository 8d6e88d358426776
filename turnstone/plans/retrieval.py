"""Index-backed retrieval bound to the test tables: vector lists, keyword search, fused rankings, near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnstone.operators import ann, keyword, neardup, search
from turnstone.plans.catalogue import _RANKED, _SCORE, _vector, query, table
from turnstone.sources import scratch


def _index(spark, sf):
    return ann.build(table(spark, sf, "embeddings"), f"{scratch.folder(spark)}/index")


def _asked(spark, sf):
    return table(spark, sf, "embeddings").where(F.col("vec_id") % 100 == 0)


@query(f"SELECT query_id, id, score, rank FROM ({_RANKED})")
def ann_all_lists(spark, sf):
    """Probing every list of an index is the exact search."""
    index = _index(spark, sf)
    return ann.search_many(index, _asked(spark, sf), 10, index.lists)


@query(f"SELECT vec_id AS id, {_SCORE} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 5")
def ann_one_query(spark, sf):
    """One query against an index that was written and loaded again."""
    index = _index(spark, sf)
    return ann.search(spark, ann.load(spark, index.path), _vector(spark, sf), 5, index.lists)


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(spark, sf):
    """Recall of a part of the lists against the exact search, over all ids divisible by 100."""
    index, asked = _index(spark, sf), _asked(spark, sf)
    exact = scratch.stage(search.search_block(table(spark, sf, "embeddings"), asked, 10))
    probes = ann.enough_probes(index, asked, exact, 10)
    return ann.recall(ann.search_many(index, asked, 10, probes), exact, 10).select("queries", (F.col("recall") >= 0.9).alias("enough"))


# --- keywords -------------------------------------------------------------------------------------------------------

_TERMS = "list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda w: w <> '')"


def _bm25(queries: str) -> str:
    """query_id, id, score of every text that shares a term with a query (query_id, term)."""
    return f"""(WITH t AS MATERIALIZED (SELECT doc_id AS id, {_TERMS.format(c='text')} AS terms FROM documents), n AS MATERIALIZED (SELECT id, len(terms) AS length FROM t),
p AS MATERIALIZED (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM t) GROUP BY ALL), f AS MATERIALIZED (SELECT term, count(*) AS df FROM p GROUP BY term), q AS MATERIALIZED ({queries})
SELECT query_id, id, round(sum(ln(1 + (texts - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))), 6) AS score
FROM q JOIN p USING (term) JOIN n USING (id) JOIN f USING (term), (SELECT count(*) AS texts, avg(length) AS mean_length FROM n) GROUP BY query_id, id)"""


def _top(scores: str, k: int, where: str = "true") -> str:
    return f"(SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM {scores} WHERE {where}) WHERE rank <= {k})"


@query(f"SELECT * FROM {_top(_bm25('SELECT DISTINCT item_id AS query_id, unnest(' + _TERMS.format(c='text') + ') AS term FROM benchmark'), 10)}")
def bm25_topk(spark, sf):
    """Passages as queries; the index is written and read again."""
    path = f"{scratch.folder(spark)}/index"
    keyword.index(table(spark, sf, "documents"), "doc_id").write(path)
    return keyword.bm25(keyword.Inverted.read(spark, path), table(spark, sf, "benchmark"), 10, "item_id")


_HEAD = f"SELECT DISTINCT doc_id AS query_id, unnest({_TERMS.format(c='text')}[1:8]) AS term FROM documents WHERE doc_id % 100 = 0"
_SEMANTIC = f"(SELECT query_id, id, score, rank FROM ({_RANKED}))"
_KEYWORD = _top(_bm25(_HEAD), 10, "id <> query_id")
_FUSED = _top(f"(SELECT query_id, id, round(sum(1 / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM {_SEMANTIC} UNION ALL SELECT query_id, id, rank FROM {_KEYWORD}) GROUP BY ALL)", 10)


def _rankings(spark, sf):
    """Of every hundredth row its vector's neighbours, and the texts that the first words of its own find."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    semantic = scratch.stage(search.search_block(e, _asked(spark, sf), 10))
    heads = d.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), F.array_join(F.slice(keyword.terms(F.col("text")), 1, 8), " ").alias("text"))
    found = keyword.bm25(keyword.index(d, "doc_id"), heads, 11)
    words = scratch.stage(keyword.ranked(found.where("id <> query_id").drop("rank"), 10))
    return semantic, words, keyword.fuse(10, semantic, words)


@query(f"SELECT * FROM {_FUSED}")
def rank_fusion(spark, sf):
    return _rankings(spark, sf)[2]


_REPORT = " UNION ALL ".join(
    f"SELECT '{name}' AS ranker, round(avg((dcg IS NOT NULL)::INT), 4) AS recall, round(avg(coalesce(dcg, 0) / ideal), 4) AS ndcg FROM (SELECT q.query_id, any_value((SELECT sum(1 / log2(range + 1)) FROM range(1, 11) WHERE range <= q.wanted)) AS ideal FROM wanted q GROUP BY q.query_id) LEFT JOIN (SELECT r.query_id, sum(1 / log2(r.rank + 1)) AS dcg FROM {sql} r JOIN relevant USING (query_id, id) GROUP BY r.query_id) USING (query_id)"
    for name, sql in (("semantic", _SEMANTIC), ("keyword", _KEYWORD), ("fused", _FUSED))
)


@query(f"WITH relevant AS (SELECT q.vec_id AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0), wanted AS (SELECT query_id, count(*) AS wanted FROM relevant GROUP BY 1) {_REPORT}")
def ranking_report(spark, sf):
    """Recall and NDCG at 10 of the semantic, the keyword and the fused ranking; rows of the same label are relevant."""
    semantic, words, fused = _rankings(spark, sf)
    e, fused = table(spark, sf, "embeddings"), scratch.stage(fused)
    # all rows of a query's label would be pairs as the square of the table: only those that a ranking holds are joined
    asked = _asked(spark, sf).select(F.col("vec_id").alias("query_id"), "label")
    totals = asked.join(e.groupBy("label").agg((F.count("*") - 1).alias("wanted")), "label").where("wanted > 0").select("query_id", "wanted")
    pairs = semantic.select("query_id", "id").unionByName(words.select("query_id", "id")).unionByName(fused.select("query_id", "id")).distinct()
    relevant = pairs.where("id <> query_id").join(asked, "query_id").join(e.select(F.col("vec_id").alias("id"), "label"), ["id", "label"]).select("query_id", "id")
    return keyword.report(10, scratch.stage(relevant), scratch.stage(totals), semantic=semantic, keyword=words, fused=fused)


# --- near duplicates ------------------------------------------------------------------------------------------------

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SHINGLES = f"SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0"


@query(f"WITH s AS MATERIALIZED ({_SHINGLES}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS id, b.doc_id AS filed, count(*) AS shared FROM s a JOIN s b USING (s) WHERE a.doc_id % 100 = 0 AND b.doc_id % 100 <> 0 GROUP BY ALL) SELECT id, filed AS duplicate_of, round(sim, 6) AS similarity FROM (SELECT id, filed, shared / (x.n + y.n - shared) AS sim FROM p JOIN n x ON x.doc_id = id JOIN n y ON y.doc_id = filed) WHERE sim >= 0.8 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, filed) = 1")
def near_duplicate_check(spark, sf):
    """Every hundredth document against all others."""
    d = table(spark, sf, "documents")
    return neardup.near_duplicates(d.where(F.col("doc_id") % 100 == 0), d.where(F.col("doc_id") % 100 != 0), 0.8, "doc_id")
