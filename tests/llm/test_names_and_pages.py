"""Columns whose names hold dots, and pages of broken HTML."""

import time

from pyspark.sql import functions as F

from turnstone.llm import exact_dedup, jaccard_join, source_mixing, toxicity, url_filter

LONG = " ".join(f"word{i}" for i in range(60))


def test_names_with_dots(spark):
    """What returns the columns as they are does so whatever they are called."""
    rows = [(1, LONG, "a"), (2, LONG, "a"), (3, LONG + " more", "b"), (4, "short text", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"meta.lang": F.lit("en"), "a`b": F.lit(1), "x_.y": F.lit(2)})
    for out, ids in ((exact_dedup.drop_copies(docs), {1, 3, 4}), (jaccard_join.keep_one_of_each(docs), {1, 4}), (source_mixing.repeat_taken(docs), {1, 2, 3, 4})):
        assert out.columns == docs.columns
        assert {r.doc_id for r in out.select("doc_id", "`meta.lang`").collect()} <= ids
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = toxicity.drop_toxic(docs, toxicity.fit(docs, labels))
    assert out.columns == docs.columns and out.count() == 4


def test_broken_html_is_read_once(spark):
    """A megabyte of tags, comments and scripts that never close, in under a second each, and what stands before them counts."""
    good = '<link rel="canonical" href="http://b.org/x">'
    for piece in ("<script", "<script>", "<link", "<link ", '<link href="', "<!--", "<style>", "<meta content='", "<", '"', "<base ", "<!-- --><script></script>"):
        page = good + piece * (1_000_000 // len(piece))
        began = time.perf_counter()
        assert url_filter.targets("http://a.org/", url_filter.tags_of(page)) == ["http://b.org/x"]
        assert time.perf_counter() - began < 1, piece
    spaces = f'<meta http-equiv="refresh" content="0{" " * 300_000}; {" " * 300_000} url=  /y{" " * 300_000}z">'
    began = time.perf_counter()
    assert len(url_filter.targets("http://a.org/", url_filter.tags_of(spaces))) == 1
    assert time.perf_counter() - began < 1
    pages = spark.createDataFrame([(1, "http://a.net/", "<link rel=canonical " * 50_000), (2, "http://c.org/", None)], "page_id long, url string, html string")
    assert {(r.page_id, r.verdict) for r in url_filter.judge(pages).collect()} == {(1, "block"), (2, "allow")}


def test_tags():
    html = "<!-- <link a> --><SCRIPT>'<link b>'</script ><style><meta c></style><link d='>'><links><meta e><link f"
    assert url_filter.tags_of(html) == ["<link d='>'>", "<meta e>"]
