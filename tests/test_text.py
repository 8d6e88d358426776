"""Golden values of scalar operators and sequence operators."""

import pytest
from pyspark.sql import functions as F

from turnstone.functions import text as x
from turnstone.operators import graph, ops, turns

TURNS = ["Let us plan the trip to the coast", "Sure, the coast in spring is quiet", "What about trains", "Trains leave hourly"]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("parts", "want"),
    [
        (("/data/a.jsonl", None, None, "hello", "general answer text over twenty"), 1030732136172688200),
        (("/data/a.jsonl", "conv-1", None, "hello", "world"), 294426698169247066),
        ((" /data/a.jsonl ", "conv-1", "", "hello\n", "\tworld"), 294426698169247066),
        (("/data/b.jsonl", "conv-1", None, "hello", "world"), 21319014176450211),
        ((None, "same"), 276501831784451039),
        (("", "same"), 276501831784451039),
    ],
)
def test_stable_id(spark, parts, want):
    assert one(spark, x.stable_id(*(F.lit(p).cast("string") for p in parts)))[0] == want


def test_document_id(spark):
    assert one(spark, x.document_id(F.lit("/notes/n.md"), F.lit("Title"), F.lit("Body text of the note, long enough.")))[0] == 206248119165830638


@pytest.mark.parametrize(("n", "want"), [(219, 219), (220, 220), (221, 220)])
def test_preview(spark, n, want):
    got = one(spark, x.preview(F.lit("a" * n)))[0]
    assert len(got) == want and got.endswith("...") == (n > 220)


def test_labels(spark):
    row = one(spark, x.infer_label(F.lit("/x/Second_era/a"), ("first", "second-era"), "none"), x.normalise_label(F.lit(" Second_Era "), ("second-era",), "none"), x.normalise_label(F.lit("bad"), ("second-era",), "none"), x.source_label(F.lit("")), x.source_label(F.lit("/a/b.md")))
    assert tuple(row) == ("second-era", "second-era", "none", "source pending", "b.md")
    ids = [x.coerce_id(F.lit(i).cast("string")) for i in ("0012345", "018f-x", "9" * 25, None)]
    got = one(spark, *(F.to_json(i) for i in ids))
    assert tuple(got) == ("12345", '"018f-x"', "9" * 25, None)
    eras = one(spark, *(x.configured_label(e, F.lit("/x/first/a"), ("first", "second-era"), "none") for e in ("Second_Era", "bad", None, "")))
    assert tuple(eras) == ("second-era", "none", "first", "first")


def test_redaction(spark):
    texts = {
        'OPENAI_API_KEY="abcdefghijklmnop" sk-' + "a" * 20: 'OPENAI_API_KEY=REDACTED" sk-REDACTED',
        "sk-" + "a" * 19: "sk-" + "a" * 19,
        "sk-proj-" + "a" * 30: "sk-proj-" + "a" * 30,
        "Anthropic-Api-Key : x-y_z1234567 on": "ANTHROPIC_API_KEY=REDACTED on",
        "AIzaSy" + "b" * 20: "AIzaSyREDACTED",
        'token = "abc"': 'token = "abc"',
    }
    assert list(one(spark, *(x.redact(F.lit(t)) for t in texts))) == list(texts.values())
    # the patterns as they stand match only where backslashes are in the text
    key = "OPENAI_API_KEY=abcdefghijklmnop"
    odd = "OPENAI_API_KEY\\s=\\'abcdefghijklmnop"
    assert one(spark, x.redact(F.lit(key), x.LITERAL_SECRETS))[0] == key
    assert one(spark, x.redact(F.lit('token = "abc"'), (*x.SECRETS, x.TOKEN_ASSIGNMENT)))[0] == 'token="REDACTED"'


@pytest.mark.parametrize(("n", "want"), [(10, 210), (100, 500), (1000, 1100)])
def test_playback(spark, n, want):
    assert one(spark, x.playback_delay(F.lit(n), 2.0))[0] == want


def test_matching(spark):
    t = spark.createDataFrame([(1, i, s) for i, s in enumerate(TURNS)], "conv int, turn int, text string")
    assert turns.match_exact(t, "conv", "turn", "TRAINS LEAVE").first().matched == 3
    row = turns.match_fuzzy(t, "conv", "turn", "plan trip coast").first()
    assert (row.matched, round(row.ratio, 3)) == (0, 0.625)


@pytest.mark.parametrize(("center", "want"), [(1, [0, 4]), (9, [6, 9])])
def test_context_range(spark, center, want):
    t = spark.range(10).select(F.lit(1).alias("conv"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    got = turns.full_context(t, spark.createDataFrame([(1, center)], "conv int, center long"), "conv", "turn", 3).first()
    assert (got.context_range, got.total_turns, [r["index"] for r in got.turns]) == (want, 10, list(range(want[0], want[1] + 1)))


def test_facts(spark):
    f = spark.createDataFrame([("a", "likes", "b", 1, 5), ("a", "likes", "c", 5, None), ("d", "knows", "a", None, None)], "subject string, predicate string, object string, valid_from int, valid_to int")
    assert {r.object for r in graph.as_of(f, F.lit(5)).collect()} == {"c", "a"}
    assert sorted(r.direction for r in graph.about(f, "a").collect()) == ["incoming", "outgoing", "outgoing"]
    assert graph.invalidate(f, "a", "likes", "c", F.lit(9)).where("valid_to = 9").count() == 1
    assert [r.object for r in graph.timeline(f, "a").collect()] == ["a", "b", "c"]


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "id int, batch int, v string")
    assert {(r.id, r.v) for r in ops.latest(df, "id", "batch").collect()} == {(1, "new"), (2, "only")}
