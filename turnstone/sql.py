"""The service's tools and the turn operators, callable by name from SQL.

register(spark) adds, for the session:

- pair_turns(TABLE(t) PARTITION BY key ORDER BY index, role => ..., content => ...): each asking turn whose next one answers.
- context_frames(TABLE(t) PARTITION BY key ORDER BY index, k => 2): the frame of k turns around each turn.
  Both take a conversation as a partition and keep only its last turns: memory does not grow with it.
- vector_sum(v): the sum of a group's vectors, one matrix a group. As any Python aggregate it needs a group's rows together, so
  group by (key, salt) first and sum the sums, as the query label_centroids does.
- embed(text), cosine(a, b): the hashed embedder, and similarity.

register_tools(spark, points, personas) adds table functions over a DataFrame of memories: summon, remember, rehydrate,
retrieve and stats. They are SQL functions, which Catalyst inlines: filters on the persona reach the scan, and only the
best rows of each task leave it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from turnstone.functions import text as x
from turnstone.functions.vectors import hashed_counts, matrix
from turnstone.operators.memory import NOTE, Persona


def _column(schema: T.StructType, given: AnalyzeArgument | None, default: str) -> str:
    name = given.value if given is not None else default
    if name not in schema.fieldNames():
        raise ValueError(f"the table has no column {name}: {schema.fieldNames()}")
    return name


class PairTurns:
    """State is the last turn, so a conversation of any length passes through."""

    @staticmethod
    def analyze(turns: AnalyzeArgument, key: AnalyzeArgument | None = None, index: AnalyzeArgument | None = None, role: AnalyzeArgument | None = None, content: AnalyzeArgument | None = None) -> AnalyzeResult:
        schema = turns.dataType
        names = [_column(schema, a, d) for a, d in ((key, "conv_id"), (index, "turn"), (role, "role"), (content, "text"))]
        out = T.StructType([schema[names[0]], schema[names[1]], T.StructField("user_text", T.StringType()), T.StructField("assistant_text", T.StringType())])
        return AnalyzeResult(out)

    def __init__(self) -> None:
        self.last: tuple | None = None

    def eval(self, turns: object, key: str = "conv_id", index: str = "turn", role: str = "role", content: str = "text") -> Iterator[tuple]:
        now = (turns[key], turns[index], turns[role], turns[content])
        before, self.last = self.last, now
        if before and before[2] == "user" and now[2] == "assistant" and before[3] and now[3]:
            yield before[0], before[1], before[3], now[3]


class ContextFrames:
    """State is the 2k + 1 turns around the one whose frame is next."""

    @staticmethod
    def analyze(turns: AnalyzeArgument, k: AnalyzeArgument, key: AnalyzeArgument | None = None, index: AnalyzeArgument | None = None, content: AnalyzeArgument | None = None) -> AnalyzeResult:
        schema = turns.dataType
        if not k.isConstantExpression or not isinstance(k.value, int) or k.value < 0:
            raise ValueError("k is a number of turns, 0 or more")
        names = [_column(schema, a, d) for a, d in ((key, "conv_id"), (index, "turn"), (content, "text"))]
        of = schema[names[1]].dataType
        return AnalyzeResult(T.StructType([schema[names[0]], schema[names[1]], T.StructField("from_turn", of), T.StructField("to_turn", of), T.StructField("frame_chars", T.LongType())]))

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.before, self.k = 0, 0  # turns held that have had their frame

    def _frame(self) -> tuple:
        at = self.held[self.before]
        near = self.held[max(0, self.before - self.k) : self.before + self.k + 1]
        self.before += 1
        if self.before > self.k:
            self.held.pop(0)
            self.before -= 1
        sizes = [n for _, _, n in near if n is not None]
        return at[0], at[1], near[0][1], near[-1][1], sum(sizes) if sizes else None

    def eval(self, turns: object, k: int, key: str = "conv_id", index: str = "turn", content: str = "text") -> Iterator[tuple]:
        self.k = k
        text = turns[content]
        self.held.append((turns[key], turns[index], None if text is None else len(text)))
        if len(self.held) - self.before > k:
            yield self._frame()

    def terminate(self) -> Iterator[tuple]:
        while self.before < len(self.held):
            yield self._frame()


def _vector_sum(v: pa.Array) -> list[float] | None:
    widths = {n for n in v.value_lengths().to_pylist() if n}
    if len(widths) > 1:
        raise ValueError("vectors of different widths")
    return matrix(v, widths.pop())[0].sum(axis=0).tolist() if widths else None


def _cosine(a: pa.Array, b: pa.Array) -> pa.Array:
    if pa.types.is_null(a.type) or pa.types.is_null(b.type):
        return pa.nulls(len(a), pa.float64())
    out = np.full(len(a), np.nan)
    same = np.asarray(a.value_lengths().fill_null(-1)) == np.asarray(b.value_lengths().fill_null(-2))
    for width in set(np.asarray(a.value_lengths().fill_null(0))[same].tolist()) - {0}:
        own = same & (np.asarray(a.value_lengths().fill_null(-1)) == width)
        p, q = (matrix(c.filter(pa.array(own)), width)[0] for c in (a, b))
        with np.errstate(divide="ignore", invalid="ignore"):
            out[own] = (p * q).sum(axis=1) / (np.linalg.norm(p, axis=1) * np.linalg.norm(q, axis=1))
    return pa.array(out, mask=~np.isfinite(out))


def register(spark: SparkSession) -> None:
    spark.udtf.register("pair_turns", F.udtf(PairTurns))
    spark.udtf.register("context_frames", F.udtf(ContextFrames))

    @F.arrow_udf("array<double>")
    def vector_sum(v: pa.Array) -> list:
        return _vector_sum(v)

    @F.arrow_udf("double")
    def cosine(a: pa.Array, b: pa.Array) -> pa.Array:
        return _cosine(a, b)

    spark.udf.register("vector_sum", vector_sum)
    spark.udf.register("cosine", cosine)
    spark.udf.register("hashed_counts", hashed_counts())
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION embed(t STRING) RETURNS ARRAY<FLOAT> RETURN hashed_counts(transform(filter(split(lower(coalesce(t, '')), '\\s+'), w -> w <> ''), w -> cast(conv(substring(md5(w), 1, 8), 16, 10) AS BIGINT)))")


def register_tools(spark: SparkSession, points: DataFrame, personas: Sequence[Persona]) -> None:
    """points: persona, id, embedding, user_input, ai_response, source_file. Unknown personas have no rows."""
    register(spark)
    points.createOrReplaceTempView("memory_points")
    schema = "key string, title string, description string"
    spark.createDataFrame([(p.key, p.title, p.description) for p in personas], schema).createOrReplaceTempView("memory_personas")
    make = lambda name, of, out, body: spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({of}) RETURNS TABLE({out}) RETURN {body}")
    hit = "point_id STRING, score DOUBLE, user_input STRING, ai_response STRING, source_file STRING"
    scored = "SELECT id, round(cosine(embedding, embed(summon.question)), 4) AS score, user_input, ai_response, source_file FROM memory_points WHERE persona = lower(summon.persona)"
    shown = f"SELECT CAST(id AS STRING), score, substring(coalesce(user_input, 'Unknown'), 1, {x.RESULT_INPUT_CHARS}), substring(coalesce(ai_response, '...'), 1, {x.RESULT_RESPONSE_CHARS}), coalesce(source_file, 'unknown')"
    make("summon", "question STRING, persona STRING, n INT", hit, f"{shown} FROM (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, id) AS rank FROM ({scored})) WHERE rank <= summon.n")
    note = NOTE.format("' || title || '")
    make("remember", "question STRING, persona STRING, n INT", f"{hit}, note STRING", f"SELECT s.*, '{note}' FROM summon(remember.question, remember.persona, remember.n) s JOIN memory_personas p ON p.key = lower(remember.persona)")
    block = "'[Relevance: ' || format_string('%.2f', round(score, 2)) || ']\nUser: ' || user_input || '\n' || initcap(p.key) || ': ' || ai_response || '\n'"
    rows = f"array_join(transform(array_sort(collect_list(struct(-score AS s, point_id AS i, {block} AS b))), r -> r.b), '\n')"
    title = "max(p.title || CASE WHEN p.description <> '' THEN '\n\n' || p.description ELSE '' END)"
    make("rehydrate", "question STRING, persona STRING, n INT", "prompt STRING", f"SELECT head || '\nCurrent query: ' || rehydrate.question FROM (SELECT '# ' || {title} || '\n\n' || {rows} AS head FROM summon(rehydrate.question, rehydrate.persona, rehydrate.n) s JOIN memory_personas p ON p.key = lower(rehydrate.persona))")
    make("retrieve", "point STRING, persona STRING", hit.replace("score DOUBLE, ", "") + ", error STRING", "SELECT retrieve.point, user_input, ai_response, source_file, CASE WHEN id IS NULL THEN 'point_not_found' END FROM (SELECT 1) LEFT JOIN (SELECT * FROM memory_points WHERE persona = lower(retrieve.persona) AND CAST(id AS STRING) = retrieve.point)")
    make("stats", "", "persona STRING, points BIGINT, available BOOLEAN", "SELECT key, coalesce(n, 0), n IS NOT NULL FROM memory_personas LEFT JOIN (SELECT persona, count(*) AS n FROM memory_points GROUP BY persona) ON key = persona")
