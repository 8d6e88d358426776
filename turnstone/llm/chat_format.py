"""Chat formatting of typed content parts, with DataFrame functions alone.

A turn has a role and an array of parts (PART). A visitor over the parts, by type, turns them into one ordered text:
text parts are escaped, an image, audio or document part becomes its placeholder mark, and its reference, place and
expanded token count (what an encoder would put in its stead) are recorded. Turns of a conversation, by turn, are then
written as `<|im_start|>role<|im_sep|>text<|im_end|>` and a line end; the spans of assistant texts are the loss mask, in
code points (first from 1, length) and in UTF-8 bytes, by which a reader cuts them out without a walk from the start.

Escaping is reversible: a backslash is doubled, and in every control string of CONTROLS a backslash follows the first
character; taking one backslash away before any character undoes both. No control string can then occur inside a text,
so marks split the output without ambiguity.

Places are prefix sums over the conversation's turns in a window, and the output of a conversation is one string by
contract; nothing else is gathered.

Nulls and edge cases: null text is empty; a null role is written as an empty one; a null conversation id is a
conversation of its own; null turns come first; equal turn numbers are ordered by role and text, so reruns agree;
repeated rows are turns each; a conversation's text is held whole in its row, at most 2 GB; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of public chat templates, and the placeholders of parts.
CONTROLS = (START, MIDDLE, END, "<|endoftext|>", "<|image|>", "<|audio|>", "<|document|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Tokens that a part expands to: a patch of an image, a second of audio, a page of a document.
PATCH, A_SECOND, A_PAGE = 14, 25, 600
LEARNT = "assistant"

PART = T.StructType().add("type", "string").add("text", "string").add("ref", "string").add("width", "integer").add("height", "integer").add("seconds", "double").add("pages", "integer")


def escape(text: Column) -> Column:
    return reduce(lambda x, s: F.replace(x, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROLS, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def visit(part: Column) -> Column:
    """A part's text, attachment reference (null for text) and expanded tokens."""
    kind = F.coalesce(part["type"], F.lit("text"))
    mark = F.lit(None).cast("string")
    for k, v in PLACEHOLDERS.items():
        mark = F.when(kind == k, F.lit(v)).otherwise(mark)
    zero = F.lit(0).cast("long")
    tokens = (
        F.when(kind == "image", F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * A_SECOND))
        .when(kind == "document", (F.coalesce(part["pages"], F.lit(0)) * A_PAGE).cast("long"))
        .otherwise(zero)
    )
    return F.struct(F.coalesce(mark, escape(F.coalesce(part["text"], F.lit("")))).alias("text"), F.when(mark.isNotNull(), F.coalesce(part["ref"], F.lit(""))).alias("ref"), kind.alias("type"), tokens.alias("tokens"))


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, parts) -> conv_id, formatted, loss_spans (start from 1, length, byte_start from 1,
    byte_length), attachments (turn from 0, place in the turn from 0, type, ref, tokens) and expanded_tokens, a row a
    conversation."""
    own = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.transform(F.coalesce("parts", F.array().cast(T.ArrayType(PART))), visit).alias("parts"))
    own = own.withColumn("body", F.array_join(F.transform("parts", lambda p: p["text"]), ""))
    own = own.withColumn("head", F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))).withColumn("line", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    begin = lambda size: F.sum(size("line")).over(upto) - size("line") + size("head") + 1
    own = own.withColumn("n", F.row_number().over(order)).withColumn("begin", begin(F.length)).withColumn("byte", begin(F.octet_length))
    row = F.struct("n", "line", "begin", F.length("body").alias("size"), "byte", F.octet_length("body").alias("bytes"), (F.col("role") == LEARNT).alias("learnt"), "parts")
    whole = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    attached = F.flatten(
        F.transform(
            "rows",
            lambda r: F.filter(
                F.transform(r["parts"], lambda p, i: F.struct((r["n"] - 1).alias("turn"), i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))),
                lambda a: a["ref"].isNotNull(),
            ),
        )
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["learnt"]), lambda r: F.struct(r["begin"].cast("int").alias("start"), r["size"].alias("length"), r["byte"].cast("int").alias("byte_start"), r["bytes"].alias("byte_length"))).alias("loss_spans"),
        attached.alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_back(chats: DataFrame) -> DataFrame:
    """The digest of formatted conversations, from formatted and loss_spans alone."""
    turns = F.filter(F.split("formatted", f"\\Q{START}\\E"), lambda x: x != "")
    parted = F.transform(turns, lambda x: F.concat(unescape(F.substring_index(x, MIDDLE, 1)), F.lit("\n"), unescape(F.substring_index(F.substring_index(x, MIDDLE, -1), END, 1)), F.lit("\n")))
    # the bytes are a lambda's variable, made once, not once a span
    cuts = F.transform(F.array(F.col("formatted").cast("binary")), lambda b: F.transform("loss_spans", lambda s: F.substring(b, s["byte_start"], s["byte_length"]).cast("string")))[0]
    learnt = F.array_join(F.transform(cuts, unescape), "")
    out = chats.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.array_join(parted, "").alias("all"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("conv_id", "n_turns", sha("all").alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), sha("learnt").alias("loss_sha256"), "formatted_chars")


PROBE = "</s>[INST] ok [/INST]"


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and conversation -1, whose texts hold control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.sql(f"SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{PROBE}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    part = F.struct(F.lit("text").alias("type"), "text", *(F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields[2:]))
    return read_back(format_chats(rows.unionByName(probe).select("conv_id", "turn", "role", F.array(part).alias("parts"))))


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for s in CONTROLS:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS a,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = '{LEARNT}'), '') AS l,
  sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len(START + MIDDLE + END) + 1})::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(a) AS turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, formatted_chars FROM g
"""
