"""Scalar expressions over text: trimming, ids, labels, previews, prompts and redaction.

All are built-in functions of the JVM, so they stay inside generated code and push below exchanges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT_SEPARATOR = "\x1f"
ID_HEX_DIGITS = 15
# Lengths that results must equal.
RESPONSE_CHARS, THINKING_CHARS, DOCUMENT_ID_CHARS = 2000, 500, 2048
PREVIEW_CHARS, NEEDLE_CHARS, HAYSTACK_CHARS = 220, 200, 500
RESULT_INPUT_CHARS, RESULT_RESPONSE_CHARS = 500, 1000
MIN_RESPONSE_CHARS = 20
PROMPT_CHARS, EXCERPT_CHARS, SHORT_ID_CHARS = 8000, 150, 18
# What counts as a secret, and what it becomes. Two patterns stand as they are meant, since in LITERAL_SECRETS
# their doubled backslashes match no ordinary assignment.
SECRETS = (
    (r"sk-[A-Za-z0-9]{20,}", "sk-REDACTED"),
    (r"(?i)anthropic[_-]?api[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9_-]{10,}", "ANTHROPIC_API_KEY=REDACTED"),
    (r"(?i)openai[_-]?api[_-]?key\s*[:=]\s*['\"]?[A-Za-z0-9_-]{10,}", "OPENAI_API_KEY=REDACTED"),
    (r"AIzaSy[A-Za-z0-9_-]{20,}", "AIzaSyREDACTED"),
)
LITERAL_SECRETS = (
    SECRETS[0],
    (r"(?i)anthropic[_-]?api[_-]?key\\s*[:=]\\s*['\\\"]?[A-Za-z0-9_-]{10,}", "ANTHROPIC_API_KEY=REDACTED"),
    (r"(?i)openai[_-]?api[_-]?key\\s*[:=]\\s*['\\\"]?[A-Za-z0-9_-]{10,}", "OPENAI_API_KEY=REDACTED"),
    SECRETS[3],
)
#: A generic assignment of a quoted token, for those who want more than the fixed patterns.
TOKEN_ASSIGNMENT = (r'(?i)(token|secret|password|api_key)\s*=\s*"[^"]+"', '$1="REDACTED"')


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")


def first_filled(*options: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in options))


def stable_id(*parts: Column) -> Column:
    """60-bit id: the first hex digits of the MD5 of the stripped parts, joined by the unit separator; null is empty."""
    joined = F.concat_ws(UNIT_SEPARATOR, *(F.coalesce(strip(p.cast("string")), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(joined), 1, ID_HEX_DIGITS), 16, 10).cast("bigint")


def memory_id(source: Column, conversation: Column, user: Column, answer: Column, turn_key: Column | None = None) -> Column:
    return stable_id(source, conversation, F.lit("") if turn_key is None else turn_key, user, answer)


def document_id(source: Column, title: Column, body: Column) -> Column:
    return stable_id(source, title, F.substring(body, 1, DOCUMENT_ID_CHARS))


def coerce_id(x: Column) -> Column:
    """Digits as a number, anything else as it is: a VARIANT."""
    number = x.try_cast("decimal(38,0)")
    return F.when(x.rlike("^[0-9]{1,38}$"), F.coalesce(x.try_cast("bigint").cast("variant"), number.cast("variant"))).otherwise(x.cast("variant"))


def preview(x: Column, chars: int = PREVIEW_CHARS) -> Column:
    flat = strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= chars, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, chars - 3)), F.lit("...")))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def source_label(path: Column) -> Column:
    blank = strip(F.coalesce(path, F.lit(""))).isin("", "unknown")
    return F.when(blank, F.lit("source pending")).otherwise(basename(path))


def normalise_label(x: Column, allowed: Sequence[str], default: str) -> Column:
    clean = F.replace(F.lower(strip(F.coalesce(x, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(clean.isin(*allowed), clean).otherwise(F.lit(default))


def infer_label(path: Column, ordered: Sequence[str], default: str) -> Column:
    """The first of the ordered labels that the path contains."""
    clean = F.replace(F.lower(F.coalesce(path, F.lit(""))), F.lit("_"), F.lit("-"))
    return reduce(lambda rest, label: F.when(clean.contains(label), F.lit(label)).otherwise(rest), reversed(ordered), F.lit(default))


def configured_label(given: str | None, path: Column, ordered: Sequence[str], default: str) -> Column:
    """A label that is configured counts, or the default where it is none of the allowed; only without one does the path
    tell."""
    return normalise_label(F.lit(given), ordered, default) if given else infer_label(path, ordered, default)


def embed_text(user: Column, answer: Column, name: str = "Assistant", thinking: Column | None = None, answer_chars: int | None = RESPONSE_CHARS) -> Column:
    cut = answer if answer_chars is None else F.substring(answer, 1, answer_chars)
    out = F.concat(F.lit("User: "), user, F.lit(f"\n{name}: "), cut)
    if thinking is None:
        return out
    return F.concat(out, F.when(F.coalesce(thinking, F.lit("")) != "", F.concat(F.lit("\nThinking: "), F.substring(thinking, 1, THINKING_CHARS))).otherwise(F.lit("")))


def redact(x: Column, patterns: Sequence[tuple[str, str]] = SECRETS) -> Column:
    return reduce(lambda y, p: F.regexp_replace(y, *p), patterns, x)


def playback_delay(chars: Column, speed: float) -> Column:
    return F.least(F.lit(2200), F.greatest(F.lit(420), chars * 10)) / F.lit(speed)


def unusable_key(x: Column, commands: Sequence[str] = ("printf ",)) -> Column:
    """Whether a key that is given cannot be real: a placeholder, with white space inside, or a command. Null and empty
    ones are not given."""
    clean = strip(F.coalesce(x, F.lit("")))
    return (clean != "") & (clean.startswith("PASTE_") | clean.rlike(r"\s") | reduce(lambda a, c: a | clean.contains(c), commands, F.lit(False)))


def redact_home(x: Column, home: str) -> Column:
    """For a support bundle: the home folder as ~, and secrets taken out."""
    tokens = ((r"([A-Z_]*API_KEY)\s*=\s*\S+", "$1=REDACTED"), (r"gho_[A-Za-z0-9]+", "gho_REDACTED"))
    return redact(F.replace(x, F.lit(home), F.lit("~")), tokens)


def percent(score: Column) -> Column:
    """0.8731 as 87.3%."""
    return F.concat(F.format_number(F.bround(score * 100, 1), 1), F.lit("%"))


def grouped(count: Column) -> Column:
    """28930 as 28,930."""
    return F.format_number(count, 0)


def short_id(id_: Column) -> Column:
    return F.substring(id_.cast("string"), 1, SHORT_ID_CHARS)


def day(stamp: Column) -> Column:
    """The date of epoch seconds or an ISO stamp, whichever the string is; null where it is neither."""
    seconds = F.timestamp_seconds(stamp.try_cast("double"))
    return F.date_format(F.coalesce(seconds, F.try_to_timestamp(stamp)), "yyyy-MM-dd")
