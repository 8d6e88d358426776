"""Line-first cleaning: each line is judged by punctuation, navigation and boilerplate rules, failing lines go, and a
document that loses too much of its words is rejected.

A line with a word fails when one of these holds:

- punctuation: over 1 in SYMBOL_SHARE of its characters is one of `#*$%&|<>`, or it has at most FRAGMENT words and none
  of its last characters ends a sentence or clause while the document has other lines;
- navigation: SEPARATORS or more of its words are bare separators (`|`, `>`, `/`, `-`, `*`, `·`, `»`, `•`);
- boilerplate: it has at most FURNITURE words and holds one of the fixed phrases of four languages, with no letter, digit
  or other character of a word next to it, or it equals an earlier line of the document.

A document is kept unless the base check failed (under 20 words, or over 30 of 100 words in 8-word windows that the text
repeats) or its failing lines hold over MAX_LOSS of its words.

Nulls and edge cases: a null or empty text has no words and fails the base check; a null doc_id is carried through;
repeated rows are judged alike; extra columns are ignored; an empty table gives an empty result. Texts are processed
whole, in pieces of whole rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as scan
from .common import binary, only, pieces

PIECE = 2 << 20
SYMBOL_SHARE, FRAGMENT, SEPARATORS, FURNITURE, MAX_LOSS = 10, 3, 3, 20, 0.5
MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 30

# Phrases of page furniture, in lower case; English, French, German, Spanish.
PHRASES = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "click here",
    "read more",
    "skip to content",
    "sign up",
    "log in",
    "subscribe to our newsletter",
    "share this",
    "back to top",
    "lorem ipsum",
    "tous droits réservés",
    "politique de confidentialité",
    "mentions légales",
    "conditions d'utilisation",
    "accepter les cookies",
    "cliquez ici",
    "lire la suite",
    "se connecter",
    "haut de page",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookies akzeptieren",
    "hier klicken",
    "weiterlesen",
    "nach oben",
    "todos los derechos reservados",
    "política de privacidad",
    "aviso legal",
    "términos de uso",
    "aceptar cookies",
    "haga clic aquí",
    "leer más",
    "iniciar sesión",
)
# Characters that count as symbols, that end a clause, and that stand alone as separators.
SYMBOLS = b"#*$%&|<>"
CLAUSE_ENDS = b".!?,;:)\"'"
SEPARATOR_WORDS = ("|", ">", "/", "-", "*", "·", "»", "•")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_END = np.zeros(256, bool)
_END[list(CLAUSE_ENDS)] = True
_CHARACTER = np.ones(256, bool)
_CHARACTER[0x80:0xC0] = False
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[0x80:] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost_words long, base_failed boolean, kept boolean, clean_text string"


def _sums(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(x, dtype=np.int64)))


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its key occurs twice or more, and whether an equal one stands before it."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    later[order[1:]] = same
    return twice, later


def judge(buf: np.ndarray, offsets: np.ndarray, texts: bool) -> dict[str, np.ndarray | list]:
    """The figures of each row of a batch, and the cleaned texts where asked for."""
    rows = len(offsets) - 1
    w, h = scan.Words(buf, offsets), scan.Hashes(buf)
    n_words = w.counts()
    per_row = lambda x: _sums(x)[offsets[1:]] - _sums(x)[offsets[:-1]]
    characters = _CHARACTER[buf]
    out = {"n_words": n_words, "word_chars": per_row(characters & w.solid), "n_symbols": per_row(_SYMBOL[buf])}

    word_hash = h.of(w.start, w.end)
    salt = scan.mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    run = scan.windows(word_hash, WINDOW)
    inside = w.row[WINDOW - 1 :] == w.row[: len(run)] if len(run) else np.zeros(0, bool)
    spots = np.flatnonzero(inside)
    twice, _ = _repeated(run[spots] ^ salt[w.row[spots]])
    cover = np.zeros(len(w.start) + 1, np.int64)
    cover[spots[twice]] += 1
    cover[spots[twice] + WINDOW] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(w.row[covered], minlength=rows)

    # lines: bounds at \n and at the rows' bounds
    breaks = np.flatnonzero(buf == 0x0A)
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    start = np.union1d(offsets[filled], breaks + 1)
    start = start[start < len(buf)]
    end = np.minimum(np.append(start[1:], len(buf)), len(buf))
    end = np.where((end > start) & (buf[np.maximum(end - 1, 0)] == 0x0A) if len(buf) else False, end - 1, end)
    first = np.searchsorted(w.start, start)
    words = np.searchsorted(w.start, end) - first
    start, end, first, words = (x[words > 0] for x in (start, end, first, words))
    row = np.searchsorted(offsets, start, "right") - 1
    _, later = _repeated(h.of(start, end) ^ salt[row])
    out["n_dup_lines"] = np.bincount(row[later], minlength=rows)

    symbols, length = _sums(_SYMBOL[buf]), _sums(characters)
    lines = np.bincount(row, minlength=rows)[row]
    last = w.end[first + words - 1] - 1 if len(first) else np.zeros(0, int)
    bad = (symbols[end] - symbols[start]) * SYMBOL_SHARE > length[end] - length[start]
    bad |= (words <= FRAGMENT) & ~_END[buf[last]] & (lines > 1)
    separator = np.isin(word_hash, _SEPARATOR_HASHES)
    between = _sums(separator)
    bad |= between[first + words] - between[first] >= SEPARATORS
    lower = scan.LOWER[buf].tobytes()
    for phrase in _PHRASE_BYTES:
        at = lower.find(phrase)
        while at >= 0:
            i, to = int(np.searchsorted(start, at, "right")) - 1, at + len(phrase)
            if i >= 0 and to <= end[i] and words[i] <= FURNITURE and not (at > start[i] and _IN_WORD[buf[at - 1]]) and not (to < end[i] and _IN_WORD[buf[to]]):
                bad[i] = True
            at = lower.find(phrase, at + 1)
    bad |= later
    out["lost_words"] = np.bincount(row[bad], words[bad], rows).astype(np.int64)
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT * n_words)
    out["kept"] = ~out["base_failed"] & (out["lost_words"] <= MAX_LOSS * n_words)
    if texts:
        gone = np.zeros(len(buf) + 1, np.int8)
        gone[start[bad]] += 1
        gone[np.minimum(end[bad] + 1, offsets[row[bad] + 1])] -= 1  # with its line end
        stays = np.cumsum(gone[:-1]) == 0
        out["clean_text"] = [buf[a:b][stays[a:b]].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    else:
        out["clean_text"] = [None] * rows
    return out


def _hash(words: tuple[str, ...]) -> np.ndarray:
    out = []
    for word in words:
        buf = np.frombuffer(word.encode(), np.uint8)
        out.append(scan.Hashes(buf).of(np.array([0]), np.array([len(buf)]))[0])
    return np.array(out)


_SEPARATOR_HASHES = _hash(SEPARATOR_WORDS)
_PHRASE_BYTES = tuple(p.encode() for p in PHRASES)
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def _judge(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, ids = binary(batch, "text"), batch.column(batch.schema.get_field_index("doc_id"))
            for at, to in pieces(text, PIECE):
                found = judge(*scan.view(text, at, to), texts)
                kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "clean_text": pa.string()}
                yield pa.RecordBatch.from_arrays([ids.slice(at, to - at), *(pa.array(found[c], kinds.get(c, pa.int64())) for c in _COLUMNS[1:])], _COLUMNS)

    return run


def clean_lines(docs: DataFrame, texts: bool = True) -> DataFrame:
    """SCHEMA for every row of docs (doc_id, text); clean_text is the text without failing lines (null without texts)."""
    return only(docs, doc_id="long", text="string").mapInArrow(_judge(texts), SCHEMA)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The figures and verdict of every document."""
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False).drop("clean_text")
