"""Toxicity: a support vector machine over a gapped subsequence string kernel, with Nystroem landmarks.

The kernel counts the three-letter subsequences two strings share, each weighted by DECAY to the power of its span in
either string, spans up to SPAN letters, is normalised, and taken to the power POWER. With a DECAY of 1 a gap costs nothing
within the span, so a letter inserted anywhere keeps all subsequences of a word and only adds some: idixot is as near to
idiot as ixdiot, and nearer than words that merely share a part. Strings are words of folded letters: case and accents go,
digits and signs that stand for letters become them, other signs inside a word are skipped, and single letters in a row
are one word, so i.d.i.o.t, id1ot and "i d i o t" are idiot. As languages tell words apart by accents, a word with an
accented vowel is also read a second time, with such vowels as letters of their own.

Training (in one task, over a bounded sample of labelled rows) works on sentences, each of which counts once however many
copies documents hold (unless there are fewer of them than documents, which then count): those of clean documents are negative; of those of a toxic document, the ones with a telling word
are positive, and so are those that the machine of the round before calls toxic; telling words also come with a letter
inserted at each place, unless clean words are as near to them. A sentence is judged by its worst word. Features are the
kernel with the landmarks (telling words, apart from each other, common clean words, and in each round the clean words that
cost most) times the inverse root of their Gram matrix; the machine has a squared hinge loss and is solved by Newton
steps; its bound is the lowest with about the fewest errors, and a logistic curve makes its value a score.

Scoring looks at every distinct word of a task once. A bound from two sums over its subsequences tells whether its value can
be over the floor; if so, its subsequences that some landmark has, times the landmarks' table, give its kernel with all.

Bounds: MAX_TOXIC and MAX_CLEAN documents of at most MAX_CHARS characters train the machine; everything is scored whole.
Rows whose crc32(doc_id as text) mod 5 is 0 never train. labels, lang, source and doc_id are no input of a score.

Nulls and edge cases: null and empty texts score as a text without words, at the floor; a null doc_id is scored and not
held out; repeated rows score alike; repeated labels of a document count as toxic if one is; without labels of both kinds,
or without a telling word, every score is next to 0; extra columns stay and are not looked at; an empty table gives an
empty result. Very long texts are scored whole, on their own."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan as scan
from .common import binary, pieces, released

MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 2000, 6000
DECAY, SPAN, POWER = 1.0, 6, 2
#: Distinct words whose values a task keeps.
MOST_KNOWN = 1_000_000
#: Words that are looked at together in training and in scoring, and the score under which texts are not told apart.
WORDS, SCORED, FLOOR = 1000, 250, 0.05
LANDMARKS, COMMON, HARD = 64, 16, 64
ROUNDS, COST = 4, 8.0
#: Standard errors by which a word must be commoner in sentences of toxic documents to be telling.
TELLS = 6.0
#: Times as many sentences of toxic as of clean documents that must hold a word before it can make a sentence positive.
RARE = 40
#: The machine's value that scores a half is no higher than MOST_BOUND; what a flagged clean document counts there.
MOST_BOUND, FALSE = 1.0, 2.0
#: Kernel value from which a clean word is like a telling one.
LIKE = 0.02
#: Other clean words that the machine sees, at least, where there are as many.
BIAS = 5000
#: Ways to insert a letter at a place, weight of a telling word with a letter inserted, and share of the clean words that
#: may be as near to the telling word.
INSERTED, SPOILT, NEAR = 1, 5.0, 0.00002
PIECE = 1 << 20

_GAPS = [(d, e) for d in range(1, SPAN) for e in range(1, SPAN) if d + e < SPAN]
_CODES = 1 << 15

# Letters (1 to 26) of ASCII letters, of signs that stand for one, and of the second bytes after 0xC3.
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(1, 27)
for _sign, _as in zip("013457@$", "oieastas", strict=True):
    _LETTER[ord(_sign)] = ord(_as) - 96
_LETTER[0x80:0xC0] = 27
_ACCENTED = np.zeros(256, np.uint8)
for _as, _from, _to in (("a", 0xA0, 0xA6), ("c", 0xA7, 0xA7), ("e", 0xA8, 0xAB), ("i", 0xAC, 0xAF), ("d", 0xB0, 0xB0), ("n", 0xB1, 0xB1), ("o", 0xB2, 0xB6), ("o", 0xB8, 0xB8), ("u", 0xB9, 0xBC), ("y", 0xBD, 0xBD), ("t", 0xBE, 0xBE), ("y", 0xBF, 0xBF)):
    _ACCENTED[_from : _to + 1] = _ACCENTED[_from - 32 : _to - 31] = ord(_as) - 96
_ACCENTED[0x9F] = ord("s") - 96
# The letters of accented vowels in the second reading.
_OWN = np.arange(32, dtype=np.uint8)
for _as, _to in (("u", 27), ("a", 28), ("e", 29), ("i", 30), ("o", 31)):
    _OWN[ord(_as) - 96] = _to
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?\n")] = True


@dataclass
class Units:
    """Folded words: letters of all, each word's first letter (and the end), row, and place in the bytes."""

    letters: np.ndarray
    first: np.ndarray
    row: np.ndarray
    at: np.ndarray


def _fold(buf: np.ndarray, offsets: np.ndarray) -> tuple[Units, np.ndarray]:
    """Folded words, and their letters in the second reading."""
    letter, after = _LETTER[buf], np.zeros(0, np.int64)
    if len(buf):
        after = np.flatnonzero(buf[:-1] == 0xC3) + 1
        letter[after] = _ACCENTED[buf[after]]
    own = letter.copy()
    own[after] = _OWN[letter[after]]
    w = scan.Words(buf, offsets)
    spots = np.flatnonzero(letter)
    word = np.searchsorted(w.start, spots, "right") - 1
    size = np.bincount(word, minlength=len(w.start))
    has = np.flatnonzero(size)
    row, single = w.row[has], size[has] == 1
    new = np.ones(len(has), bool)
    new[1:] = ~(single[1:] & single[:-1] & (row[1:] == row[:-1]))
    first = np.concatenate(([0], np.cumsum(size[has])))[:-1][new]
    return Units(letter[spots].astype(np.int32), np.append(first, len(spots)), row[new], w.start[has][new]), own[spots].astype(np.int32)


def fold(buf: np.ndarray, offsets: np.ndarray) -> Units:
    return _fold(buf, offsets)[0]


def readings(buf: np.ndarray, offsets: np.ndarray) -> Units:
    """Folded words, then the second reading of those that have one."""
    units, own = _fold(buf, offsets)
    differs = np.append(0, np.cumsum(units.letters != own))
    which = np.flatnonzero(differs[units.first[1:]] > differs[units.first[:-1]])
    letters, first = _take(own, units.first, which)
    return Units(np.concatenate((units.letters, letters)), np.concatenate((units.first, units.first[-1] + first[1:])), np.concatenate((units.row, units.row[which])), np.concatenate((units.at, units.at[which])))


def subsequences(letters: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each gap pattern: letters where one begins inside its word, its code, and its weight."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(letters))
    for d, e in _GAPS:
        spots = np.flatnonzero(left > d + e)
        yield spots, (letters[spots] << 10) | (letters[spots + d] << 5) | letters[spots + d + e], DECAY ** (d + e + 1)


def _entries(letters: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse feature vectors of words: word, code, weight; one entry for each pair."""
    word = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keys, weights = [np.zeros(0, np.int64)], [np.zeros(0)]
    for spots, code, weight in subsequences(letters, first):
        keys.append(word[spots] * _CODES + code)
        weights.append(np.full(len(spots), weight))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return key // _CODES, key % _CODES, np.bincount(back, np.concatenate(weights), len(key))


def _take(letters: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters and bounds of some words alone."""
    size = (first[1:] - first[:-1])[which]
    ends = np.cumsum(size)
    spots = np.repeat(first[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    return letters[spots], np.concatenate(([0], ends))


def kernel(letters: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Normalised kernel of words with the columns of table (normed feature vectors), to the power POWER."""
    out = np.zeros((len(first) - 1, table.shape[1]), np.float32)
    for at, part in kernels(letters, first, table):
        out[at : at + len(part)] = part
    return out


def kernels(letters: np.ndarray, first: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The same, some words at a time."""
    codes = np.flatnonzero(table.any(1))
    return sparse_kernels(letters, first, codes, table[codes])


def sparse_kernels(letters: np.ndarray, first: np.ndarray, codes: np.ndarray, entries: np.ndarray, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """The same, of a table whose rows of codes are entries and all others empty."""
    n = len(first) - 1
    place = np.zeros(_CODES, np.int64)
    place[codes] = np.arange(1, len(codes) + 1)
    rows = np.concatenate((np.zeros((1, entries.shape[1]), np.float32), entries))
    for at in range(0, n, words):
        which = np.arange(at, min(n, at + words))
        out = np.zeros((len(which), entries.shape[1]), np.float32)
        word, code, weight = _entries(*_take(letters, first, which))
        norm = np.sqrt(np.bincount(word, weight**2, len(which)))
        held = np.flatnonzero(place[code])  # subsequences that no column has add nothing
        word, code, weight = word[held], place[code[held]], weight[held]
        begin = np.flatnonzero(np.diff(word, prepend=-1))
        if len(word):
            out[word[begin]] = np.add.reduceat(weight[:, None].astype(np.float32) * rows[code], begin) / norm[word[begin], None]
        yield at, out**POWER


def features(letters: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Normed dense feature vectors, a column a word."""
    word, code, weight = _entries(letters, first)
    norm = np.sqrt(np.bincount(word, weight**2, len(first) - 1))
    out = np.zeros((_CODES, len(first) - 1), np.float32)
    out[code, word] = weight / norm[word]
    return out


class Known:
    """Values of words by hash, at most MOST_KNOWN: beyond that it starts anew."""

    def __init__(self) -> None:
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)] == hashes

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        hashes, values = np.concatenate((self.hashes, hashes)), np.concatenate((self.values, values))
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.values = hashes[order], values[order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = self.values[np.searchsorted(self.hashes, hashes)]
        if len(self.hashes) > MOST_KNOWN:
            self.hashes, self.values = np.zeros(0, np.uint64), np.zeros(0)
        return out


@dataclass
class Model:
    """Value of a word: its kernel with the landmarks (columns of table, of which codes are the rows that hold anything, and
    entries what they hold), weighed, plus bias. Score of a text whose worst word has value m:
    1 / (1 + exp(-(slope * m + shift))), where m is at least floor."""

    codes: np.ndarray
    entries: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    floor: float

    def worst(self, units: Units, rows: int, known: Known | None = None) -> np.ndarray:
        """The largest value over each row's words, at least floor; every distinct word is looked at once, and not again if
        it is known."""
        out = np.full(rows, self.floor)
        if not len(units.row) or not len(self.weights):
            return out
        known = Known() if known is None else known
        hashes = scan.Hashes(units.letters.astype(np.uint8)).of(units.first[:-1], units.first[1:])
        distinct, at, word = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~known.holds(distinct))
        if len(new):
            known.add(distinct[new], self.least(*_take(units.letters, units.first, at[new])))
        np.maximum.at(out, units.row, known.of(distinct)[word])
        return out

    def least(self, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Values of words, those that cannot be over the floor at the floor. No kernel is more than the sum over a word's
        subsequences of the largest entry that a landmark of positive weight has, over the word's norm, and the weighed sum
        of powers of kernels no more than the largest kernel times that of powers one less, without negative weights; a
        norm is no less than that of a word without repeats of a subsequence."""
        own = self.weights > 0
        most, fold = np.zeros(_CODES, np.float32), np.zeros(_CODES, np.float32)
        most[self.codes] = self.entries[:, own].max(1, initial=0)
        fold[self.codes] = self.entries[:, own] @ self.weights[own].astype(np.float32)
        n = len(letters)
        tops, sums, norms = np.zeros(n, np.float32), np.zeros(n, np.float32), np.zeros(n, np.float32)
        for spots, code, weight in subsequences(letters, first):
            tops[spots] += most[code] * np.float32(weight)
            sums[spots] += fold[code] * np.float32(weight)
            norms[spots] += np.float32(weight**2)
        tops, sums, norms = (np.add.reduceat(x, first[:-1]) for x in (tops, sums, norms))
        norms = np.sqrt(np.maximum(norms, np.float32(1e-9)))
        bound = np.minimum(tops / norms, 1) ** (POWER - 1) * sums / norms + self.bias + 1e-3
        out = np.full(len(first) - 1, self.floor)
        look = np.flatnonzero(bound > self.floor)
        out[look] = np.maximum(self.values(*_take(letters, first, look)), self.floor)
        return out

    def values(self, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
        weights, out = self.weights.astype(np.float32), np.zeros(len(first) - 1, np.float32)
        for at, part in sparse_kernels(letters, first, self.codes, self.entries, SCORED):
            out[at : at + len(part)] = part @ weights
        return out + np.float32(self.bias)

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -60, 60)))


NEVER = Model(np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), 0.0, 0.0, -np.inf, 0.0)


def _newton(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of the machine with squared hinge loss."""
    x = np.column_stack((x, np.ones(len(x), x.dtype)))
    w, ridge = np.zeros(x.shape[1]), np.append(np.ones(x.shape[1] - 1), 1e-3)
    def loss(v: np.ndarray) -> float:
        return float(ridge @ v**2 / 2 + cost @ np.maximum(0, 1 - y * (x @ v.astype(x.dtype))) ** 2 / 2)

    now = loss(w)
    for _ in range(60):
        near = np.flatnonzero(y * (x @ w.astype(x.dtype)) < 1)
        square, slope = np.diag(ridge), ridge * w
        for at in range(0, len(near), 8192):
            some = near[at : at + 8192]
            a = x[some].astype(float)
            ac = a.T * cost[some]
            square, slope = square + ac @ a, slope - ac @ (y[some] - a @ w)
        step = np.linalg.solve(square, slope)
        scale = 1.0
        while (then := loss(w - scale * step)) > now and scale > 1e-4:
            scale /= 2
        if then >= now * (1 - 1e-7):
            break
        w, now = w - scale * step, then
    return w


def _logistic(m: np.ndarray, y: np.ndarray) -> float:
    """Slope of the score over the machine's values, whose 0 stays at a half; targets are off 0 and 1 by the counts
    of either kind."""
    target = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    a = 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(m * a, -40, 40)))
        step = float(m @ (p - target) / (m**2 @ (p * (1 - p)) + 1e-9))
        a = float(np.clip(a - step, a / 2, a * 2))
        if abs(step) < 1e-7:
            break
    return a


def _insertions(letters: np.ndarray, first: np.ndarray, which: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each of the words with one letter more, at each place inside it, in INSERTED ways, and which of them it was."""
    out, of = [], []
    for k, i in enumerate(which):
        word = letters[first[i] : first[i + 1]]
        new = [np.insert(word, j, 1 + (7 * int(i) + 11 * j + 5 * n) % 26) for j in range(1, len(word)) for n in range(INSERTED)]
        out += new
        of += [k] * len(new)
    return np.concatenate([*out, np.zeros(0, np.int32)]), np.concatenate(([0], np.cumsum([len(x) for x in out], dtype=np.int64))), np.array(of, np.int64)


def train(texts: list[bytes], toxic: np.ndarray) -> Model:
    """The model of labelled documents; NEVER if either kind is missing or no word tells them apart."""
    toxic = np.asarray(toxic, bool)
    if not toxic.any() or toxic.all():
        return NEVER
    column, parts, sentences_so_far = pa.array(texts, pa.binary()), [], 0
    for from_, to in pieces(column, PIECE // 2):
        buf, offsets = scan.view(column, from_, to)
        found = readings(buf, offsets)
        hashes = scan.Hashes(found.letters.astype(np.uint8)).of(found.first[:-1], found.first[1:])
        ends = np.concatenate(([0], np.cumsum(_SENTENCE_END[buf])))[found.at] + found.row + sentences_so_far
        sentences_so_far += int(_SENTENCE_END[buf].sum()) + to - from_
        parts.append((found.letters.astype(np.uint8), np.diff(found.first), found.row + from_, hashes, ends))
    all_letters, sizes, row_of, h, sentence = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    units = Units(all_letters, np.concatenate(([0], np.cumsum(sizes))), row_of, row_of)
    _, at, word = np.unique(h, return_index=True, return_inverse=True)
    letters, first = _take(units.letters, units.first, at)
    letters = letters.astype(np.int32)
    # a sentence counts once, however many copies of it documents of its kind hold
    said, place = np.unique(sentence, return_inverse=True)
    sums = np.zeros(len(said), np.uint64)
    np.add.at(sums, place, scan.mix(h ^ np.uint64(0x9E3779B97F4A7C15)))
    kind = np.zeros(len(said), bool)
    kind[place] = toxic[units.row]
    _, once, same = np.unique(sums ^ kind.astype(np.uint64), return_index=True, return_inverse=True)
    kind, counted = kind[once], same[place]
    if len(once) < len(texts):  # a few sentences make up all documents: these are counted
        kind, counted = toxic, units.row
    del h, said, place, sums, once, same
    pairs = np.unique(word * len(kind) + counted)
    in_toxic = np.bincount(pairs // len(kind), kind[pairs % len(kind)], len(at))
    in_clean = np.bincount(pairs // len(kind), ~kind[pairs % len(kind)], len(at))
    n1, n0 = max(kind.sum(), 1), max((~kind).sum(), 1)
    p = (in_toxic + in_clean) / (n1 + n0)
    tells = (in_toxic / n1 - in_clean / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    usable = np.diff(first) >= 3

    def apart(order: np.ndarray, most: int, near: float) -> list[int]:
        picked: list[int] = []
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            table = features(*_take(letters, first, some))
            gram = table.T @ table
            old = table.T @ features(*_take(letters, first, np.array(picked))) if picked else np.zeros((len(some), 0))
            new: list[int] = []
            for i in range(len(some)):
                if len(picked) + len(new) < most and (old[i] < near).all() and (gram[i, new] < near).all():
                    new.append(i)
            picked += [int(some[i]) for i in new]
            if len(picked) >= most:
                break
        return picked

    telling = np.flatnonzero(usable & (tells > TELLS) & (in_toxic > 2) & (in_clean * RARE <= in_toxic))
    telling = telling[np.argsort(-tells[telling], kind="stable")]
    common = np.flatnonzero(usable & (in_clean > 0))
    common = common[np.argsort(-in_clean[common], kind="stable")][:512]
    marks = apart(telling[:2048], LANDMARKS, 0.7)
    if not marks:
        return NEVER
    positive = list(marks)
    marks += [i for i in apart(common, COMMON, 0.7) if i not in marks]
    # sentences of toxic documents, as their words; the words of clean documents
    own = toxic[units.row]
    words, sentences = word[own], np.unique(sentence[own], return_inverse=True)[1]
    known = np.zeros(len(at), bool)
    known[telling] = True
    value_of = np.where(known, tells, -1.0)
    every = np.flatnonzero(in_clean > 0)
    spread = np.zeros(len(at), bool)
    spread[every[:: max(1, len(every) // BIAS)]] = True
    inserted = _insertions(letters, first, positive)
    for _ in range(ROUNDS):
        table = features(*_take(letters, first, np.array(marks)))
        value, vector = np.linalg.eigh((table.T @ table).astype(float) ** POWER)
        root = vector / np.sqrt(np.maximum(value, 1e-3)) @ vector.T
        codes = np.flatnonzero(table.any(1))
        entries = table[codes]
        del table
        v = np.where(known[words], np.maximum(value_of[words], 1e-3), value_of[words])
        order = np.lexsort((-v, sentences))
        lead = order[np.diff(sentences[order], prepend=-1) > 0]  # each sentence's worst word
        witness = lead[v[lead] > 0]
        witness = witness[in_clean[words[witness]] * RARE <= in_toxic[words[witness]]]
        some, times = np.unique(words[witness], return_counts=True)
        # clean words like no telling one hardly move the machine; some of them hold the bias
        is_clean = in_clean > 0
        clean, shown = is_clean & spread, np.zeros(len(at), bool)
        shown[some] = True
        most, xs = 1 + int(NEAR * is_clean.sum()), []
        near_clean = np.zeros((most, len(positive)), np.float32)
        # of all words' features only those that the machine sees are held
        for begin, part in sparse_kernels(letters, first, codes, entries):
            here, alike = slice(begin, begin + len(part)), part[:, : len(positive)]
            clean[here] |= is_clean[here] & (alike.max(1) > LIKE)
            shown[here] |= clean[here]
            xs.append((part @ root.astype(np.float32))[shown[here]])
            near_clean = np.concatenate((near_clean, alike[is_clean[here]]))
            near_clean.partition(len(near_clean) - most, 0)
            near_clean = near_clean[-most:]
        clean, x, row = np.flatnonzero(clean), np.concatenate(xs), np.cumsum(shown) - 1
        # a telling word with a letter inserted counts as one unless clean documents hold words as near to it
        near_clean = near_clean[0]
        spoilt, owner = np.concatenate([x for _, x in sparse_kernels(*inserted[:2], codes, entries)]), inserted[2]
        spoilt = spoilt[spoilt[np.arange(len(owner)), owner] > near_clean[owner]] @ root.astype(np.float32)
        xs = np.concatenate((x[row[some]], spoilt, x[row[clean]]))
        del x
        cost = COST * np.concatenate((np.sqrt(times), np.full(len(spoilt), SPOILT), np.sqrt(in_clean[clean])))
        w = _newton(xs, np.concatenate((np.ones(len(some) + len(spoilt)), -np.ones(len(clean)))), cost)
        del xs
        value_of = np.zeros(len(at), np.float32)
        for begin, part in sparse_kernels(letters, first, codes, entries):
            value_of[begin : begin + len(part)] = part @ root.astype(np.float32) @ w[:-1].astype(np.float32) + np.float32(w[-1])
        # the clean words that cost the machine most are landmarks of the next round
        loss = np.sqrt(in_clean[every]) * np.maximum(0, 1 + value_of[every]) ** 2
        hard = every[np.argsort(-loss, kind="stable")[:512]]
        marks = marks + [i for i in apart(hard[usable[hard] & (value_of[hard] > -1)], HARD, 0.9) if i not in marks]
    worst = np.full(len(texts), value_of.min())
    np.maximum.at(worst, units.row, value_of[word])
    # the lowest bound at which about the least is wrong, a clean document that is flagged counting FALSE times
    bounds = np.linspace(0, MOST_BOUND, 101)
    wrong = np.array([(worst[toxic] < t).mean() + FALSE * (worst[~toxic] >= t).mean() for t in bounds])
    bound = float(bounds[np.flatnonzero(wrong <= wrong.min() + 0.002)[0]])
    slope = _logistic(worst - bound, toxic)
    return Model(codes, entries, root @ w[:-1], float(w[-1]), slope, -slope * bound, float(max(np.log(FLOOR) / slope + bound, w[-1])))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Trains on a sample of the labelled rows that are not held out, the ones of least hash of either kind."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for kind, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        some = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    # at most MAX_TOXIC + MAX_CLEAN rows: a bound that no input moves
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= MAX_CHARS)
    rows = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "toxic").repartition(1)
    found = rows.mapInArrow(released(_train), "model binary").collect()
    return pickle.loads(found[0].model) if found else NEVER


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample, in one task -> the pickled model, one row."""
    known: dict[int, tuple[bytes, int]] = {}
    for batch in batches:
        text = binary(batch, "text")
        for i, (doc_id, toxic) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "toxic")), strict=True)):
            known[doc_id] = max(known.get(doc_id, (b"", 0)), (text[i].as_py(), toxic))
    rows = [known[k] for k in sorted(known)]
    model = train([x for x, _ in rows], np.array([y == 1 for _, y in rows], bool))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs (text and any columns) with the score of each row."""
    columns = docs.columns
    assert "text" in columns and name not in columns
    # numbered names, as a name with a dot in it cannot be asked for
    plain = [f"c{i}" for i in range(len(columns))]
    text = plain[columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            column = binary(batch, text)
            found = [np.zeros(0)]
            for at, to in pieces(column, PIECE):
                found.append(model.score(model.worst(readings(*scan.view(column, at, to)), to - at, known)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], [*plain, "score"])

    kinds = [T.StructField(p, f.dataType, f.nullable) for p, f in zip(plain, docs.schema.fields, strict=True)]
    return docs.toDF(*plain).mapInArrow(released(run), T.StructType([*kinds, T.StructField("score", T.DoubleType())])).toDF(*columns, name)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not call toxic, columns as they are."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, name).where(F.col(f"`{name}`") < 0.5).drop(name)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every document, by a model of the labelled ones that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
