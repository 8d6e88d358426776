"""Best-fit packing of token sequences into windows of CAPACITY tokens, by a configuration linear program.

1. Texts are encoded once; a document that is longer than a window is cut into full windows after a shorter first piece.
2. The histogram of piece lengths (at most CAPACITY numbers, whatever the corpus) goes to the driver. There the
   configuration program (as few windows as cover the count of every class) is solved by multiplicative weights: classes
   whose cover lags weigh more, and a knapsack by dynamic programming finds the window of most weight, which is then
   used for a share of its classes' counts. A frequent length is a class of its own; the others are classed with their
   neighbours, and no class spans a divisor of the window. A class weighs as its longest length, so each window is filled
   up by the true lengths of its pieces before it is opened. The shares are rounded down, and what is left goes best-fit,
   longest first, into the room of windows already open and then into new ones, whole groups of equal windows at a time.
3. Pieces are range-partitioned by length and numbered within each length from the partitions' own counts; a piece's
   number then tells its window and place by search in the plan. No window, length or source is gathered in one task.

Nulls and edge cases: a null text is empty: one piece with the closing id alone; a null doc_id is carried through;
repeated rows are packed as often as they stand; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, only, slots, stage, unstage

CAPACITY, CLOSING = 2048, 0
#: Rounds of multiplicative weights, and the rate at which covered lengths lose weight.
STEPS, RATE, SHARE = 1200, 4.0, 0.1
#: Lengths are classed to one part in FINE for the program, but for those of one in HOT pieces, which stay single.
FINE, HOT = 32, 200
#: Lengths up to this stay out of the program and fill the room that classing leaves.
FILL = 128
#: Texts of each worker that the tokenizers library encodes too.
CHECKED = 16

# Fixed value: how byte-level vocabularies cut texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _alphabet() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable Latin-1 characters stand for
    themselves, the other bytes in order for the characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Text -> little-endian ids of a tokenizer file. A plain byte-level vocabulary whose merges are numbered in order is
    run by a faster merger over the file's own vocabulary; a text with a special string or one that the merger gives up on
    (white space of about a million characters in a row), and any other kind of file, goes to the tokenizers library, and
    so does everything if the two ever differ on the first CHECKED texts of a worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.fast, self.checked = None, 0
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, cut = file["model"], file.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and file.get("normalizer") is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        if plain and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
            if None not in merged and merged == sorted(merged):
                import tiktoken

                alphabet = _alphabet()
                ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
                self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return self._whole(text)
        try:
            ids = np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        except BaseException as e:
            # the merger's panics are no Exceptions, and their class has no public name
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
            return self._whole(text)
        if self.checked < CHECKED:
            self.checked += 1
            if ids != self._whole(text):
                self.fast = None
                return self._whole(text)
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        closing = np.array([CLOSING], "<u4").tobytes()
        for batch in batches:
            text, ids = binary(batch, "text"), batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for i, doc_id in enumerate(ids):
                tokens = e.encode(text[i].as_py().decode()) + closing
                n = len(tokens) // 4
                at, piece = 0, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity)
                    for x, y in zip(out, (doc_id, piece, at, to - at, zlib.crc32(tokens[4 * at : 4 * to])), strict=True):
                        x.append(y)
                    at, piece = to, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def knapsack(value: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths (with counts) of most total value that fit; value[l] is a length's, 0 or less for one not to use."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    use = np.flatnonzero(value > 0)
    least = int(use[0]) if len(use) else capacity + 1
    for begin in range(least, capacity + 1, least):  # no room in a block depends on another of it
        block = np.arange(begin, min(begin + least, capacity + 1))
        some = use[: np.searchsorted(use, block[-1], "right")]
        before = block[:, None] - some
        gain = np.where(before < 0, -np.inf, best[before]) + value[some]
        i = gain.argmax(1)
        gain = gain[np.arange(len(block)), i]
        best[block] = np.maximum.accumulate(np.maximum(gain, best[begin - 1]))
        last[block] = np.where(gain >= best[block], some[i], 0)
    out: dict[int, int] = {}
    c = capacity
    while c:
        if last[c]:
            out[int(last[c])] = out.get(int(last[c]), 0) + 1
            c -= int(last[c])
        else:
            c -= 1
    return out


def classes(counts: np.ndarray, capacity: int) -> np.ndarray:
    """The largest length of each class: steps of one part in FINE (single lengths first) that end before and at each
    length of one in HOT pieces, and at each divisor of the capacity."""
    ends = {capacity // n for n in range(1, capacity // FILL + 1)}
    for length in np.flatnonzero(counts[1:capacity] * HOT >= max(1, counts[FILL + 1 : capacity].sum())) + 1:
        ends |= {int(length) - 1, int(length)}
    tops = [1]
    while tops[-1] < capacity - 1:
        to = min(capacity - 1, tops[-1] + max(1, tops[-1] // FINE))
        tops.append(next((x for x in range(tops[-1] + 1, to) if x in ends), to))
    return np.array(tops)


def configurations(counts: np.ndarray, capacity: int, tops: np.ndarray) -> list[tuple[dict[int, int], float]]:
    """Windows, as lengths' classes, and how often to use each, that together cover each class's count: the
    configuration program by multiplicative weights. A class's price begins as its length and falls as it is covered; the
    knapsack finds the window of the highest price, which is used until the least covered of its classes gains SHARE."""
    of = np.searchsorted(tops, np.arange(len(counts)))
    many = np.bincount(of[1:capacity], counts[1:capacity], len(tops))
    many[tops <= FILL] = 0
    cover = np.zeros(len(tops))
    used: dict[tuple, float] = {}
    for _ in range(STEPS):
        left = many - cover
        live = left >= 1
        if not live.any():
            break
        price = np.zeros(capacity + 1)
        price[tops[live]] = tops[live] * np.exp(-RATE * cover[live] / many[live])
        window = {int(np.searchsorted(tops, length)): n for length, n in knapsack(price, capacity).items()}
        share = min(max(1.0, min(SHARE * many[c], left[c])) / n for c, n in window.items())
        share = min(share, *(left[c] / n for c, n in window.items()))
        for c, n in window.items():
            cover[c] += share * n
        key = tuple(sorted(window.items()))
        used[key] = used.get(key, 0) + share
    return [(dict(k), x) for k, x in used.items()]


Plan = list[tuple[dict[int, int], int]]


def pack(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Windows (length -> how many) and how many of each, using up counts[length] for every length to capacity."""
    left = counts.astype(np.int64).copy()
    room: dict[int, list[tuple[dict[int, int], int]]] = {}

    def open_(window: dict[int, int], times: int) -> None:
        room.setdefault(capacity - sum(a * b for a, b in window.items()), []).append((window, times))

    tops = classes(left, capacity)
    bottoms = np.concatenate(([1], tops[:-1] + 1))
    for window, share in sorted(configurations(left, capacity, tops), key=lambda x: -x[1]):
        times = int(share + 1e-6)  # rounded down; the rest goes best-fit
        while times:
            # the longest of each class that are left; as many equal windows as those allow
            own: dict[int, int] = {}
            for c, n in window.items():
                for length in range(int(tops[c]), int(bottoms[c]) - 1, -1):
                    take = min(n, int(left[length]))
                    if take:
                        own[length] = take
                        n -= take
                    if not n:
                        break
            if not own:
                break
            # the room that classing leaves: one piece gives way to the longest that then fits
            spare = capacity - sum(a * b for a, b in own.items())
            for length in sorted(own):
                longer = next((x for x in range(min(capacity, length + spare), length, -1) if left[x] > own.get(x, 0)), 0) if spare else 0
                if longer:
                    own[length] -= 1
                    own[longer] = own.get(longer, 0) + 1
                    spare -= longer - length
            # what room is left takes more pieces, longest first; short ones come last, best-fit
            for length in range(spare, FILL, -1):
                n = min(spare // length, int(left[length]) - own.get(length, 0))
                if n > 0:
                    own[length] = own.get(length, 0) + n
                    spare -= n * length
            own = {a: b for a, b in own.items() if b}
            now = min(times, *(int(left[a]) // b for a, b in own.items()))
            for a, b in own.items():
                left[a] -= now * b
            open_(own, now)
            times -= now
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = min((r for r in room if r >= length), default=None)
            if fits is None:
                each = capacity // length
                times = max(1, n // each)
                many = min(n, each)
                open_({length: many}, times)
                n -= many * times
                continue
            window, times = room[fits].pop()
            if not room[fits]:
                del room[fits]
            each = min(fits // length, n)
            take = min(times, n // each)
            open_({**window, length: window.get(length, 0) + each}, take)
            n -= take * each
            if times > take:
                open_(window, times - take)
    return [x for group in room.values() for x in group]


def places(plan: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first number of each run of places, pieces a window, first window, offset in the window."""
    out: dict[int, list[list[int]]] = {}
    window_id = 0
    for window, times in plan:
        offset = 0
        for length in sorted(window, reverse=True):
            rows = out.setdefault(length, [[], [], [], [], [0]])
            for x, y in zip(rows, (rows[4][0], window[length], window_id, offset), strict=False):
                x.append(y)
            rows[4][0] += window[length] * times
            offset += length * window[length]
        window_id += times
    return {k: tuple(np.array(x, np.int64) for x in v[:4]) for k, v in out.items()}


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of length: adds the partition and the number within it and the length."""
    part = TaskContext.get().partitionId()
    last, seen = -1, 0
    for batch in batches:
        length = batch.column(batch.schema.get_field_index("length")).to_numpy()
        if not len(length):
            continue
        new = np.flatnonzero(np.concatenate(([length[0] != last], length[1:] != length[:-1])))
        begin = np.zeros(len(length), np.int64)
        begin[new] = new
        number = np.arange(len(length)) - np.maximum.accumulate(begin)
        head = int(new[0]) if len(new) else len(length)
        number[:head] = np.arange(head) + seen
        last, seen = length[-1], int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(number)], [*batch.schema.names, "part", "number"])


def _place(plan: dict[int, tuple[np.ndarray, ...]], before: dict[tuple[int, int], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            length, part, number = (column[c].to_numpy() for c in ("length", "part", "number"))
            window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            key = part.astype(np.int64) * (1 << 32) + length
            for k in np.unique(key):
                rows = np.flatnonzero(key == k)
                first, many, at, begin = plan[int(k) & 0xFFFFFFFF]
                n = number[rows] + before[int(k) >> 32, int(k) & 0xFFFFFFFF]
                run_ = np.searchsorted(first, n, "right") - 1
                window[rows] = at[run_] + (n - first[run_]) // many[run_]
                offset[rows] = begin[run_] + (n - first[run_]) % many[run_] * length[rows]
            yield pa.RecordBatch.from_arrays([*(column[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(window), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each row of docs (doc_id, text): its place in its document and in its sequence."""
    parts = slots(docs.sparkSession)
    cut = stage(only(docs, doc_id="long", text="string").mapInArrow(_cut(tokenizer, capacity), _PIECES))
    # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():
        counts[length] = n
    plan = places(pack(counts, capacity))
    dealt = cut.repartitionByRange(parts, "length", "ids_crc32", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    numbered = stage(dealt.mapInArrow(_number, _PIECES + ", part int, number long"))
    # ranges of lengths: at most partitions + capacity rows
    before: dict[tuple[int, int], int] = {}
    so_far = np.zeros(capacity + 1, np.int64)
    for part, length, n in sorted(numbered.groupBy("part", "length").count().collect()):
        before[part, length] = int(so_far[length])
        so_far[length] += n
    unstage(cut)
    return numbered.mapInArrow(_place(plan, before), _PIECES + ", sequence_id long, offset long")


def op10_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every document in windows of 2048 ids of the public byte-level vocabulary."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
