"""Best-fit packing of tokenised documents by length patterns.

The histogram of piece lengths (one count per length up to the window) is small whatever the corpus. On it, patterns of at most
``PATTERN_DOCS`` lengths that fill a window exactly get repeat counts by non-negative least squares; the counts are
rounded, what they leave over is packed by best fit, and Spark deals the pieces to the places.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyshelf.sources.scratch import stored

WINDOW = 1024
PATTERN_DOCS = 3
# Least shares of the window that a pattern's longest length fills. Each gives a plan, and the plan of fewest windows is taken: without such
# a bound short documents are used up that best fit would fill gaps with; with it there may be few patterns, or none.
LONG_SHARES = (2 / 3, 1 / 2, 0.0)
# The descent ends at moves below half a document, or below this share of the documents if that is more.
LEAST_MOVE = 1e-6
# Pieces of a length are numbered within blocks of about so many rows.
BLOCK_ROWS = 20_000


@cache
def token_encoder(ranks: str, pattern: str, tokenizer: str):
    """``texts -> lists of ids`` as the tokenizer file gives them, once per worker.

    The rank file holds the same vocabulary and is read several times faster; only texts that spell a special
    token, which the tokenizer file treats as that token, go through the tokenizer itself.
    """
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    whole = Tokenizer.from_file(tokenizer)
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def token_pieces(docs: DataFrame, ranks: str, pattern: str, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document of ``docs (doc_id, text)``.

    A document is its ids and then ``end_id``; only longer ones than ``window`` are cut, and then the first piece is the
    short one. Null and empty texts are the end id alone.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_encoder(ranks, pattern, tokenizer)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for number, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                at, width, k = 0, len(ids) % window or window, 0
                while at < len(ids):
                    row.append(number)
                    piece.append(k)
                    start.append(at)
                    length.append(width)
                    crc.append(zlib.crc32(ids[at : at + width].tobytes()))
                    at, width, k = at + width, window, k + 1
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                *(pa.array(c, pa.int64()) for c in (start, length, crc)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(per_batch, fields)


def full_patterns(lengths: list[int], window: int, most: int = PATTERN_DOCS, longest: float = 0.0) -> np.ndarray:
    """Multisets of at most ``most`` (three at most) of the lengths that sum to the window, as falling rows filled with zeros.

    The first length is at least ``longest * window``.
    """
    there = np.zeros(window + 1, bool)
    there[[x for x in lengths if x <= window]] = True
    there[0] = True  # an empty place
    first, second = np.meshgrid(np.arange(window + 1), np.arange(window + 1), indexing="ij")
    third = window - first - second
    good = (first >= second) & (second >= third) & (third >= 0) & (first >= longest * window)
    first, second, third = first[good], second[good], third[good]
    good = there[first] & there[second] & there[third] & (((second > 0).astype(int) + (third > 0) + 1) <= most)
    return np.stack([first[good], second[good], third[good]], axis=1)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Repeat counts ``x >= 0`` that minimise ``|A x - histogram|``: greedy coordinate descent.

    ``A`` counts a pattern's lengths. Each step moves the one count that moves most to its best value, so few patterns are
    used; it ends when no count would move by ``LEAST_MOVE`` of all documents, or by half a document.
    """
    number, parts = patterns.shape
    if not number:
        return np.zeros(0)
    histogram = histogram.astype(float)
    histogram[0] = 0
    least = max(0.5, LEAST_MOVE * histogram.sum())
    a, b, c = patterns.T  # falling; zeros last
    times_a = 1.0 + (b == a) + (c == a)
    times_b = np.where(b > 0, 1.0 + (c == b) + (b == a), 0)
    times_c = np.where(c > 0, 1.0 + (c == b) + (c == a), 0)
    column = times_a + times_b + times_c  # |column|^2
    flat = patterns.ravel()
    order = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[order], np.arange(len(histogram) + 1))
    touched = [order[bounds[v] : bounds[v + 1]] // parts for v in range(len(histogram))]
    gain = histogram[patterns].sum(axis=1)
    counts = np.zeros(number)
    while True:
        move = np.maximum(gain / column, -counts)
        best = int(np.abs(move).argmax())
        change = move[best]
        if abs(change) < least:
            return counts
        counts[best] += change
        for length in patterns[best]:
            if length:
                np.subtract.at(gain, touched[length], change)


def best_fit(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with counts that hold exactly ``histogram``: longest first, each into the fullest window that takes it.

    Windows with equal content are handled together, so the work depends on the number of lengths, not of documents.
    """
    open_windows: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    free: list[int] = []

    def put(content: tuple[int, ...], count: int) -> None:
        room = window - sum(content)
        if room not in open_windows:
            open_windows[room] = []
            bisect.insort(free, room)
        open_windows[room].append((content, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                each = window // length
                if left >= each:
                    put((length,) * each, left // each)
                if left % each:
                    put((length,) * (left % each), 1)
                break
            room = free[at]
            content, count = open_windows[room].pop()
            used = min(left, count)
            if count > used:
                open_windows[room].append((content, count - used))
            if not open_windows[room]:
                del open_windows[room]
                free.pop(at)
            put((*content, length), used)
            left -= used
    return [pair for pairs in open_windows.values() for pair in pairs]


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` that hold every piece of the histogram once, in few windows: the best plan of ``LONG_SHARES``."""
    plans = [_plan(histogram, window, share) for share in LONG_SHARES]
    return min(plans, key=lambda plan: sum(repeats for _, repeats in plan))


def _plan(histogram: dict[int, int], window: int, longest: float) -> list[tuple[tuple[int, ...], int]]:
    """Patterns by their fitted counts, rounded, and best fit for what they leave."""
    counts = np.zeros(window + 1, np.int64)
    for length, number in histogram.items():
        counts[length] = number
    patterns = full_patterns(list(histogram), window, longest=longest)
    fitted = fit_counts(patterns, counts)
    plan = []
    for at in np.argsort(-fitted, kind="stable"):
        repeats = int(fitted[at] + 0.5)
        if repeats <= 0:
            break
        content = tuple(int(v) for v in patterns[at] if v)
        repeats = min(repeats, *(int(counts[v]) // content.count(v) for v in set(content)))
        if repeats:
            plan.append((content, repeats))
            for v in content:
                counts[v] -= repeats
    return plan + best_fit({int(v): int(counts[v]) for v in np.flatnonzero(counts)}, window)


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pieces`` (``doc_id, piece, start, length, ids_crc32``) with ``sequence_id`` and ``offset``, gapless from 0.

    Every row gets one place; equal rows get different ones; an empty table stays empty. Lengths must be from 1 to
    ``window``. Pieces of one length are numbered within blocks, so a length that a third of all have is spread.
    """
    pieces = stored(pieces, "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    plan = plan_windows(histogram, window)
    places = []
    first = 0
    for content, repeats in plan:
        offset = 0
        for length in content:
            places.append((length, repeats, first, offset))
            offset += length
        first += repeats
    table = np.array(sorted(places), np.int64).reshape(-1, 4)
    ends = np.cumsum(table[:, 1])
    new = np.append(True, table[1:, 0] != table[:-1, 0]) if len(table) else np.zeros(0, bool)
    begins = ends - table[:, 1]
    begins = begins - np.repeat(begins[new], np.diff(np.append(np.flatnonzero(new), len(table))))
    place_keys, firsts, offsets = table[:, 0] << 48 | begins, table[:, 2], table[:, 3]

    blocks = max(64, sum(histogram.values()) // BLOCK_ROWS)
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int")
    pieces = pieces.withColumn("block", block)
    sizes = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = pieces.withColumn("row", F.row_number().over(within)).join(sizes, ["length", "block"])
    numbered = numbered.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("number"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            at = np.searchsorted(place_keys, length << 48 | number, "right") - 1
            begin = place_keys[at] & ((1 << 48) - 1)
            yield batch.drop(columns="number").assign(sequence_id=firsts[at] + number - begin, offset=offsets[at])

    schema = pieces.drop("block").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInPandas(deal, schema)
