"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items, whose letters are words.

A text is scanned once, word by word. Hits are ranges of words, mapped to places in the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.texts import slices
from tallyshelf.sources.scratch import discard, stored

WINDOW = 10
# Pairs of a window and its item in one automaton (about 100 MB in every Python worker); more make further automata, which scan in turn.
PART_WINDOWS = 100_000

# In lower-cased UTF-8: all bytes but those of ASCII that are neither digits nor letters.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^0-9a-zA-Z\x80-\xff]")


def _words(data: bytes) -> Iterator[list[bytes]]:
    for part in slices(data, _BREAK):
        yield _WORD.findall(part.lower())


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``window, item``: the distinct runs of ``window`` words of each item, space-joined; a shorter item is one run, one without words has none."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words: list[bytes] = []
                whole = False
                for part in _words(data.as_py()):
                    words += part
                    own = [b" ".join(words[k : k + window]) for k in range(len(words) - window + 1)]
                    if own:
                        yield rows(item, own)
                        words = words[len(own):]
                        whole = True
                if words and not whole:
                    yield rows(item, [b" ".join(words)])

    def rows(item: str, own: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(own, pa.binary()).cast(pa.string()), pa.array([item] * len(own))], ["window", "item"])

    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                           F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    return own.mapInArrow(per_batch, "window string, item string").distinct()


class Automaton:
    """Finds windows in a sequence of words; words that no window has are letter 0."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.letters: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        self.sizes: list[int] = []
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        number: dict[str, int] = {}
        for window, item in pairs:
            at = number.setdefault(window, len(number))
            if at == len(self.items):
                letters = tuple(self.letters.setdefault(w, len(self.letters) + 1) for w in window.encode().split(b" "))
                self.items.append([])
                self.sizes.append(len(letters))
                self.found.add_word(letters, at)
            self.items[at].append(item)
        if number:
            self.found.make_automaton()

    def scan(self, data: bytes) -> tuple[int, list[list[int]], set[int]]:
        """How many words there are, the merged ranges ``[first, last]`` of words within windows, and the windows met."""
        total, ranges, met, scan = 0, [], set(), None
        letter = self.letters.get
        for words in _words(data):
            total += len(words)
            if not self.sizes or not words:
                continue
            letters = tuple([letter(w, 0) for w in words])
            if scan is None:
                scan = self.found.iter(letters)
            else:
                scan.set(letters, False)
            for last, window in scan:
                met.add(window)
                add_range(ranges, last - self.sizes[window] + 1, last)
        return total, ranges, met


def add_range(ranges: list[list[int]], first: int, last: int) -> None:
    """Adds a range to merged ones in order; it must not end before them. Ranges that touch become one."""
    while ranges and ranges[-1][1] >= first - 1:
        first = min(first, ranges.pop()[0])
    ranges.append([first, last])


def merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(ranges, key=lambda r: (r[1], r[0])):
        add_range(out, first, last)
    return out


def places(data: bytes, ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Where ranges of words begin and end in the text, in code points."""
    bounds: list[tuple[int, int]] = []
    chars = word = at = 0
    left = iter(ranges)
    now = next(left, None)
    length = lambda piece: len(piece.decode("utf-8", "replace"))
    for m in _WORD.finditer(data.lower()):
        if now is None:
            break
        if word == now[0]:
            chars += length(data[at : m.start()])
            at, begin = m.start(), chars
        if word == now[1]:
            chars += length(data[at : m.end()])
            at = m.end()
            bounds.append((begin, chars))
            now = next(left, None)
        word += 1
    return bounds


# The automaton that this Python worker has built last.
_BUILT: dict[str, Automaton] = {}


def _built(name: str, pairs: list[tuple[str, str]]) -> Automaton:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(pairs)
    return _BUILT[name]


def _scanned(rows: DataFrame, pairs: list[tuple[str, str]], last: bool) -> DataFrame:
    """``rows (doc_id, data, ranges, items)`` with what one automaton finds; the ``last`` one gives counts and spans in place of the data."""
    name = uuid.uuid4().hex

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _built(name, pairs)
        for batch in batches:
            words, hits, ranges, items, spans = [], [], [], [], []
            for data, before, known in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = data.as_py()
                total, found, met = automaton.scan(data)
                if before:
                    found = merged(found + [before[k : k + 2] for k in range(0, len(before), 2)])
                items.append(sorted({*known, *(i for w in met for i in automaton.items[w])}) if met else known)
                if last:
                    words.append(total)
                    hits.append(sum(b - a + 1 for a, b in found))
                    spans.append([{"start": a, "end": b} for a, b in places(data, found)] if found else [])
                else:
                    ranges.append([x for r in found for x in r])
            texts = pa.array(items, pa.list_(pa.string()))
            if last:
                columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), texts, pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])
            else:
                columns = [batch.column(0), batch.column(1), pa.array(ranges, pa.list_(pa.int64())), texts]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "data", "ranges", "items"])

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
    return rows.mapInArrow(per_batch, f"doc_id {kind}, {found if last else 'data binary, ranges array<long>, items array<string>'}")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part: int = PART_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans`` of every row of ``docs (doc_id, text)`` against ``benchmark (item_id, text)``.

    ``n_hit`` counts the words within occurrences of windows of the benchmark, ``items`` lists the items of these windows as sorted strings,
    ``spans`` has the start and end (exclusive, in code points of the original text) of each run of hit words. Null and
    empty texts have no words, on both sides. Very long texts are read in slices. Rows of one item_id are one item, a null item_id is
    the item ''; repeated documents are scanned each; empty tables give no rows, or rows without hits. Other columns are not read.

    Automata hold about ``part`` windows each. The windows are counted first; a benchmark with more is dealt to several automata by hash,
    which scan all texts in turn.
    """
    found = stored(windows(benchmark, window), "windows")
    parts = max(1, -(-found.count() // part))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"),
                       F.array().cast("array<long>").alias("ranges"), F.array().cast("array<string>").alias("items"))
    before = None
    for number in range(parts):
        own = found.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == number)
        pairs = [(r.window, r["item"]) for r in own.toLocalIterator()]
        rows = _scanned(rows, pairs, number + 1 == parts)
        if number + 1 < parts:
            rows = stored(rows, "scanned")
            if before is not None:
                discard(before)
            before = rows
    return rows


def digest(found: DataFrame) -> DataFrame:
    """The counts, a digest of the items, and whether there is any hit, from what ``find_overlaps`` returns."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id no contaminated row has, with all their columns; rows without a doc_id are judged as one document."""
    bad = find_overlaps(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")
