"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, and one line kept per component."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.components import component_roots
from tallyshelf.llm.language_model import hinted, hints
from tallyshelf.llm.texts import unused
from tallyshelf.sources.scratch import discard, stored

SHINGLE = 9
SIMILARITY = 0.8
# A pair at the threshold shares some band with probability 1 - (1 - 0.8 ** 4) ** 10 = 0.995.
BANDS, BAND_ROWS = 10, 4
# Shorter lines (without the white space around them) are formatting: they are never compared and always stay.
LEAST_CHARS = 10
# Tables of ids up to so many rows (about 32 MB) are sent to every task, larger ones joined by a shuffle.
BROADCAST_ROWS = 1_000_000
# The same for texts of compared lines, in bytes.
BROADCAST_BYTES = 16_000_000
# Characters whose signatures are computed at once, and lines whose sketches are.
CHUNK_CHARS, CHUNK_LINES = 120_000, 1024
# A sketch has two bits per hash value of a shingle, in so many 64-bit words: at least one shingle has it, at least two have it.
SKETCH_WORDS = 32

# Texts or pairs of lines that Python gets at once: with very long ones a usual batch would hold gigabytes.
BATCH_ROWS = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

SPACE = " \t\r\x0b\x0c"
SEED = 42

_P = np.uint64(0x100000001B3)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BINS = BANDS * BAND_ROWS
_FACTORS, _TERMS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, (2, _BINS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every shingle of all lines, in order, and how many each line has."""
    chars = np.frombuffer("".join(lines).encode("utf-32-le"), "<u4").astype(np.uint64)
    sizes = np.array([len(line) for line in lines])
    h, width = chars, 1
    for _ in range(3):  # shingles of 2, 4 and 8 characters, then one more
        h = h[: len(h) - width] * _P**np.uint64(width) + h[width:]
        h = h ^ (h >> np.uint64(31))
        width *= 2
    h = h[: len(h) - 1] * _P + chars[8:]
    h = (h ^ (h >> np.uint64(32))) * _ODD
    h ^= h >> np.uint64(29)
    h *= _ODD
    ends = np.cumsum(sizes)
    count = sizes - SHINGLE + 1
    at = np.arange(count.sum()) + np.repeat(ends - sizes - (np.cumsum(count) - count), count)
    return h[at], count


def sketches(lines: list[str]) -> np.ndarray:
    """``SKETCH_WORDS`` signed words per line: where one and where two or more of its distinct shingles' hashes fall.

    Two lines' sketches differ in at most as many bits as their shingle sets differ in shingles.
    """
    h, count = _shingle_hashes(lines)
    line = np.repeat(np.arange(len(lines)), count)
    order = np.lexsort((h, line))
    h, line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    places = SKETCH_WORDS * 32
    place = ((h[new] >> np.uint64(32)) * np.uint64(places) >> np.uint64(32)).astype(np.int64)
    met = np.bincount(line[new] * places + place, minlength=len(lines) * places).reshape(len(lines), places)
    return np.packbits(np.concatenate([met >= 1, met >= 2], axis=1), axis=1).view(np.int64)


def band_hashes(lines: list[str]) -> np.ndarray:
    """``BANDS`` signed 64-bit hashes per line from a MinHash of its shingles; lines must have ``SHINGLE`` characters or more.

    Lines of every length get the same independent hash functions, so similar ones of different lengths can meet.
    """
    h, count = _shingle_hashes(lines)
    signature = np.empty((len(lines), _BINS), np.uint64)
    starts = np.cumsum(count) - count
    value = np.empty_like(h)
    for j in range(_BINS):
        np.multiply(h, _FACTORS[j], out=value)
        value += _TERMS[j]
        signature[:, j] = np.minimum.reduceat(value, starts)
    bands = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(BANDS):
        mixed = np.full(len(lines), k + 1, np.uint64)
        for j in range(BAND_ROWS):
            mixed = (mixed ^ signature[:, k * BAND_ROWS + j]) * _ODD
            mixed ^= mixed >> np.uint64(32)
        bands[:, k] = mixed
    return bands.view(np.int64)


def _stored_by_batches(df: DataFrame, label: str) -> DataFrame:
    """``stored`` for a table that Python makes from texts, with ``BATCH_ROWS`` rows in a batch."""
    conf = df.sparkSession.conf
    usual = conf.get(BATCH_SETTING)
    conf.set(BATCH_SETTING, BATCH_ROWS)
    try:
        return stored(df, label)
    finally:
        conf.set(BATCH_SETTING, usual)


def line_marks(docs: DataFrame) -> DataFrame:
    """``doc_id, row, pos, line, bands`` of every line that takes part; ``row`` is a hash of doc_id and text, ``line`` of the line."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, own = [], [], []

            def marks() -> pa.RecordBatch:
                ids = [xxhash.xxh64_intdigest(line.encode(), SEED) for line in own]
                bands = band_hashes(own)
                columns = [
                    batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(pos, pa.int32()),
                    pa.array(np.array(ids, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel())),
                ]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "pos", "line", "bands"])

            size = 0
            for number, text in enumerate(batch.column(2)):
                for place, line in enumerate((text.as_py() or "").split("\n")):
                    line = line.strip(SPACE)
                    if len(line) >= LEAST_CHARS:
                        at.append(number)
                        pos.append(place)
                        own.append(line)
                        size += len(line)
                if size > CHUNK_CHARS:
                    yield marks()
                    at, pos, own, size = [], [], [], 0
            if own:
                yield marks()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    return rows.mapInArrow(per_batch, f"doc_id {kind}, row long, pos int, line long, bands array<long>")


def may_be_similar(left: list[str], right: list[str]) -> np.ndarray:
    """Which pairs of lines, ``CHUNK_LINES`` at most, can be similar; no similar pair goes missing.

    Hashes that one line of a pair has and the other has not are at most as many as such shingles, whichever shingles share a hash.
    """
    keys, places = [], 0
    step = np.uint64(64 - CHUNK_LINES.bit_length())
    for side, own in enumerate((left, right)):
        h, count = _shingle_hashes(own)
        pair = np.repeat(np.arange(len(own), dtype=np.uint64), count)
        keys.append((pair << step) | (h >> (np.uint64(64) - step) & ~np.uint64(1)) | np.uint64(side))
        places = places + count
    keys = np.sort(np.concatenate(keys))
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    both = keys[1:][keys[1:] >> np.uint64(1) == keys[:-1] >> np.uint64(1)]
    of_pair = lambda keys: np.bincount((keys >> step).astype(np.int64), minlength=len(left))
    apart = of_pair(keys) - 2 * of_pair(both)
    return apart * (1 + SIMILARITY) <= places * (1 - SIMILARITY) + 1e-6


@lru_cache(4)
def _shingles(line: str) -> frozenset[str]:
    return frozenset(line[k : k + SHINGLE] for k in range(len(line) - SHINGLE + 1))


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of lines whose shingle sets have a Jaccard similarity of ``SIMILARITY`` or more."""

    def similar(one: str, other: str) -> bool:
        x, y = _shingles(one), _shingles(other)
        shared = len(x & y)
        return shared >= SIMILARITY * (len(x) + len(y) - shared)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, left, right, size = [], [], [], 0
            for number, (one, other) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                left.append(one.as_py())
                right.append(other.as_py())
                size += len(left[-1]) + len(right[-1])
                if size > CHUNK_CHARS or len(left) == CHUNK_LINES or number + 1 == len(batch):
                    may = may_be_similar(left, right).tolist()
                    good += [can and similar(x, y) for can, x, y in zip(may, left, right, strict=True)]
                    left, right, size = [], [], 0
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("line").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("line").alias("b"), F.col("text").alias("right"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        left, right = F.broadcast(left), F.broadcast(right)
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(verify, "a long, b long")


def _sketched(texts: DataFrame) -> DataFrame:
    """``line, shingles, w0, w1, ...``: the size of each line's shingle set, and the words of its sketch."""
    words = [f"w{k}" for k in range(SKETCH_WORDS)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = own = 0
            for number, text in enumerate(batch.column(1)):
                size += len(text.as_py())
                if size > CHUNK_CHARS or number - own + 1 == CHUNK_LINES or number + 1 == len(batch):
                    part = batch.slice(own, number + 1 - own)
                    lines = part.column(1).to_pylist()
                    counts = pa.array([len(_shingles(line)) for line in lines], pa.int32())
                    columns = [pa.array(column) for column in np.ascontiguousarray(sketches(lines).T)]
                    yield pa.RecordBatch.from_arrays([part.column(0), counts, *columns], ["line", "shingles", *words])
                    size, own = 0, number + 1

    schema = ", ".join(["line long", "shingles int", *[f"{w} long" for w in words]])
    return texts.select("line", "text").mapInArrow(sketch, schema)


def _close(sizes: Column, left: str, right: str) -> Column:
    """Whether two sketches may belong to similar lines: sets of that similarity differ in few shingles, so in few bits."""
    bits = [F.bit_count(F.col(f"{left}.w{k}").bitwiseXOR(F.col(f"{right}.w{k}"))) for k in range(SKETCH_WORDS)]
    return reduce(Column.__add__, bits) * (1 + SIMILARITY) <= sizes * (1 - SIMILARITY) + 1e-6


def _sized(table: DataFrame) -> DataFrame:
    """A stored table of ids, to be sent to every task if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def line_texts(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``line, text`` of ``lines (line)``; a bitmap of a size that does not depend on the corpus spares most other lines the way to the join."""
    hint = hints(lines.select(F.col("line").alias("key")))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own, size = [], [], 0

            def asked() -> pa.RecordBatch:
                keys = np.array(ids, np.uint64)
                may = hinted(keys, hint.value)
                texts = [line for line, there in zip(own, may.tolist(), strict=True) if there]
                return pa.RecordBatch.from_arrays([pa.array(keys[may].view(np.int64)), pa.array(texts, pa.string())], ["line", "text"])

            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    line = line.strip(SPACE)
                    if len(line) >= LEAST_CHARS:
                        ids.append(xxhash.xxh64_intdigest(line.encode(), SEED))
                        own.append(line)
                        size += len(line)
                if size > CHUNK_CHARS:
                    yield asked()
                    ids, own, size = [], [], 0
            if own:
                yield asked()

    found = docs.select("text").mapInArrow(per_batch, "line long, text string")
    return found.join(_sized(lines), "line").groupBy("line").agg(F.min("text").alias("text"))


def line_links(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """``a, b``: links that join similar ``lines (line, bands)`` of ``docs`` into the components of all similar pairs in shared bands.

    In a band with more than two lines each is compared with the smallest; those that are not linked to it then, in whatever band, are
    compared with all lines of the band that they are not linked to: in the join by their sketches, which rule out most pairs that
    are not similar and no other, then by their shingles.
    """
    banded = lines.select("line", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("line").alias("a"), F.max("line").alias("b"), F.count("*").alias("n"))
    shared = stored(shared.where("n > 1"), "bands")
    crowded = stored(shared.where("n > 2").select("band", "a"), "crowded")
    members = stored(banded.join(_sized(crowded), "band").where("line <> a"), "members")
    first = shared.where("n = 2").select("a", "b").union(members.select("a", F.col("line").alias("b")))
    first = stored(first.distinct(), "pairs")
    discard(shared, crowded)
    ids = stored(first.select(F.explode(F.array("a", "b")).alias("line")).distinct(), "compared")
    texts = _stored_by_batches(line_texts(docs, ids), "texts")
    discard(ids)
    good = _stored_by_batches(_similar(first, texts), "similar")
    discard(first)
    roots = component_roots(good)
    of_line = roots.select(F.col("node").alias("line"), F.col("root").alias("root"))
    of_first = roots.select(F.col("node").alias("a"), F.col("root").alias("first_root"))
    rooted = members.join(of_line, "line", "left").join(of_first, "a", "left")
    rooted = rooted.select("band", "line", F.coalesce("root", "line").alias("root"), F.coalesce("first_root", "a").alias("first_root"))
    rooted = stored(rooted, "rooted")
    discard(members)
    mixed = rooted.where("root <> first_root").select("band").distinct()
    mixed = stored(rooted.join(_sized(stored(mixed, "mixed")), "band"), "unlinked")
    discard(rooted)
    if mixed.isEmpty():
        discard(texts)
        return good
    lines_of = _sized(stored(mixed.select("line").distinct(), "apart"))
    sketched = _stored_by_batches(_sketched(texts.join(lines_of, "line")), "sketches")
    odd = mixed.withColumn("odd", F.col("root") != F.col("first_root")).drop("first_root")
    compared = stored(odd.join(sketched.join(lines, "line"), "line"), "sketched")
    discard(mixed, sketched)
    mixed = compared
    x, y = mixed.where("odd").alias("x"), mixed.alias("y")
    # A pair is met once: in the first band it shares, and from its smaller line if both are odd.
    common = [F.when(F.col("x.bands")[k] == F.col("y.bands")[k], F.col("x.bands")[k]) for k in range(BANDS)]
    apart = (F.col("x.band") == F.col("y.band")) & (F.col("x.root") != F.col("y.root"))
    apart &= (~F.col("y.odd") | (F.col("x.line") < F.col("y.line"))) & (F.coalesce(*common) == F.col("x.band"))
    others = x.join(y, apart & _close(F.col("x.shingles") + F.col("y.shingles"), "x", "y"))
    others = others.select(F.least("x.line", "y.line").alias("a"), F.greatest("x.line", "y.line").alias("b"))
    linked = _stored_by_batches(good.union(_similar(others, texts)), "linked")
    discard(good, texts, mixed)
    return linked


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with, of each group of similar lines in the whole table, only the first (by doc_id, then place) left in its text.

    Two lines are similar if the Jaccard similarity of their sets of ``SHINGLE`` consecutive characters is ``SIMILARITY`` or more
    (white space around a line set aside); groups are linked through others. Lines under ``LEAST_CHARS`` characters
    stay. All rows and columns stay; ``n_chars`` follows the text if it is there. Null and empty texts stay as
    they are. Rows that repeat both doc_id and text are one document and are treated alike; a missing doc_id comes
    first. Lines are told apart by 64-bit hashes.
    """
    marks = _stored_by_batches(line_marks(docs), "marks")
    place = F.struct("doc_id", "row", "pos")
    lines = marks.groupBy("line").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    lines = stored(lines, "lines")
    links = line_links(docs, lines.select("line", "bands"))
    roots = component_roots(links).withColumnRenamed("node", "line")
    several = lines.select("line", "first", "n").join(roots, "line", "left").where("n > 1 OR root IS NOT NULL")
    several = stored(several.select("line", "first", F.coalesce("root", "line").alias("root")), "several")
    discard(links, lines)
    kept = several.groupBy("root").agg(F.min("first").alias("first"))
    keepers = stored(several.select("line", "root").join(kept, "root").select("line", "first"), "keepers")
    dropped = marks.select("line", "row", "pos", place.alias("place")).join(_sized(keepers), "line")
    dropped = dropped.where(~F.col("place").eqNullSafe(F.col("first"))).select("row", "pos").distinct()
    dropped = stored(dropped.groupBy("row").agg(F.collect_list("pos").alias("gone")), "dropped")
    discard(marks, several, keepers)
    own_row, own_gone = unused("row", docs.columns), unused("gone", docs.columns)
    gone = _sized(dropped.select(F.col("row").alias(own_row), F.col("gone").alias(own_gone)))
    rows = docs.join(gone, F.xxhash64(docs["doc_id"], docs["text"]) == F.col(own_row), "left")
    stay = F.filter(F.split("text", "\n", -1), lambda line, at: ~F.array_contains(own_gone, at))
    rows = rows.withColumn("text", F.when(F.col(own_gone).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
