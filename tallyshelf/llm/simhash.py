"""SimHash near-duplicates: 64-bit fingerprints, linked by self-joins of binary tries.

Fingerprints are grouped by every choice of error-free bit segments (with at most ``ERRORS`` wrong bits among ``k`` segments,
some ``k - ERRORS`` of them are right), and each group is a binary trie that is joined with itself: node pairs go down together,
add up differing bits, and are left as soon as the budget is exceeded.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.components import component_roots, merge_labels
from tallyshelf.sources.scratch import stored

ERRORS = 4
SHINGLE_WORDS = 4
SEED = 42
# Wanted mean of fingerprints per group: more segments are used for more fingerprints.
GROUP_MEAN = 256
# A group above this is dealt to several tasks as pairs of parts.
PART_ROWS = 4096
# Node pairs that are expanded at once, and pairs of leaves below which two nodes are compared directly.
FRONTIER, LEAF_PAIRS = 200_000, 32

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit fingerprint of a text; zero without words, and for null."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return 0
    if len(words) < words_per_shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle)), strict=False)))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, len(shingles))
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    set_bits = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    bits = (2 * set_bits > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (long) of every row of ``docs (doc_id, text)``."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {kind}, fingerprint long")


def trie_links(keys: np.ndarray, starts: np.ndarray, errors: int = ERRORS) -> np.ndarray:
    """Component labels (indices) of sorted uint64 ``keys``; ``starts`` are the bounds of groups that link only inside.

    Within each group the keys must be sorted. Memory is bounded by the frontier of node pairs.
    """
    label = np.arange(len(keys))
    counts: dict[int, np.ndarray] = {}

    def ones_before(bit: int) -> np.ndarray:
        if bit not in counts:
            counts[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int64)])
        return counts[bit]

    lo, hi = starts[:-1], starts[1:]
    large = hi - lo > 1
    stack = [(0, np.stack([lo[large], hi[large], lo[large], hi[large], np.zeros(large.sum(), np.int64)]))]
    while stack:
        bit, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(bit, pairs[:, :half]), (bit, pairs[:, half:])]
            continue
        n, m = pairs[1] - pairs[0], pairs[3] - pairs[2]
        done = (n * m <= LEAF_PAIRS) | (bit == 64)
        label = _compare(keys, label, pairs[:, done], errors)
        pairs = pairs[:, ~done]
        if not pairs.shape[1]:
            continue
        a_lo, a_hi, b_lo, b_hi, wrong = pairs
        before = ones_before(bit)
        a_mid = a_hi - (before[a_hi] - before[a_lo])
        b_mid = b_hi - (before[b_hi] - before[b_lo])
        same = a_lo == b_lo
        deeper = np.concatenate([
            np.stack([a_lo, a_mid, b_lo, b_mid, wrong]),
            np.stack([a_mid, a_hi, b_mid, b_hi, wrong]),
            np.stack([a_lo, a_mid, b_mid, b_hi, wrong + 1]),
            np.stack([a_mid, a_hi, b_lo, b_mid, wrong + 1])[:, ~same],
        ], axis=1)
        n, m = deeper[1] - deeper[0], deeper[3] - deeper[2]
        alone = (deeper[0] == deeper[2]) & (n == 1)
        deeper = deeper[:, (n > 0) & (m > 0) & ~alone & (deeper[4] <= errors)]
        if deeper.shape[1]:
            stack.append((bit + 1, deeper))
    return label


def _compare(keys: np.ndarray, label: np.ndarray, pairs: np.ndarray, errors: int) -> np.ndarray:
    """Compares all leaves below small node pairs."""
    n, m = pairs[1] - pairs[0], pairs[3] - pairs[2]
    size = n * m
    total = int(size.sum())
    for first in range(0, len(size), FRONTIER // 8) if total else ():
        part = slice(first, first + FRONTIER // 8)
        width = size[part]
        within = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        across = np.repeat(m[part], width)
        i = np.repeat(pairs[0][part], width) + within // across
        j = np.repeat(pairs[2][part], width) + within % across
        near = (i != j) & (label[i] != label[j])
        i, j = i[near], j[near]
        near = np.bitwise_count(keys[i] ^ keys[j]) <= errors
        label = merge_labels(label, i[near], j[near])
    return label


def _segments(count: int, errors: int) -> list[list[tuple[int, int]]]:
    """Choices of error-free segments as lists of (shift, width), so many that groups have ``GROUP_MEAN`` members or fewer."""
    k = errors + 1
    while k < 12 and count / 2 ** (64 * (k - errors) // k) > GROUP_MEAN:
        k += 1
    bounds = [64 * s // k for s in range(k + 1)]
    cuts = [(lo, hi - lo) for lo, hi in itertools.pairwise(bounds)]
    return [list(choice) for choice in itertools.combinations(cuts, k - errors)]


def fingerprint_links(distinct: DataFrame, errors: int = ERRORS) -> DataFrame:
    """``a, b``: links that join all of ``distinct (fingerprint)`` within ``errors`` bits into the same components."""
    choices = _segments(distinct.count(), errors)
    keyed = []
    for number, segments in enumerate(choices):
        value = F.lit(0).cast("long")
        for shift, width in segments:
            bits = F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << width) - 1))
            value = F.shiftleft(value, width).bitwiseOR(bits)
        keyed.append(F.struct(F.lit(number).alias("choice"), value.alias("value")))
    rows = distinct.select("fingerprint", F.explode(F.array(*keyed)).alias("g")).select("fingerprint", "g.*")
    hot = rows.groupBy("choice", "value").count().where(F.col("count") > PART_ROWS)
    hot = stored(hot.withColumn("parts", F.ceil(F.col("count") / (PART_ROWS // 2)).cast("int")).drop("count"), "hot")
    if hot.isEmpty():
        rows = rows.withColumn("pair", F.lit(0))
    else:  # every unordered pair of parts meets in one task
        mine = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
        rows = rows.join(hot, ["choice", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        rows = rows.withColumn("mine", mine).withColumn("other", other)
        pair = F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")
        rows = rows.withColumn("pair", pair).select("choice", "value", "pair", "fingerprint").distinct()
    order = ["choice", "value", "pair"]
    rows = rows.select(*order, "fingerprint").repartition(*order).sortWithinPartitions(*order)

    def join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> pa.RecordBatch:
            group = [table.column(c).to_numpy() for c in order]
            keys = table.column("fingerprint").to_numpy().view(np.uint64)
            new = np.ones(len(keys), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in group])
            number = np.cumsum(new) - 1
            at = np.lexsort([keys, number])
            keys, number = keys[at], number[at]
            starts = np.append(np.flatnonzero(np.append(True, number[1:] != number[:-1])), len(keys))
            label = trie_links(keys, starts, errors)
            linked = np.flatnonzero(label != np.arange(len(keys)))
            pairs = [keys[linked].view(np.int64), keys[label[linked]].view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], ["a", "b"])

        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            last = [table.column(c)[table.num_rows - 1].as_py() for c in order] if table.num_rows else None
            if last is None:
                continue
            end = table.num_rows
            same = np.logical_and.reduce([table.column(c).to_numpy() == v for c, v in zip(order, last, strict=True)])
            end = int(np.argmax(same))  # the first row of the last group, which may go on in the next batch
            if end:
                yield links(table.slice(0, end))
            kept = table.slice(end)
        if kept is not None and kept.num_rows:
            yield links(kept)

    return rows.mapInArrow(join_groups, "a long, b long")


def near_duplicates(docs: DataFrame, errors: int = ERRORS) -> DataFrame:
    """``doc_id, fingerprint`` (long)``, component_id`` for every row of ``docs (doc_id, text)``.

    Documents link at ``errors`` differing bits or fewer; ``component_id`` is the smallest doc_id reachable. Equal
    fingerprints are one node, however many documents have them. Null and empty texts have fingerprint zero and
    link like any other; rows without a doc_id get the component of their fingerprint; a repeated doc_id
    gives a row each time; an empty table an empty one. Other columns are not read.
    """
    marked = stored(fingerprints(docs), "fingerprints")
    groups = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "groups")
    roots = component_roots(fingerprint_links(groups.select("fingerprint"), errors))
    groups = groups.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    groups = groups.withColumn("root", F.coalesce("root", "fingerprint"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = groups.join(least, "root").select("fingerprint", "component_id")
    return marked.join(groups, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, errors: int = ERRORS) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of near-duplicates; all columns stay.

    Rows without a doc_id stay, for no group can name them; of rows that repeat a kept doc_id one stays.
    """
    marked = near_duplicates(docs, errors)
    kept = stored(marked.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "kept")
    named = kept.select(F.col("doc_id").alias("__kept"), F.col("n").alias("__times"))
    rows = docs.join(named, docs["doc_id"] == named["__kept"], "left_semi")
    if not kept.where("n > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id"])
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))
