"""Phrases whose words occur together, from a weighted de Bruijn graph.

A node is a pair of consecutive words, an edge a triple: the step to the next pair. Pieces end in end marks, so every word begins exactly one
edge, and edges into the end mark are the corrections for words after which a piece ends. Only edges are counted over the corpus; the count of a pair is the flow
out of its node, that of a word the flow out of all nodes that begin with it. A node whose whole flow comes in by one edge and leaves by
one edge lies on an unary path: it is contracted into its edges, which carry its count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.llm.texts import slices
from tallyshelf.sources.scratch import discard, stored

LEAST_COUNT = 10
TOP = 2000
COVERED = 50  # a phrase is dropped if a longer one has so many hundredths of its count
SCALE = 1_000_000
NO_LANG = "und"
# Words whose edges are counted at once in a task. With the words of one more slice of text their numbers fit 21 bits.
CHUNK_TOKENS = 1_000_000
# Bits that tell the tasks which words' texts are wanted: 2 MB at most.
FILTER_BITS = 1 << 24

FIELDS = ["a", "b", "c", "n", "of"]

# Words, and runs of marks between pieces.
_TOKEN = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+|[.,;:!?\x0A-\x0D]+")
_MARKS = frozenset(b".,;:!?\n\x0b\x0c\r")
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def word_hash(lang: str, word: bytes, seed: int) -> int:
    """A word of a language as a 64-bit number that is not 0, the end mark."""
    return xxhash.xxh64_intdigest(lang.encode() + b"\n" + word, seed) or 1


def lang_hash(lang: str, seed: int) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(lang.encode(), seed)).view(np.int64))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))


class _Numbers(dict):
    """Numbers words as they come; marks are 0."""

    def __init__(self, lang: str, seed: int):
        super().__init__()
        self.lang, self.seed, self.hashes = lang, seed, [0]

    def __missing__(self, token: bytes) -> int:
        if token[0] in _MARKS:
            self[token] = 0
        else:
            self[token] = len(self.hashes)
            self.hashes.append(word_hash(self.lang, token, self.seed))
        return self[token]


def edges_of(numbers: list[int], hashes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct edges that begin in a sequence of numbered tokens (but for its last two) as three hashes, and their counts, in order of the hashes."""
    ids = np.array(numbers, np.int64)
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    packed = (a << 42 | b << 21 | np.where(b == 0, 0, c))[a > 0]
    packed, n = np.unique(packed, return_counts=True)
    of = np.array(hashes, np.uint64).view(np.int64)
    mask = (1 << 21) - 1
    keys = [of[packed >> 42], of[packed >> 21 & mask], of[packed & mask]]
    order = np.lexsort(keys[::-1])
    return [k[order] for k in keys], n[order]


def edges(texts: DataFrame, seed: int) -> DataFrame:
    """``a, b, c, n, of``: edges as hashes of words with their counts in chunks of a task, and the hash of their language; ``b`` and ``c`` are 0
    after the end of a piece.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[_Numbers, list[int]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (numbers, tokens) in held.items():
                keys, n = edges_of(tokens, numbers.hashes)
                if len(n):
                    columns = [*keys, n, np.full(len(n), lang_hash(lang, seed))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], FIELDS)

        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in slices(data.as_py(), _BREAK):
                    if lang not in held:
                        held[lang] = _Numbers(lang, seed), []
                    numbers, tokens = held[lang]
                    found = _TOKEN.findall(part.lower())
                    tokens += map(numbers.__getitem__, found)
                    size += len(found)
                    if size > CHUNK_TOKENS:
                        yield from flush()
                        held.clear()
                        # The last two tokens of this text begin edges that go on in its next slice.
                        held[lang] = after = _Numbers(lang, seed), []
                        for number in tokens[-2:]:
                            after[1].append(len(after[0].hashes) if number else 0)
                            after[0].hashes += [numbers.hashes[number]] if number else []
                        size = 2
                held[lang][1].extend((0, 0))
        yield from flush()

    return texts.mapInArrow(per_batch, ", ".join(f"{name} long" for name in FIELDS))


def _sums(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of runs of equal keys."""
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    starts = np.flatnonzero(new)
    return [k[starts] for k in keys], np.add.reduceat(n, starts)


def flows(counted: DataFrame, least: int) -> DataFrame:
    """Three kinds of rows ``a, b, c, n, of``: edges and nodes (``c`` is 0) of ``least`` or more, and parts of the flow of words (``b`` is 0).

    Edges are dealt by their node and sorted, so a task sums up edge after edge and node after node as they pass by; no node is
    gathered, however many edges it has.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums that the next batch may add to: of the last edge and the last node.
        edge, node = [np.zeros(0, np.int64)] * 5, [np.zeros(0, np.int64)] * 4

        def rows(columns: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], FIELDS)

        def done(edge: list[np.ndarray], node: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b, c, of, n = edge
            yield rows([a, b, c, n, of], (n >= least) & (c != 0))
            a, b, of, n = node
            yield rows([a, b, np.zeros_like(a), n, of], (n >= least) & (b != 0))

        for batch in batches:
            if not len(batch):
                continue
            a, b, c, n, of = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            *keys, counts = [np.concatenate(x) for x in zip(edge, (a, b, c, of, n), strict=True)]
            keys, sums = _sums(keys, counts)
            edge = [*keys, sums]
            *keys, counts = [np.concatenate(x) for x in zip(node, (a, b, of, n), strict=True)]
            keys, sums = _sums(keys, counts)
            node = [*keys, sums]
            yield from done([x[:-1] for x in edge], [x[:-1] for x in node])
            edge, node = [x[-1:] for x in edge], [x[-1:] for x in node]
            (word, own), flow = _sums([a, of], n)
            none = np.zeros_like(word)
            yield rows([word, none, none, flow, own], flow > 0)
        yield from done(edge, node)

    dealt = counted.repartition("a", "b").sortWithinPartitions("a", "b", "c")
    return dealt.mapInArrow(per_batch, dealt.schema)


def contract(nodes: DataFrame, solid: DataFrame) -> DataFrame:
    """``a, b, n, of, longest`` of the nodes that are on no unary path; ``longest`` is the count of the heaviest edge in or out.

    All that flows through a node on such a path comes in by one edge and leaves by one: it needs no row, its edges have its count.
    """
    out = solid.groupBy("a", "b").agg(F.max("n").alias("most_out"))
    into = solid.groupBy(F.col("b").alias("a"), F.col("c").alias("b")).agg(F.max("n").alias("most_in"))
    both = nodes.join(out, ["a", "b"], "left").join(into, ["a", "b"], "left")
    both = both.select("a", "b", "n", "of", F.coalesce("most_out", F.lit(0)).alias("most_out"), F.coalesce("most_in", F.lit(0)).alias("most_in"))
    return both.where("most_in < n OR most_out < n").select("a", "b", "n", "of", F.greatest("most_in", "most_out").alias("longest"))


def vocabulary(texts: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``lang, word, hash, n``: the words whose ``hash`` is in ``wanted`` (and few others); one row per language has no word and its count of words."""
    place = F.pmod("hash", F.lit(FILTER_BITS))
    words = wanted.select(place.alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    bits = bits.tobytes()
    pattern = re.compile(rb"[^\x20\x09.,;:!?\x0A-\x0D]+")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[bytes]] = {}
        totals: dict[str, int] = {}

        def rows(lang: str, words: list[bytes | None], hashes: list[int | None], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(words)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(hashes, pa.int64()),
                 pa.array([n] * len(words), pa.int64())], ["lang", "word", "hash", "n"])

        for batch in batches:
            for lang, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for part in slices(data.as_py(), _BREAK):
                    found = pattern.findall(part.lower())
                    totals[lang] = totals.get(lang, 0) + len(found)
                    new = set(found).difference(seen.setdefault(lang, set()))
                    seen[lang] |= new
                    chosen = []
                    for word in new:
                        h = word_hash(lang, word, seed)
                        if bits[h % FILTER_BITS >> 3] >> (h & 7) & 1:
                            chosen.append((word, h - (1 << 64) if h >> 63 else h))
                    if chosen:
                        yield rows(lang, [w for w, _ in chosen], [h for _, h in chosen], 0)
                    if sum(map(len, seen.values())) > CHUNK_TOKENS:
                        seen.clear()
        for lang, n in totals.items():
            yield rows(lang, [None], [None], n)

    found = texts.mapInArrow(per_batch, "lang string, word string, hash long, n long")
    return found.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n"))


def score(a: Column, left: Column, right: Column) -> Column:
    """``floor(SCALE * a * a / (left * right))`` in decimal arithmetic; counts have at most 15 digits, else Spark raises an error."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def candidates(texts: DataFrame, least: int, top: int, seed: int) -> DataFrame:
    """``a, b, c, n, l, r, score``: pairs (``c`` is 0) and triples of ``least`` occurrences that no longer candidate covers, as hashes.

    Of each language those that can be among the first ``top``: all with fewer than ``top`` better ones by score and count, ties included.
    """
    graph = stored(flows(edges(texts, seed), least), "graph")
    solid, nodes = graph.where("c <> 0"), graph.where("b <> 0 AND c = 0").drop("c")
    words = graph.where("b = 0").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = stored(words, "words")
    branching = stored(contract(nodes, solid), "branching")
    word = lambda column, count: words.select(F.col("a").alias(column), F.col("n").alias(count))
    node = lambda first, second, count: branching.select(F.col("a").alias(first), F.col("b").alias(second), F.col("n").alias(count))
    pairs = branching.where(F.col("longest") * 100 < F.col("n") * COVERED).select("a", "b", F.lit(0).cast("long").alias("c"), "n", "of")
    pairs = pairs.join(word("a", "l"), "a").join(word("b", "r"), "b")
    pairs = pairs.select("a", "b", "c", "n", "of", "l", "r", score(F.col("n"), F.col("l"), F.col("r")).alias("score"))
    # The count of a contracted node is that of its edge.
    triples = solid.join(node("a", "b", "left"), ["a", "b"], "left").join(node("b", "c", "right"), ["b", "c"], "left")
    triples = triples.join(word("a", "first"), "a").join(word("c", "last"), "c")
    early, late = (F.col("first"), F.coalesce("right", "n")), (F.coalesce("left", "n"), F.col("last"))
    triples = triples.select("a", "b", "c", "n", "of", early[0].alias("l1"), early[1].alias("r1"), late[0].alias("l2"), late[1].alias("r2"),
                             score(F.col("n"), *early).alias("s1"), score(F.col("n"), *late).alias("s2"))
    cut = lambda x: F.when(F.col("s2") < F.col("s1"), F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    triples = triples.select("a", "b", "c", "n", "of", cut("l").alias("l"), cut("r").alias("r"), cut("s").alias("score"))
    best = F.rank().over(Window.partitionBy("of").orderBy(F.desc("score"), F.desc("n")))
    ranked = pairs.union(triples).withColumn("place", best).where(F.col("place") <= top)
    found = stored(ranked.drop("of", "place"), "candidates")
    discard(graph, words, branching)
    return found


def mine(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two or three words in ``docs (lang, text)``.

    ``a`` is the phrase's count, ``l`` and ``r`` the counts of its two parts at the cut of the lowest score, ``n`` the language's count of words.
    Phrases with fewer than ``least`` occurrences, and those that lie in a longer phrase with at least half their count, do not rank. Null text is empty, null lang
    is ``und``; empty texts and tables have no phrases; repeated rows count; ties go by count, then by the bytes of the phrase; very long
    texts are read in slices; other columns are not read. Counts are kept by 64-bit hashes of words; should two words of phrases share one, other hashes
    are taken, so that no result rests on a collision.
    """
    texts = texts_of(docs)
    for seed in range(42, 52):
        found = candidates(texts, least, top, seed)
        wanted = found.select(F.explode(F.array("a", "b", "c")).alias("hash")).where("hash <> 0").distinct()
        known = stored(vocabulary(texts, wanted, seed), "vocabulary")
        words = known.where("word IS NOT NULL").select("hash", "lang", "word")
        if words.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").join(wanted, "hash", "left_semi").isEmpty():
            break
    else:
        raise ValueError("words share hashes under every seed")
    word = lambda column: words.select(F.col("hash").alias(column), F.col("word").alias(f"word_{column}"))
    spelled = found.join(words.select(F.col("hash").alias("a"), "lang", F.col("word").alias("word_a")), "a")
    spelled = spelled.join(word("b"), "b").join(word("c"), "c", "left")
    phrase = F.concat_ws(" ", "word_a", "word_b", "word_c")
    totals = known.where("word IS NULL").select(F.col("lang").alias("of"), F.col("n").alias("words"))
    ranked = spelled.select("lang", phrase.alias("phrase"), F.col("n").alias("a"), "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    ranked = ranked.join(totals, F.col("lang") == F.col("of"))
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
