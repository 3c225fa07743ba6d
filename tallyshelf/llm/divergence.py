"""How far the sources of a language differ in their use of its frequent terms.

The frequent terms are found by iceberg refinement of byte prefixes: prefixes of a few bytes are counted by the documents that have them;
those in too few documents are discarded with all that begins with them, the others are extended, until only complete terms are left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyshelf.llm.texts import slices
from tallyshelf.sources.scratch import stored

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SMOOTH = 5
UNIT = 1_000_000_000
# Bytes of the first prefixes (shorter ones are in nearly all documents); each level doubles them.
FIRST_PREFIX = 8
# What survives a level is told to the next one as so many bits: 2 MB, whatever the size of the corpus. A discarded prefix whose bit is
# set by another one costs some counting and changes nothing, as every level counts exactly.
FILTER_BITS = 1 << 24
# Keys counted in a task before they are passed on, and terms whose fate it remembers.
HELD_KEYS, KNOWN_TERMS = 700_000, 500_000
# Bytes of texts put in order by group before their terms are counted, and terms of a group counted before those not asked for go.
HELD_BYTES, GROUP_TERMS = 16_000_000, 200_000
# Cells (terms times sources) of one matrix.
CELLS = 50_000
# Ends a complete term; no term holds it.
END = b"\0"

# Letters as they are or in lower case, everything else as a space.
_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BREAK = re.compile(rb"[^a-zA-Z\x80-\xff]")


class Survivors:
    """Bits of the ``(lang, prefix)`` that are left."""

    def __init__(self, table: DataFrame):
        place = F.pmod(F.xxhash64(F.concat(F.col("lang").cast("binary"), F.lit(END), F.col("prefix"))), F.lit(FILTER_BITS))
        words = table.select(place.alias("place")).groupBy(F.expr("shiftright(place, 6)").alias("word"))
        found = words.agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
        bits = np.zeros(FILTER_BITS // 64, np.int64)
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.bits, self.empty = bits.tobytes(), len(found) == 0

    def has(self, lang: bytes, prefix: bytes) -> bool:
        place = xxhash.xxh64_intdigest(lang + END + prefix, 42) % FILTER_BITS
        return bool(self.bits[place >> 3] >> (place & 7) & 1)


class Members:
    """Which prefixes of a language are left: those met are remembered, so that most are found in a small set."""

    def __init__(self, left: Survivors, lang: str):
        self.left, self.lang = left, lang.encode()
        self.inside: set[bytes] = set()
        self.outside: set[bytes] = set()

    def decide(self, prefix: bytes) -> bool:
        """For a prefix that is neither ``inside`` nor ``outside`` yet."""
        there = self.left.has(self.lang, prefix)
        (self.inside if there else self.outside).add(prefix)
        if len(self.inside) + len(self.outside) > KNOWN_TERMS:
            self.inside.clear()
            self.outside.clear()
        return there


def texts_of(docs: DataFrame) -> DataFrame:
    """``lang, source, data``; nulls become empty."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(empty("lang").alias("lang"), empty("source").alias("source"), empty("text").cast("binary").alias("data"))


def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, ...], list[bytes]]]:
    """Texts by the columns before them, so that those of one group are counted together while its counts are at hand.

    About ``HELD_BYTES`` are put in order at once; a group comes back with its later texts.
    """
    held, size = {}, 0
    for batch in batches:
        *names, texts = batch.columns
        for name, text in zip(zip(*(x.to_pylist() for x in names), strict=True), texts, strict=True):
            data = text.as_py()
            held.setdefault(name, []).append(data)
            size += len(data)
            if size > HELD_BYTES:
                yield from held.items()
                held, size = {}, 0
    yield from held.items()


def prefix_documents(texts: DataFrame, length: int, parents: Survivors | None) -> DataFrame:
    """``lang, prefix, docs``: for each prefix of ``length`` bytes that extends one of the ``parents`` the documents that have it.

    A complete term counts as itself and ``END``. Documents are whole rows, so each task counts its own and the counts add up.
    """
    before = length // 2

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: dict[str, Members] = {}
        counts: dict[str, Counter[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                prefixes = [x if len(x) == length else x + END for x in own]
                columns = [pa.array([lang] * len(own), pa.string()), pa.array(prefixes, pa.binary()), pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "docs"])
            counts.clear()

        held = 0
        for (lang,), group in by_group(batches):
            if lang not in members and parents is not None:
                members[lang] = Members(parents, lang)
            for data in group:
                own: set[bytes] = set()
                for part in slices(data, _BREAK):
                    terms = part.translate(_LETTERS).split()
                    if parents is None:
                        own.update({term[:length] for term in terms})
                    else:  # shorter terms were complete at the level before
                        inside, outside, decide = members[lang].inside, members[lang].outside, members[lang].decide
                        long = {term[:length] for term in terms if len(term) >= before}
                        own.update([x for x in long if (p := x[:before]) in inside or (p not in outside and decide(p))])
                counted = counts.setdefault(lang, Counter())
                held -= len(counted)
                counted.update(own)
                held += len(counted)
                if held > HELD_KEYS:
                    yield from flush()
                    held = 0
        yield from flush()

    found = texts.select("lang", "data").mapInArrow(per_batch, "lang string, prefix binary, docs long")
    # Tasks have added up their own: adding again before the exchange would hardly shorten it.
    return found.repartition("lang", "prefix").groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"))


def frequent_terms(texts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term``: the terms that at least ``least`` documents of the language have, refined level by level."""
    kept, parents, length = [], None, FIRST_PREFIX
    while True:
        left = stored(prefix_documents(texts, length, parents).where(F.col("docs") >= least), "prefixes")
        complete = F.endswith("prefix", F.lit(END))
        term = F.expr("CAST(substring(prefix, 1, length(prefix) - 1) AS STRING)")
        kept.append(left.where(complete).select("lang", term.alias("term")))
        parents, length = Survivors(left.where(~complete)), length * 2
        if parents.empty:
            return reduce(DataFrame.union, kept)


def occurrences(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``lang, source, term, n``: how often each of ``terms (lang, term)`` occurs in each source that has it."""
    kept = Survivors(terms.select("lang", F.col("term").cast("binary").alias("prefix")))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: dict[str, Members] = {}
        counts: dict[tuple[str, str], Counter[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for names, own in counts.items():
                terms = pa.array(list(own), pa.binary()).cast(pa.string())
                columns = [*(pa.array([x] * len(own), pa.string()) for x in names), terms, pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n"])
            counts.clear()

        held = 0
        for (lang, source), group in by_group(batches):
            if lang not in members:
                members[lang] = Members(kept, lang)
            inside, outside, decide = members[lang].inside, members[lang].outside, members[lang].decide
            own, every = counts.setdefault((lang, source), Counter()), Counter()
            held -= len(own)
            for data in group:
                for part in slices(data, _BREAK):
                    every.update(part.translate(_LETTERS).split())
                    if len(every) > GROUP_TERMS:
                        own.update({term: n for term, n in every.items() if term in inside or (term not in outside and decide(term))})
                        every.clear()
            own.update({term: n for term, n in every.items() if term in inside or (term not in outside and decide(term))})
            held += len(own)
            if held > HELD_KEYS:
                yield from flush()
                held = 0
        yield from flush()

    found = texts.mapInArrow(per_batch, "lang string, source string, term string, n long")
    found = found.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    return found.join(terms, ["lang", "term"], "left_semi")


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms))`` in decimal arithmetic; null where there are no terms."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(19,0)")
    below = (total + SMOOTH * terms).cast("decimal(19,0)")
    return F.when(terms > 0, 1 + F.call_function("div", above, below))


def distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: for each ordered pair of sources of a language the summed absolute difference of their shares.

    ``cells (lang, source, term, p)`` has the shares of terms that a source has, ``groups (lang, source, nothing, terms)`` the share of
    those it has not, and the number of terms of the language. Terms are dealt to matrices of about ``CELLS`` cells, whatever the language, of more if sources are very many;
    the differences of each matrix are exact and add up. The rows grow with the square of the sources, as the result does.
    """
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("terms").alias("terms"))
    # A matrix is well larger than the rows of differences that it gives.
    blocks = (1 + F.col("sources") * F.col("terms") / (CELLS + 8 * F.col("sources") * F.col("sources"))).cast("long")
    sizes = sizes.select("lang", blocks.alias("blocks"))
    here = cells.join(sizes, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "p")
    everywhere = groups.join(sizes, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", "nothing")

    def compare(own: pa.Table, groups: pa.Table) -> pa.Table:
        names = sorted(groups.column("source").to_pylist())
        number = {name: k for k, name in enumerate(names)}
        nothing = dict(zip(groups.column("source").to_pylist(), groups.column("nothing").to_pylist(), strict=True))
        codes = own.column("term").combine_chunks().dictionary_encode().indices.to_numpy() if len(own) else np.zeros(0, np.int64)
        shares = np.empty((codes.max() + 1 if len(codes) else 0, len(names)), np.int64)
        shares[:] = [nothing[name] or 0 for name in names]
        shares[codes, [number[name] for name in own.column("source").to_pylist()]] = own.column("p").to_numpy()
        left, right, value = [], [], []
        for k in range(len(names) - 1):
            value.append(np.abs(shares[:, k + 1 :] - shares[:, k : k + 1]).sum(axis=0))
            left += [names[k]] * (len(names) - k - 1)
            right += names[k + 1 :]
        lang = groups.column("lang")[0].as_py()
        value = np.concatenate(value) if value else np.zeros(0, np.int64)
        return pa.table({"lang": pa.array([lang] * len(left), pa.string()), "source": pa.array(left, pa.string()),
                         "item": pa.array(right, pa.string()), "value": pa.array(value, pa.int64())})

    partial = here.groupBy("lang", "block").cogroup(everywhere.groupBy("lang", "block")).applyInArrow(
        compare, "lang string, source string, item string, value long")
    once = partial.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return once.union(once.select("lang", F.col("item"), F.col("source"), "value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every language and source of ``docs (lang, source, text)``.

    A term is a run of letters (A-Z lower-cased, anything beyond ASCII); a language keeps those in at least ``least`` of its rows. A source's share of a term
    is smoothed and in billionths. Part ``pair`` ranks the other sources of the language by the summed difference of
    shares, part ``term`` the first ``top`` terms that the source has with a greater share than its language; ties go by
    the bytes of the item. Null text, lang and source are empty ones; empty texts have no terms, their groups still meet in pairs;
    repeated rows count as documents; an empty table gives an empty one; very long texts are read in slices; other columns are not read.
    """
    texts = texts_of(docs)
    terms = stored(frequent_terms(texts, least), "terms")
    counts = stored(occurrences(texts, terms), "counts")
    every = texts.groupBy("lang", "source").agg(F.lit(0).alias("zero")).drop("zero")
    kinds = terms.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").join(kinds, "lang", "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = stored(groups.withColumn("nothing", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    overall = counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).join(of_lang, "lang")
    overall = overall.select("lang", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("q"))
    cells = counts.join(groups, ["lang", "source"])
    cells = stored(cells.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "shares")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = distances(cells, groups).withColumn("rank", F.row_number().over(best))
    more = cells.join(overall, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    rows = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return rows.union(more.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
