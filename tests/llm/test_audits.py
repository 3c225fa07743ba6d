"""Decontamination, source divergence and phrases: against SQL on odd tables, and against plain Python."""

from __future__ import annotations

import random
import re

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import decontamination, divergence, oracle, phrases
from tallyshelf.llm.texts import slices
from tests.compare import difference

SCHEMA = "doc_id long, text string, lang string, source string, prefix string, n long, data int, item string, words string"


def docs_of(spark, rows):
    """Rows ``(doc_id, text, lang, source)`` with further columns named like the operators' own."""
    return spark.createDataFrame([(*r, "p", 1, 2, "i", "w") for r in rows], SCHEMA)


def sql_tables(**tables):
    connection = duckdb.connect()
    for name, (columns, rows) in tables.items():
        frame = pd.DataFrame(rows, columns=columns.split(), dtype=object)
        connection.register(f"{name}_frame", frame)
        kinds = {"doc_id": "BIGINT", "item_id": "BIGINT"}
        chosen = ", ".join(f"CAST({c} AS {kinds.get(c, 'VARCHAR')}) AS {c}" for c in frame.columns)
        connection.execute(f"CREATE TABLE {name} AS SELECT {chosen} FROM {name}_frame")
    return connection


def corpus(count=140, seed=3):
    """Texts of few words of several lengths and scripts, with marks, upper case, nulls, empty texts, repeated rows and a very long one."""
    pick = random.Random(seed)
    stem = "unterscheidungsvermögenszusammenhangsbeschreibung" * 3
    vocabulary = ["a", "An", "the", "THE", "été", "ÉTÉ", "naïve", "日本語", "x1y", "don't", "abcd", "abcde", "abcdefgh", "abcdefghi", stem, stem + "en", stem + "s"]
    vocabulary += ["".join(pick.choices("abcdé", k=pick.randrange(1, 20))) for _ in range(60)]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", "; ", "!", "?", ":", "\x0b", "\x0c", " - ", "\x00"]
    text = lambda n: "".join(pick.choice(vocabulary) + pick.choice(ends) for _ in range(n))
    rows = [(k, text(pick.randrange(0, 120)), pick.choice(["en", "en", "fr", None]), pick.choice(["s0", "s1", "s2", None, ""])) for k in range(count)]
    rows += [rows[5]] * 40 + [(None, text(50), "en", "s1"), (7, None, "en", "s3"), (8, "", "en", "s1"), (9, None, "de", "only"), (10, " \n ", "de", "two")]
    return [*rows, (900, text(260_000), "en", "s0"), (901, "x" * 1_500_000 + " y", "fr", "s9")]


@pytest.fixture(scope="module")
def table(spark):
    rows = corpus()
    return docs_of(spark, rows), sql_tables(documents=("doc_id text lang source", rows))


def test_divergence_on_odd_rows(table):
    docs, duck = table
    assert difference(divergence.audit(docs), duck, oracle.DIVERGENCE) is None


def test_phrases_on_odd_rows(table):
    docs, duck = table
    assert difference(phrases.mine(docs), duck, oracle.PHRASES) is None


def test_phrases_across_chunks_and_languages(spark):
    pick = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    piece = lambda: " ".join(pick.choices(words, k=40))
    rows = [(k, ". ".join(piece() for _ in range(10_000)), f"l{k % 2}", "s") for k in range(4)]
    rows += [(k, " ".join(pick.choices(words, k=30)), f"l{k}", "s") for k in range(4, 60)]
    docs = docs_of(spark, rows).coalesce(1)
    assert difference(phrases.mine(docs), sql_tables(documents=("doc_id text lang source", rows)), oracle.PHRASES) is None


def test_products_of_counts_beyond_64_bits(spark):
    counts = [(10**13, 10**14, 3 * 10**13), (10, 10, 10), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999)]
    rows = spark.createDataFrame(counts, "a long, l long, r long")
    found = rows.select("*", phrases.score(rows.a, rows.l, rows.r).alias("score")).collect()
    assert [r.score for r in found] == [10**6 * a * a // (left * r) for a, left, r in counts]
    many = spark.createDataFrame([(9 * 10**13, 10**15, 10**6)], "n long, total long, terms long")
    assert many.select(divergence.share(many.n, many.total, many.terms)).first()[0] == 1 + 10**9 * (9 * 10**13 + 5) // (10**15 + 5 * 10**6)


def test_contracted_nodes_have_the_count_of_their_edge(spark):
    rows = [(k, "alpha beta gamma delta. beta x", "en", "s") for k in range(12)]
    found = {r.phrase: (r.a, r.l, r.r) for r in phrases.mine(docs_of(spark, rows)).collect()}
    # Its inner nodes are contracted; beta also begins another piece.
    assert found == {"alpha beta gamma": (12, 12, 12), "beta gamma delta": (12, 24, 12), "beta x": (12, 24, 12)}


ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven"), (2, "short, question?"), (3, None), (4, "..."), (5, ""),
    (11, "two three four five six seven eight nine ten eleven"), (1, "été 12 x"), (None, "short question"), (20, "a a a a a a a a a a a a"),
]


def decontaminated(texts):
    """``(n_words, n_hit, items, spans)`` of each text by trying every item at every word."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    pieces = set()
    for item, text in ITEMS:
        own = word.findall(low(text))
        size = min(10, len(own))
        pieces |= {("" if item is None else str(item), tuple(own[k : k + size])) for k in range(len(own) - size + 1) if own}
    for text in texts:
        marks = list(word.finditer(low(text)))
        own = [m[0] for m in marks]
        hit, items = set(), set()
        for item, piece in pieces:
            for k in range(len(own) - len(piece) + 1):
                if tuple(own[k : k + len(piece)]) == piece:
                    hit |= set(range(k, k + len(piece)))
                    items.add(item)
        starts = [k for k in sorted(hit) if k - 1 not in hit]
        ends = [k for k in sorted(hit) if k + 1 not in hit]
        yield len(own), len(hit), sorted(items), [(marks[a].start(), marks[b].end()) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("part", [1000, 3])
def test_decontamination_by_trying_everything(spark, part):
    texts = [
        "ONE two  three\nfour-five,six seven eight nine ten eleven twelve", "Es is’t: short question! été 12 x.", "short\tquestion short question", None, "", "...",
        "two three four five six seven eight nine ten", "a " * 30 + "b", "日本 short question 日本 two three four five six seven eight nine ten eleven",
        "questionshort question", "filler " * 200_000 + "Short question " + "filler " * 3,
    ]
    docs = docs_of(spark, [(k, t, "en", "s") for k, t in enumerate(texts)] + [(None, texts[1], "en", "s")])
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.find_overlaps(docs, benchmark, part=part).collect()}
    for k, (words, hit, items, spans) in zip([*range(len(texts)), None], decontaminated([*texts, texts[1]]), strict=True):
        row = found[k]
        assert (row.n_words, row.n_hit, row["items"], [tuple(s) for s in row.spans]) == (words, hit, items, spans)
    duck = sql_tables(documents=("doc_id text", [(k, t) for k, t in enumerate(texts)] + [(None, texts[1])]), benchmark=("item_id text", ITEMS))
    digest = decontamination.digest(decontamination.find_overlaps(docs, benchmark, part=part)).drop("spans")
    assert difference(digest, duck, oracle.DECONTAMINATION) is None
    kept = decontamination.clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if not r.n_hit}


def test_long_items_have_all_their_windows(spark):
    words = [f"w{k}" for k in range(400_000)]
    text = " ".join(words)
    found = decontamination.windows(spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert found.count() == len(words) - 9
    assert found.agg(F.countDistinct("window")).first()[0] == len(words) - 9
    assert found.where(F.col("window") == " ".join(words[149_995:150_005])).count() == 1


def test_empty_tables(spark):
    docs, benchmark = docs_of(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert divergence.audit(docs).collect() == [] == phrases.mine(docs).collect()
    assert decontamination.find_overlaps(docs, benchmark).collect() == []
    one = docs_of(spark, [(1, "short question", "en", "s")])
    row = decontamination.find_overlaps(one, benchmark.limit(0)).first()
    assert (row.n_words, row.n_hit, row["items"], row.spans) == (2, 0, [], [])


def test_slices_keep_all_bytes_and_cut_at_breaks():
    data = b"abc def  ghi " * 50
    parts = list(slices(data, re.compile(b" "), 100))
    assert b"".join(parts) == data and all(p.startswith(b" ") for p in parts[1:]) and len(parts) > 5
    assert list(slices(b"x" * 300, re.compile(b" "), 100)) == [b"x" * 300] and list(slices(b"", re.compile(b" "))) == [b""]


def test_divergence_counts_a_group_at_a_time(monkeypatch):
    rows = [("en", "a", b"one two"), ("de", "a", b"drei"), ("en", "a", b""), ("en", "b", b"one"), ("en", "a", b"two")]
    batches = lambda: iter(pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*part, strict=True)], ["lang", "source", "data"])
                           for part in (rows[:2], rows[2:]))
    assert list(divergence.by_group(batches())) == [
        (("en", "a"), [b"one two", b"", b"two"]), (("de", "a"), [b"drei"]), (("en", "b"), [b"one"])]
    monkeypatch.setattr(divergence, "HELD_BYTES", 8)
    parts = list(divergence.by_group(batches()))
    assert len(parts) == 4 and sorted((*name, data) for name, group in parts for data in group) == sorted(rows)
    assert list(divergence.by_group(iter([]))) == []
