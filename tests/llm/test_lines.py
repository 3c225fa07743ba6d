"""Fuzzy line deduplication and the pipeline against plain Python."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
from tallyshelf.llm import lines
from tests.llm import brute
from tests.llm.test_operators import ODD, documents

SMALL = "/root/testdata/sf0.001"


def expected(texts):
    own = [(i, k, line.strip(lines.SPACE)) for i in sorted(texts) for k, line in enumerate((texts[i] or "").split("\n"))]
    own = [x for x in own if len(x[2]) >= lines.LEAST_CHARS]
    distinct = list(dict.fromkeys(line for _, _, line in own))
    sets = [frozenset(x[k : k + 9] for k in range(len(x) - 8)) for x in distinct]
    where: dict[str, list[int]] = {}
    links = []
    for a, shingles in enumerate(sets):
        shared: dict[int, int] = {}
        for x in shingles:
            for b in where.setdefault(x, []):
                shared[b] = shared.get(b, 0) + 1
            where[x].append(a)
        links += [(b, a) for b, n in shared.items() if n >= 0.8 * (len(shingles) + len(sets[b]) - n)]
    roots = brute.components(range(len(distinct)), links)
    number = {line: k for k, line in enumerate(distinct)}
    kept, gone = set(), set()
    for i, k, line in own:
        gone |= {(i, k)} if roots[number[line]] in kept else set()
        kept.add(roots[number[line]])
    return {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in texts.items()}


def test_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = lines.dedup_lines(docs)
    assert found.columns == docs.columns
    rows = found.collect()
    assert {r.doc_id: r.text for r in rows} == expected(texts)
    assert all(r.n_chars == len(r.text) for r in rows)


def near_copies(count, seed=5):
    """Lines around the threshold to one base line and to each other, of several lengths."""
    pick = random.Random(seed)
    bases = ["".join(pick.choices("abcdefgh ", k=size)).strip() for size in (60, 300, 900)]
    made = []
    for _ in range(count):
        line = list(pick.choice(bases))
        for _ in range(pick.randrange(1, max(2, len(line) // 50))):
            line[pick.randrange(len(line))] = pick.choice("xyz")
        made.append("".join(line))
    return made


def test_sketches_never_exceed_the_difference():
    own = near_copies(60)
    bits = np.unpackbits(lines.sketches(own).view(np.uint8), axis=1)
    sets = [{x[k : k + 9] for k in range(len(x) - 8)} for x in own]
    for i in range(len(own)):
        for j in range(i):
            assert (bits[i] != bits[j]).sum() <= len(sets[i] ^ sets[j])


def around_168(seed=11):
    """Lines of 165 characters, each with its copies that one and two inserted words make longer than 168."""
    pick = random.Random(seed)
    groups = []
    for _ in range(60):
        base = "".join(pick.choices("abcdefghijklmnopqrst", k=165))
        at = pick.randrange(1, 164)
        groups.append([base, f"{base} word", f"{base[:at]} more {base[at:]}"])
    return groups


def test_similar_lines_of_every_length_share_a_band():
    groups = around_168()
    bands = lines.band_hashes([line for group in groups for line in group]).reshape(len(groups), 3, lines.BANDS)
    assert (bands[:, 0] == bands[:, 1]).any(axis=1).all() and (bands[:, 0] == bands[:, 2]).any(axis=1).all()


def test_groups_around_168_characters(spark):
    texts = [line for group in around_168() for line in group]
    found = {r.doc_id: r.text for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert found == expected(dict(enumerate(texts)))


def test_groups_around_the_threshold(spark):
    texts = near_copies(240)
    found = {r.doc_id: r.text for r in lines.dedup_lines(documents(spark, texts)).collect()}
    assert found == expected(dict(enumerate(texts)))


def test_odd_rows(spark):
    line = "this line of some length is repeated"
    texts = [*ODD, line, f"{line}\nshort\n\n{line}s", "short", f"  {line}\t"]
    table = documents(spark, texts)
    found = lines.dedup_lines(table)
    assert found.columns == table.columns
    rows = sorted(found.collect(), key=lambda r: r.doc_id or 0)
    by_id = {r.doc_id: r.text for r in rows}
    assert len(rows) == len(texts) and by_id[0 + len(ODD)] == line
    assert by_id[len(ODD) + 1] == "short\n" and by_id[len(ODD) + 2] == "short" and by_id[len(ODD) + 3] == ""
    assert sum(r.text is None for r in rows) == 1
    assert lines.dedup_lines(table.limit(0)).count() == 0


def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "PII", "best-fit packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    start = {r.doc_id for r in docs.collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} <= start and len(rows) > len(start) // 2
    places: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == places.get(r.sequence_id, 0)
        places[r.sequence_id] = r.offset + r.length
    assert max(places.values()) <= 1024


def test_pairs_that_cannot_be_similar_are_told_by_hashes():
    made = near_copies(200) + ["x" * 9, "ab" * 40, "é" * 30 + "日本語" * 9, "y" * 10_000]
    left, right = made[:100] * 2 + made[200:] * 2, made[100:200] + made[:100] + made[200:] + made[200:][::-1]
    sets = lambda line: frozenset(line[k : k + 9] for k in range(len(line) - 8))
    similar = [len(sets(a) & sets(b)) >= 0.8 * len(sets(a) | sets(b)) for a, b in zip(left, right, strict=True)]
    may = lines.may_be_similar(left, right).tolist()
    assert all(x >= y for x, y in zip(may, similar, strict=True)) and sum(similar) > 100 and not all(may)
    assert sum(may) <= sum(similar) + 5
    pairs = [("abcdefghij" * 5 + str(k), "klmnopqrst" * 5 + str(k)) for k in range(lines.CHUNK_LINES)]
    assert not lines.may_be_similar(*zip(*pairs, strict=True)).any()
    assert lines.may_be_similar(*zip(*[(a, a) for a, _ in pairs], strict=True)).all()


def test_texts_of_some_lines(spark):
    docs = spark.createDataFrame([("a long line\n  another line\t\nshort\r\n", ), (None, ), ("",), ("another line\na third line é", )], "text string")
    own = ["another line", "a third line é", "not a line here"]
    asked = spark.createDataFrame([(x,) for x in own], "text string").selectExpr("xxhash64(text) AS line")
    assert sorted(r.text for r in lines.line_texts(docs, asked).collect()) == sorted(own[:2])
    assert lines.line_texts(docs, asked.limit(0)).count() == 0
