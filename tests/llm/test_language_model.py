"""The backoff automaton against plain counts, and its probabilities' sums."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import language_model as lm


def tokens(text):
    lowered = re.sub(rb"[A-Z]", lambda m: bytes([m[0][0] + 32]), (text or "").encode())
    return [*re.findall(rb"[^\x20\x09-\x0D]+", lowered), b"\n"]


def test_base_score_and_gain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in tokens(t))
    total = sum(counts.values())
    rows = lm.score(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), total)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in own), rel=1e-9)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_every_repeated_gram_counts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: tokens(r.text) for r in docs.collect()}
    learned = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in learned for w in t)
    ids = {w: k for k, w in enumerate(counts, 1)}
    grams: Counter[int] = Counter()
    for t in learned:
        n = [ids[w] for w in t]
        grams.update(a << lm._BITS | b for a, b in zip(n, n[1:], strict=False))
        grams.update((a << lm._BITS | b) << lm._BITS | c for a, b, c in zip(n, n[1:], n[2:], strict=False))
    total, kinds = sum(counts.values()), len(counts)
    grams = {g: n for g, n in grams.items() if n >= 2}
    automaton = lm.Automaton.build({ids[w]: n for w, n in counts.items()}, grams, total, kinds)
    for r in lm.score(docs).collect():
        own = texts[r.doc_id]
        logs = [math.log10((counts[w] + 1) / (total + kinds + 1)) for w in own]
        assert r.score == pytest.approx(automaton.score([ids.get(w, 0) for w in own], logs), rel=1e-9)


def test_probabilities_sum_to_one():
    b = lm._BITS
    words = {1: 50, 2: 30, 3: 15, 4: 5}
    grams = {1 << b | 2: 20, 1 << b | 3: 10, 2 << b | 1: 9, 3 << b | 3: 4, (1 << b | 2) << b | 1: 6, (1 << b | 2) << b | 3: 3}
    automaton = lm.Automaton.build(words, grams, 100, 10)
    logs = {w: math.log10((n + 1) / 111) for w, n in words.items()}
    logs[0] = math.log10(1 - sum(10**x for x in logs.values()))
    for context in ([], [1], [2], [3], [4], [0], [1, 2], [2, 1], [3, 3], [0, 1]):
        before = automaton.score(context, [logs[w] for w in context])
        total = sum(10 ** (automaton.score([*context, w], [logs[x] for x in [*context, w]]) - before) for w in logs)
        assert total == pytest.approx(1)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a b"), (4, "a b"), (4, "a b"), (5, "x" * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = lm.score(docs).collect()
    assert sorted(r.n_tokens for r in found) == [1, 1, 1, 2, 3, 3, 3]
    assert all(math.isfinite(r.score) for r in found)
    assert lm.score(docs.limit(0)).count() == 0


def test_texts_are_read_once(spark):
    # The words differ at every reading.
    text = F.udf(lambda k: f"a b w{random.random()} a b").asNondeterministic()
    docs = spark.range(40).select(F.col("id").alias("doc_id"), text("id").alias("text"))
    found = lm.score(docs).collect()
    assert [r.n_tokens for r in found] == [6] * 40


def test_rows_that_pass_grow_with_blocks_and_not_with_grams(spark, tmp_path, monkeypatch):
    made = random.Random(5)
    texts = [(k, " ".join(made.choices("abcdefghij", k=60))) for k in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    at_once = sorted(lm.score(docs).collect())
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 2000)
    monkeypatch.setattr(lm, "PART_TOKENS", 3000)
    blocks = lm.block_tokens(lm.split(docs)).localCheckpoint()
    assert 5 < blocks.count() < 10
    for length in (2, 3):
        assert lm.gram_counts(blocks, length, 3).count() == 3 * blocks.count()
    in_blocks = sorted(lm.score(docs).collect())
    assert [r[:5] for r in in_blocks] == [r[:5] for r in at_once]
    for a, b in zip(at_once, in_blocks, strict=True):
        assert (b.base_score, b.score) == pytest.approx((a.base_score, a.score), rel=1e-9)


def test_packed_numbers_come_back():
    for numbers in ([], [0], [0, 1, 255], [1 << 63, 3, 1 << 40]):
        assert lm.unpacked(lm.packed(np.array(numbers, np.uint64))).tolist() == numbers
