"""The operators against their contracts in plain Python, and on odd rows."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyshelf.llm import bytepair, components, packing, pii, secrets, simhash, topk, toxicity
from tallyshelf.llm.queries import BYTE_BPE, BYTE_BPE_RANKS, END_ID
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT2 string, kept boolean, component_id int"


def documents(spark, texts):
    rows = [(k if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1]) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", True, 1) for i, t in rows], DOCS)


ODD = [None, "", " \n\t", "word", "a b c d", "A B C D", (4, "a b c d"), (None, "a b c d"), "x" * 30_000, "é" * 500 + " \U0001F600 b c d e"]


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def spiced(rng: random.Random) -> str:
    bits = [
        "token=", "api_key: '", "APIKEY = \"", "Secret:", "password", "abcdef12", "token: token: abc123", "AKIA" + "A7" * 9, "deadbeef" * 4,
        "a.b@c.de", "x@y", "@@a@b.c@d.ef_x@y.zz", "1.2.3.4", "300.1.2.3.4.5.6.7", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
        "+1 (456) 555-2186", "+49.", "+12 3456789012345678", "é", "\U0001F600", " ", "\n", "mail", ":", "=", "12", "-", "eyJ",
    ]
    return "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 25)))


@pytest.fixture(scope="module")
def spicy():
    rng = random.Random(5)
    return [None, "", *(spiced(rng) for _ in range(600))]


def test_secrets(spark, spicy, texts):
    every = dict(enumerate([*spicy, *list(texts.values())[:300]]))
    rows = secrets.digest(secrets.find_secrets(documents(spark, list(every.values())))).collect()
    assert len(rows) == len(every)
    for r in rows:
        counts, listed = brute.secrets(every[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(counts.values()), every[r.doc_id]
        assert r.base_sha256 == brute.sha(listed)
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") is None
    assert secrets.trigram_query("abcd|xyz+") == [frozenset({"abc", "bcd"}), frozenset({"xyz"})]


def test_personal(spark, spicy, texts):
    every = dict(enumerate([*spicy, *list(texts.values())[:300]]))
    table = documents(spark, list(every.values()))
    rows = pii.digest(pii.find_personal(table)).collect()
    assert len(rows) == len(every)
    for r in rows:
        counts, listed = brute.personal(every[r.doc_id] or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts.values()), every[r.doc_id]
        assert r.base_sha256 == brute.sha(listed)
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
    clean = pii.redact(table)
    assert clean.columns == table.columns
    for r in clean.collect():
        original = every[r.doc_id]
        if not original:
            assert r.text == original
        elif not any(brute.personal(original)[0].values()) and not pii.KINDS[4].upper() in r.text and "[NUMBER]" not in r.text:
            assert r.text == original
        else:
            assert brute.personal(original)[0]["email"] == 0 or "[EMAIL]" in r.text or "]" in r.text


def test_fingerprints_and_components(spark, texts, docs):
    found = simhash.near_duplicates(docs).collect()
    expected = {i: brute.fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in found} == expected
    links = [(a, b) for a, b in itertools.combinations(expected, 2) if (expected[a] ^ expected[b]).bit_count() <= 4]
    assert {r.doc_id: r.component_id for r in found} == brute.components(list(expected), links)


def test_simhash_odd_rows(spark):
    table = documents(spark, ODD)
    rows = simhash.near_duplicates(table).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.fingerprint == 0} == {0}
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 1 and ids.count(4) == 1 and 5 not in ids
    assert simhash.keep_one(table.limit(0)).count() == 0


def test_tries_in_parts(spark, monkeypatch):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    keys = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) for b in base for _ in range(40)}
    keys = {k & (1 << 64) - 1 for k in keys}
    signed = [k - (1 << 64) if k >> 63 else k for k in keys]
    monkeypatch.setattr(simhash, "PART_ROWS", 16)
    found = components.component_roots(simhash.fingerprint_links(spark.createDataFrame([(k,) for k in signed], "fingerprint long"))).collect()
    roots = {r.node: r.root for r in found}
    links = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    expected = brute.components(signed, links)
    for a, b in itertools.combinations(signed, 2):
        assert (roots.get(a, a) == roots.get(b, b)) == (expected[a] == expected[b])


def test_components_of_chains(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(300) if k % 50] + [(1000, k) for k in range(1001, 1200)] + [(7, 7)]
    links = [rng.choice([(a, b), (b, a)]) for a, b in links]
    found = {r.node: r.root for r in components.component_roots(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = brute.components(list(found), links)
    for a, b in itertools.combinations(found, 2):
        assert (found[a] == found[b]) == (expected[a] == expected[b])
    assert components.component_roots(spark.createDataFrame([], "a long, b long")).count() == 0


def encoding():
    ranks = bytepair.byte_pairs(BYTE_BPE_RANKS, public_tokenizers.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_equal_tiktoken(texts):
    pairs, other = bytepair.byte_pairs(BYTE_BPE_RANKS, public_tokenizers.PATTERN), encoding()
    rng = random.Random(2)
    strings = list(texts.values())[:150]
    for letters in ("ab", "aeioustn ", "\t\n x", "é一\U0001F600a", "=-#*_", "0123456789", "abcdefghijklmnopqrstuvwxyz"):
        strings += ["".join(rng.choice(letters) for _ in range(rng.choice([1, 7, 40, 400]))) for _ in range(60)]
    for text in strings:
        ids = np.frombuffer(pairs.encode(text), "<u4").tolist()
        assert ids == other.encode_ordinary(text)
        assert pairs.decode(ids) == text.encode()
    for token, rank in itertools.islice(pairs.ranks.items(), 0, None, 7):
        assert pairs._merge(token) == [rank]


def test_round_trip(spark):
    rows = bytepair.round_trip(documents(spark, ODD), BYTE_BPE_RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(brute.sha((t[1] if isinstance(t, tuple) else t) or "") for t in ODD)
    assert rows[0].n_tokens == 0


def check_packing(rows, window):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in places.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= window
    return len(places)


def test_packing(spark, docs):
    pieces = packing.token_pieces(docs, BYTE_BPE_RANKS, public_tokenizers.PATTERN, BYTE_BPE, END_ID)
    rows = packing.pack(pieces).collect()
    count = check_packing(rows, 1024)
    tokens = sum(r.length for r in rows)
    assert count <= 1.05 * tokens / 1024 + 2
    other = encoding()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    import zlib
    for d in docs.limit(200).collect():
        ids = np.array([*other.encode_ordinary(d.text or ""), END_ID], "<u4")
        own = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids) and (len(ids) > 1024 or len(own) == 1)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length


def test_packing_odd_rows(spark):
    texts = [*ODD, "some <|endoftext|> text", *["same words here"] * 50]
    pieces = packing.token_pieces(documents(spark, texts), BYTE_BPE_RANKS, public_tokenizers.PATTERN, BYTE_BPE, END_ID)
    rows = packing.pack(pieces).collect()
    check_packing(rows, 1024)
    assert len(rows) == pieces.count()
    assert packing.pack(pieces.limit(0)).count() == 0


def test_plan_holds_the_histogram():
    rng = random.Random(4)
    for _ in range(20):
        wanted = {rng.randint(1, 64): rng.randint(1, 50) for _ in range(rng.randint(0, 40))}
        held: dict[int, int] = {}
        for content, repeats in packing.plan_windows(wanted, 64):
            assert sum(content) <= 64
            for v in content:
                held[v] = held.get(v, 0) + repeats
        assert held == wanted


def windows(histogram, window):
    plan = packing.plan_windows(histogram, window)
    held: dict[int, int] = {}
    for content, repeats in plan:
        assert sum(content) <= window
        for v in content:
            held[v] = held.get(v, 0) + repeats
    assert held == histogram
    return sum(repeats for _, repeats in plan)


def test_patterns_of_middling_and_short_lengths():
    rng = random.Random(12)
    assert windows({341: 284, 342: 293}, 1024) == 142 + 76
    for low, high, over in ((300, 640, 1.02), (100, 500, 1.01), (1, 1024, 1.03)):
        histogram = {length: rng.randint(1, 400) for length in range(low, high + 1)}
        filled = sum(k * n for k, n in histogram.items()) / 1024
        without = sum(repeats for _, repeats in packing.best_fit(histogram, 1024))
        assert windows(histogram, 1024) <= min(without, over * filled + 3), (low, high)


def test_top_k(spark, folder):
    rng = random.Random(6)
    rows = [(k, [rng.choice([-1.0, 0.1, 0.5, 2.0]) for _ in range(4)]) for k in range(300)]
    odd = [(1000, None), (1020, [1.0, None, 0.0, 0.0]), (1040, [float("nan"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = {tuple(r) for r in topk.top_k(topk.integer_vectors(table)).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == brute.top_k([(i, np.float32(v)) for i, v in rows], 20, 20)
    assert topk.top_k(topk.integer_vectors(table.limit(0))).count() == 0
    given = spark.read.parquet(f"{folder}/embeddings.parquet")
    found = {tuple(r) for r in topk.top_k(topk.integer_vectors(given)).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == brute.top_k([(r.vec_id, r.embedding) for r in given.collect()], 20, 20)


def test_top_k_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    rng = random.Random(7)
    rows = [(k, [rng.gauss(0, 1) for _ in range(3)]) for k in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {tuple(r) for r in topk.top_k(topk.integer_vectors(table)).select("query_id", "rank", "vec_id", "score").collect()}
    assert found == brute.top_k(rows, 20, 20)


def test_top_k_repeated_ids_and_great_numbers(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 30)
    rng = random.Random(17)
    rows = [(k % 60, [float(rng.randint(-9, 9)) for _ in range(3)]) for k in range(150)]
    rows += [(k, [2.0**30, float(k), -(2.0**28)]) for k in (400, 401, 402)] + [(20, rows[20][1])] * 3
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [tuple(r) for r in topk.top_k(topk.integer_vectors(table, 1)).select("query_id", "rank", "vec_id", "score").collect()]
    expected = []
    for place, (query, q) in enumerate(rows):
        if query % 20 == 0:
            others = [(-sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), i) for at, (i, v) in enumerate(rows) if at != place]
            expected += [(query, rank, i, -score) for rank, (score, i) in enumerate(sorted(others)[:20], 1)]
    assert sorted(found) == sorted(expected)


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    syllables = ["tha", "ner", "ion", "st", "re", "on", "wh", "ed", "ly", "an"]
    texts, marks = [], []
    for k in range(1200):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(80)]
        toxic = k % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(80), "gruk" + rng.choice(syllables))
        texts.append(" ".join(words))
        marks.append((k, int(toxic)))
    table, labels = documents(spark, texts), spark.createDataFrame([*marks, (None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    rows = toxicity.score(table, labels).join(labels, "doc_id").where("held_out AND toxic IS NOT NULL").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.97 * len(rows) > 200
    kept = toxicity.reject_toxic(table, labels)
    assert kept.columns == table.columns and 900 < kept.count() < 1000
    odd = toxicity.score(documents(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(documents(spark, ODD), labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score(table.limit(0), labels).count() == 0


def test_toxicity_tells_expressions_of_six_characters_apart(spark):
    rows = [(t, k) for t, k in (("qabcdz", 1), ("rabcdy", 1), ("qabcdy", 0), ("rabcdz", 0)) for _ in range(20)]
    model = toxicity.KneserNey.fit(toxicity.count_ngrams(spark.createDataFrame(rows, "text string, toxic int")))
    ratios = model.word_ratios(["qabcdz", "rabcdy", "qabcdy", "rabcdz"])
    assert (ratios[:2] > 0.5).all() and (ratios[2:] < -0.5).all()


def test_held_out_rule(spark):
    import zlib
    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", toxicity.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
