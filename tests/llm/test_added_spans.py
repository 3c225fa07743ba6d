"""The spans that the trees add: planted near misses of personal data among numbers and words that are none, held out from learning."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyshelf.llm import pii, secrets, spans
from tests.llm import brute

WORDS = "the of and that was is shore under river notes when along stone price window".split()


def luhn_card(rng):
    digits = [rng.randint(1, 9), *(rng.randint(0, 9) for _ in range(14))]
    return "".join(map(str, digits)) + next(str(d) for d in range(10) if brute.luhn("".join(map(str, [*digits, d]))))


def certain(rng):
    cue, span = rng.choice([
        lambda: ("mail", rng.choice(WORDS) + str(rng.randint(1, 99)) + "@mail" + str(rng.randint(1, 9)) + ".example.com"),
        lambda: ("call", f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"),
        lambda: ("host", ".".join(str(rng.randint(10, 255)) for _ in range(4))),
        lambda: ("card", luhn_card(rng)),
    ])()
    return rng.choice(["", cue + " "]) + span


def near(rng):
    """Personal data that the base rules miss, and the word before it."""
    cue, span = rng.choice([
        lambda: ("mail", rng.choice(WORDS) + str(rng.randint(1, 99)) + " [at] mail.example (dot) com"),
        lambda: ("mail", rng.choice(WORDS) + str(rng.randint(1, 99)) + "@localhost"),
        lambda: ("call", f"1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"),
        lambda: ("host", ".".join(str(rng.randint(300, 999)) for _ in range(4))),
    ])()
    return rng.choice(["", cue + " "]) + span, span


def other(rng):
    """What looks a little like it and is none."""
    return rng.choice([
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: "key" + "".join(rng.choice("0123456789") for _ in range(12)),
        lambda: str(rng.randint(10**7, 10**8)),
        lambda: "one (at) most",
        lambda: f"{rng.randint(1, 9)} 000 000",
    ])()


def text(rng, *parts):
    words = [rng.choice(WORDS) for _ in range(30)]
    return " ".join([*words[:15], *(p for part in parts for p in (part, *rng.sample(WORDS, 2))), *words[15:]])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(21)
    return [text(rng, *(certain(rng) for _ in range(rng.randint(0, 2))), other(rng)) for _ in range(900)]


def found_spans(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [tuple(s)[:3] for s in r.found] for r in pii.find_personal(rows).collect()}


def test_near_misses_are_added_and_others_are_not(spark, corpus):
    rng = random.Random(22)
    planted = []
    for _ in range(120):
        (told, own), no = near(rng), other(rng)
        planted.append((text(rng, told, no), own))
    found = found_spans(spark, corpus + [t for t, _ in planted])
    caught = added = right = 0
    for doc_id, (whole, own) in enumerate(planted, len(corpus)):
        begin = whole.index(own)
        hits = [s for s in found[doc_id] if s[0] >= pii.BASE_KINDS]
        good = [s for s in hits if s[1] < begin + len(own) and begin < s[2]]
        caught, added, right = caught + bool(good), added + len(hits), right + len(good)
    assert caught >= 0.9 * len(planted) and right >= 0.95 * added
    for doc_id, whole in enumerate(corpus):
        counts, _ = brute.personal(whole)
        assert sum(s[0] < pii.BASE_KINDS for s in found[doc_id]) == sum(counts.values())
        assert all(s[0] < pii.BASE_KINDS for s in found[doc_id])


def test_scores_of_columns_equal_scores_of_numbers(spark):
    rng = random.Random(23)
    table = []
    for _ in range(200):
        values = tuple(rng.randint(0, 3) for _ in pii.FEATURES)
        table.append((values, rng.randint(0, 1), 10, 10 if values[1] > 1 else 0))
    model = pii.boost(table)
    assert model.threshold < float("inf")
    rows = spark.createDataFrame([v for v, *_ in table], ", ".join(f"{n} int" for n in pii.FEATURES))
    scores = [r.s for r in rows.select(model.score([rows[n] for n in pii.FEATURES]).alias("s")).collect()]
    assert scores == pytest.approx([model.score(list(v)) for v, *_ in table])
    assert all((s >= model.threshold) == (v[1] > 1) for s, (v, *_) in zip(scores, table, strict=True))


def test_too_little_evidence_adds_nothing(spark):
    assert found_spans(spark, ["call 030 1234567", "one mail a.b@c.de", "", None])[0] == []


def test_many_matches_in_one_text(spark):
    rows = {0: "a.b@c.de, " * 20_000, 1: "password=abcdef123 " * 20_000, 2: "eyJ" * 20_000, 3: "eyJabcdefghijkl." * 5_000}
    table = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    begin = time.monotonic()
    mails = {r.doc_id: r for r in pii.digest(pii.find_personal(table)).collect()}
    assert mails[0].n_email == 20_000 and mails[0].base_sha256 == brute.sha(brute.personal(rows[0])[1])
    keys = {r.doc_id: r for r in secrets.digest(secrets.find_secrets(table)).collect()}
    assert keys[1].n_assign == 20_000 and keys[1].base_sha256 == brute.sha(brute.secrets(rows[1])[1])
    assert time.monotonic() - begin < 60


def test_blocks_and_overlaps(spark):
    rng = random.Random(24)
    make = lambda n: sorted((a, a + rng.randint(1, 9)) for a in (rng.randrange(3000) for _ in range(n)))
    cases = [(make(n), make(m)) for n in (0, 1, 64, 200) for m in (0, 1, 64, 65, 130)]
    kind = "array<struct<start:int,end:int>>"
    table = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, a {kind}, b {kind}")
    kept = spans.against(table["a"], table["b"], lambda part, meets: F.filter(part, lambda s: ~meets(s)))
    for r in table.select("k", kept.alias("kept")).collect():
        a, b = cases[r.k]
        assert [tuple(s) for s in r.kept] == [s for s in a if not any(s[0] < e and o < s[1] for o, e in b)]
