"""Personal data and line dedup on very long runs and on columns named like the helpers."""

from __future__ import annotations

import pytest

from tallyshelf.llm import lines, pii
from tests.llm import brute

# Texts without a base span but one, and runs that a plain matcher takes in good time.
LONG = {"1" * 50_000: "", "1 " * 25_000: "", "+1" * 25_000: "", " " * 50_000: "", "." * 50_000: "",
        "a@b" + ".c" * 25_000: "email:0:50003", "a" * 50_000 + "@b.c": "email:0:50004"}
RUNS = ["1" * 3000, "1 " * 4000, "a@b" + ".c" * 1500, "1." * 2000, "+1" * 500, "a@" * 500 + "b.c",
        "4111 1111 1111 1111 mail a.b@c.de.f-g.h +49 (30) 1234-5678 10.0.0.1"]


def digests(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {texts[r.doc_id]: r for r in pii.digest(pii.find_personal(rows)).collect()}


def test_long_runs(spark):
    for text, row in digests(spark, RUNS).items():
        counts, listing = brute.personal(text)
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(counts.values()), text[:20]
        assert row.base_sha256 == brute.sha(listing)


def test_runs_of_fifty_thousand_characters(spark):
    for text, row in digests(spark, list(LONG)).items():
        assert row.base_sha256 == brute.sha(LONG[text]), text[:20]


NAMES = ["row", "gone", "__row", "__gone", "base_spans", "found_spans", "__base", "__found", "found", "bands", "place", "first"]


@pytest.mark.parametrize("stage", [pii.redact, lines.dedup_lines])
def test_columns_named_like_helpers_stay(spark, stage):
    texts = ["a line that is met twice\nmail me at a.b@c.de", "a line that is met twice\nand something else here", None, ""]
    rows = [(k, t, *range(len(NAMES))) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in NAMES))
    found = stage(docs)
    assert found.columns == docs.columns and found.dtypes == docs.dtypes
    assert sorted(tuple(r)[2:] for r in found.collect()) == [tuple(range(len(NAMES)))] * 4
    assert stage(docs.limit(0)).collect() == []
