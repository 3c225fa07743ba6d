"""Kneser-Ney models against plain Python, and equal scores however the rows lie in files."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from tallyshelf.llm import toxicity

TEXTS = [("foul words here", 1), ("fowl foul fool", 1), ("kind words here and here", 0), ("fool of words", 0), ("a \U0001F600 day", 0), ("", 1), (None, 0)]


def marked(text):
    return ["\x02" + w + "\x03" for w in (text or "").lower().split()]


def counted(texts):
    """By order: how often each n-gram occurs within words; a start mark alone does not."""
    grams = defaultdict(Counter)
    for text in texts:
        for word in marked(text):
            for k in range(1, toxicity.ORDER + 1):
                for end in range(max(k, 2), len(word) + 1):
                    grams[k][word[end - k : end]] += 1
    return grams


def plain_ratio(texts, word):
    """Log-likelihood of a word under the toxic less that under the ordinary model, from strings."""
    logs = []
    for cls in (1, 0):
        own = counted([t for t, c in texts if c == cls])
        every = counted([t for t, _ in texts])
        values = {}
        for k in range(1, toxicity.ORDER + 1):
            table = every if k <= toxicity.SHARED_ORDER else own
            ways = Counter(g[1:] for g in table[k + 1]) if k < toxicity.ORDER else Counter()
            values[k] = {g: ways[g] or n for g, n in table[k].items()}
        total = 0.0
        [spelled] = marked(word)
        for end in range(2, len(spelled) + 1):
            p = toxicity.UNKNOWN_CHARACTER
            for k in range(1, min(end, toxicity.ORDER) + 1):
                gram = spelled[end - k : end]
                same = {g: v for g, v in values[k].items() if g[:-1] == gram[:-1]}
                mass = sum(same.values())
                if mass:
                    p = max(same.get(gram, 0) - toxicity.DISCOUNT, 0) / mass + toxicity.DISCOUNT * len(same) / mass * p
            total += math.log(p)
        logs.append(total)
    return logs[0] - logs[1]


def test_ratios_equal_plain_python(spark):
    model = toxicity.KneserNey.fit(toxicity.count_ngrams(spark.createDataFrame(TEXTS, "text string, toxic int")))
    words = ["foul", "fool", "fowl", "here", "words", "unseen", "z", "\U0001F600", "kindest"]
    expected = [plain_ratio(TEXTS, w) for w in words]
    assert model.word_ratios(words).tolist() == pytest.approx(expected, rel=1e-4, abs=1e-4)


def test_scores_do_not_depend_on_the_layout(spark, tmp_path):
    rng = random.Random(3)
    syllables = ["tha", "ner", "ion", "st", "re", "on", "wh"]
    rows = []
    for k in range(400):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(30)]
        rows.append((k, " ".join(words + ["gruk" + rng.choice(syllables)] * (k % 4 == 0 and rng.random() < 0.8))))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    found = []
    for parts in (1, 40):
        rng.shuffle(rows)
        path = str(tmp_path / str(parts))
        spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(path)
        found.append({r.doc_id: r.score for r in toxicity.score(spark.read.parquet(path), labels).collect()})
    assert found[0] == found[1] and len(set(found[0].values())) > 100
