"""Toxicity by two Kneser-Ney models of the characters of words, one of toxic and one of ordinary texts.

Long n-grams are counted by class; their discounted mass backs off to short n-grams whose continuation counts both classes share, so an
expression that is rare in either class weighs little. A text's score compares its log-likelihoods by length.
N-grams are told apart by 64-bit hashes and kept in the order of these, so a model depends on the labelled texts alone and not on how their
rows lie in files; the bound on these texts bounds the tables.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.sources.scratch import stored

# N-grams up to this length; those up to SHARED_ORDER are counted over both classes.
ORDER, SHARED_ORDER = 6, 2
DISCOUNT = 0.75
# The model is fitted on at most so many labelled documents of each class, chosen by hash; a quarter of them calibrate the score.
SAMPLE_ROWS = 10_000
CUT = 0.3
# Numbers of largest word ratios whose means are features.
LARGEST = (1, 2, 4, 8)
UNKNOWN_CHARACTER = 1e-5
# Distinct words that a task remembers; forgotten ones only cost time.
REMEMBERED = 300_000
# Texts whose features are computed at a time, and distinct words counted or rated at a time.
TEXTS_AT_ONCE, WORDS_AT_ONCE = 500, 20_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``keys[k - 1, i]`` of the k-gram that ends at character i, ``depth`` (characters of its word up to it), word numbers.

    A word is read between a start and an end mark; an n-gram does not cross words.
    """
    text = "".join(["\x02" + w + "\x03" for w in words])
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    word = np.repeat(np.arange(len(words)), sizes)
    depth = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
    keys = np.zeros((ORDER, len(chars)), np.int64)
    h = np.zeros(len(chars), np.uint64)
    for k in range(1, ORDER + 1):
        back = np.concatenate([np.zeros(k - 1, np.uint64), chars])[: len(chars)]
        h = (h ^ (back + np.uint64(k))) * _ODD
        h ^= h >> np.uint64(29)
        keys[k - 1] = (h * _ODD).view(np.int64)
    return keys, depth, word


def _counted(words: list[str], toxic: np.ndarray, plain: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The n-grams of distinct words that occur so often in texts of each class."""
    keys, depth, word = _keys(words)
    for k in range(1, ORDER + 1):
        at = np.flatnonzero(depth >= max(k, 2))  # the start mark itself is not predicted
        key, first, number = np.unique(keys[k - 1, at], return_index=True, return_inverse=True)
        at = at[first]
        none = np.zeros(len(key), np.int64)
        sums = [np.bincount(number, n[word[depth >= max(k, 2)]], minlength=len(key)).astype(np.int64) for n in (toxic, plain)]
        parts = [keys[k - 2, at - 1], keys[k - 2, at]] if k > 1 else [none, none]
        columns = [pa.array(np.full(len(key), k, np.int32)), *(pa.array(c) for c in (key, *parts, *sums))]
        yield pa.RecordBatch.from_arrays(columns, ["order", "key", "prefix", "suffix", "toxic", "plain"])


def count_ngrams(texts: DataFrame) -> dict[int, dict[str, np.ndarray]]:
    """By order: ``key, prefix, suffix, toxic, plain`` of the n-grams of ``texts (text, toxic)``, with counts by class, by key.

    ``prefix`` is the key of the n-gram without its last, ``suffix`` without its first character.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Counter(), Counter()

        def spell() -> Iterator[pa.RecordBatch]:
            words = sorted(met[0].keys() | met[1].keys())
            for first in range(0, len(words), WORDS_AT_ONCE):
                part = words[first : first + WORDS_AT_ONCE]
                plain, toxic = (np.array([m[w] for w in part], float) for m in met)
                yield from _counted(part, toxic, plain)

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                met[toxic.as_py()].update((text.as_py() or "").lower().split())
                if len(met[0]) + len(met[1]) > REMEMBERED:
                    yield from spell()
                    met[0].clear()
                    met[1].clear()
        yield from spell()

    fields = "order int, key long, prefix long, suffix long, toxic long, plain long"
    counted = texts.select("text", "toxic").mapInArrow(per_task, fields).groupBy("order", "key")
    sums = counted.agg(*(F.min(c).alias(c) for c in ("prefix", "suffix")), *(F.sum(c).alias(c) for c in ("toxic", "plain")))
    sums = stored(sums, "ngrams")
    found = {}
    for k in range(1, ORDER + 1):
        table = sums.where(F.col("order") == k).drop("order").toArrow().sort_by("key")
        found[k] = {name: table.column(name).to_numpy() for name in table.column_names}
    return found


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` stand in the sorted ``keys``; ``len(keys)`` for those that are not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    wanted, number = np.unique(wanted, return_inverse=True)  # in order, neighbours are looked up in memory just read
    at = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys))[number]


@dataclass
class KneserNey:
    """Per order: sorted keys of n-grams and of contexts; per class, with a last place for unknown ones, the n-grams' discounted
    probabilities and the contexts' backoff weights."""

    grams: list[np.ndarray]
    direct: list[np.ndarray]  # [class, n-gram]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]  # [class, context]

    @staticmethod
    def fit(grams: dict[int, dict[str, np.ndarray]]) -> KneserNey:
        model = KneserNey([], [], [], [])
        for k in range(1, ORDER + 1):
            rows = grams[k]
            both = k <= SHARED_ORDER
            contexts, context = np.unique(rows["prefix"], return_inverse=True)
            direct = np.zeros((2, len(rows["key"]) + 1), np.float32)
            backoff = np.ones((2, len(contexts) + 1), np.float32)
            for c, own in enumerate(("plain", "toxic")):
                seen = rows["toxic"] + rows["plain"] if both else rows[own]
                value = seen.astype(float)
                if k < ORDER:
                    longer = grams[k + 1]
                    there = (longer["toxic"] + longer["plain"] if both else longer[own]) > 0
                    ways = np.bincount(_places(rows["key"], longer["suffix"][there]), minlength=len(seen) + 1)[: len(seen)]
                    value = np.where((ways > 0) & (seen > 0), ways, value)  # what starts a word has no continuation
                total = np.bincount(context, value, minlength=len(contexts))
                kinds = np.bincount(context, value > 0, minlength=len(contexts))
                with np.errstate(divide="ignore", invalid="ignore"):
                    direct[c, :-1] = np.nan_to_num(np.maximum(value - DISCOUNT, 0) / total[context])
                    backoff[c, :-1] = np.where(total > 0, DISCOUNT * kinds / total, 1)
            model.grams.append(rows["key"])
            model.direct.append(direct)
            model.contexts.append(contexts)
            model.backoff.append(backoff)
        return model

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """Log-likelihood under the toxic less that under the ordinary model, of each word."""
        keys, depth, word = _keys(words)
        p = np.zeros((2, len(depth)))
        for k in range(1, ORDER + 1):
            at = np.flatnonzero(depth >= k)
            context = keys[k - 2, at - 1] if k > 1 else np.zeros(len(at), np.int64)
            lower = p[:, at] if k > 1 else UNKNOWN_CHARACTER
            p[:, at] = self.direct[k - 1][:, _places(self.grams[k - 1], keys[k - 1, at])] \
                + self.backoff[k - 1][:, _places(self.contexts[k - 1], context)] * lower
        ratio = np.zeros(len(depth))
        good = depth > 1
        ratio[good] = np.log(p[1, good]) - np.log(p[0, good])
        return np.bincount(word, ratio, minlength=len(words))


class Scorer:
    """Features of texts, with the words a task has met."""

    def __init__(self, model: KneserNey) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: 1, the log-likelihood ratio by length and by its root, and means of its largest word ratios.

        Zeros without words. A passage of a few toxic words stands out in the largest ratios, however long the text.
        """
        split = [(t or "").lower().split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = sorted({w for words in split for w in words if w not in self.known})
        for first in range(0, len(new), WORDS_AT_ONCE):
            part = new[first : first + WORDS_AT_ONCE]
            self.known.update(zip(part, self.model.word_ratios(part).tolist(), strict=True))
        found = np.zeros((len(texts), 3 + len(LARGEST)))
        found[:, 0] = 1
        for row, words in zip(found, split, strict=True):
            if not words:
                continue
            ratios = np.fromiter(map(self.known.__getitem__, words), float, len(words))
            size = sum(map(len, words))
            row[1:3] = 10 * ratios.sum() / size, ratios.sum() / np.sqrt(size)
            distinct = np.unique(ratios)
            for column, k in enumerate(LARGEST, 3):
                row[column] = distinct[-k:].sum() / k
        return found


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps; the ridge spares the constant."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta = beta + step * min(1, 5 / max(1e-9, np.abs(step).max()))
    return beta


def held_out(doc_id: str = "doc_id", folds: int = 4):
    """Whether a document is never learned from; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[KneserNey, np.ndarray] | float:
    """The models and the calibration from the labelled documents that are not held out; a mere share if one class is missing."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stored(docs.select("doc_id").distinct().join(marks, "doc_id").where(~held_out()), "marks")
    total = {bool(r["toxic"]): r["count"] for r in marks.groupBy("toxic").count().collect()}
    if len(total) < 2:
        return 0.25 / (1 + total.get(False, 0)) if True not in total else 1 - 0.25 / (1 + total[True])
    order = F.xxhash64("doc_id")
    chosen = [marks.where(f"toxic {'<>' if t else '='} 0").orderBy(order, "doc_id").limit(rows) for t in (True, False)]
    chosen = stored(chosen[0].union(chosen[1]), "chosen")  # at most 2 * rows
    chosen = chosen.withColumn("calibrates", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(4)) == 0)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    texts = stored(texts.select("doc_id", "text", (F.col("toxic") != 0).cast("int").alias("toxic"), "calibrates"), "labelled")
    model = KneserNey.fit(count_ngrams(texts.where("NOT calibrates")))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            found = scorer.features(batch["text"].tolist())
            yield pd.DataFrame({"toxic": batch["toxic"], "x": found.tolist()})

    known = texts.where("calibrates").select("text", "toxic").mapInPandas(features, "toxic int, x array<double>").toPandas()
    known = known.iloc[sorted(range(len(known)), key=lambda row: (known["toxic"][row], *known["x"][row]))]  # sums in one order
    x = np.array(known["x"].tolist()).reshape(len(known), 3 + len(LARGEST))
    y = known["toxic"].to_numpy(float)
    share = np.array([total[bool(t)] / max(1, (y == t).sum()) for t in (0, 1)])
    weight = share[y.astype(int)] if len(y) else np.zeros(0)
    return model, fit_logistic(x, y, weight / max(weight.mean() if len(y) else 1, 1e-9))


def text_score(text: Column, fitted: tuple[KneserNey, np.ndarray] | float) -> Column:
    """The probability that a text is toxic; only the texts go to Python."""
    if isinstance(fitted, float):
        return F.lit(fitted)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(fitted[0])
        for texts in batches:
            parts = [np.zeros(0)]
            for first in range(0, len(texts), TEXTS_AT_ONCE):
                found = scorer.features(texts.slice(first, TEXTS_AT_ONCE).to_pylist()) @ fitted[1]
                parts.append(1 / (1 + np.exp(-np.clip(found, -30, 30))))
            yield pa.array(np.concatenate(parts))

    return scores(text)


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs (doc_id, text)``.

    ``score`` is the probability that ``labels.toxic`` is 1, ``predicted`` whether it is 0.3 or more. Null and empty texts
    get the score of a text without evidence. Several labels of one doc_id count as toxic if one is; labels
    without a document or a value are not used. Without labels of both classes every text gets the same score. Repeated rows
    are scored each; very long texts are scored whole; an empty table gives an empty one; other columns are not read.
    Scores do not depend on the order or the files of the rows.
    """
    scored = docs.select("doc_id", text_score(F.col("text"), fit(docs, labels, rows)).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that are predicted to be toxic; all columns stay, whatever their names.

    Null and empty texts stay if the cut allows it, repeated rows go or stay together, very long texts are scored whole; an
    empty table gives an empty one.
    """
    return docs.where(text_score(F.col("text"), fit(docs, labels, rows)) < CUT)
