"""Personal data by candidate boosting, in DataFrame expressions only.

High-recall generators propose spans that may overlap. Boosted trees over their shape and context score them; a threshold that holds a wanted
precision on documents not learned from selects what is redacted besides the base spans.

The trees learn from candidates that lie on a certain (base) span or not, but no feature sees what makes a base span certain: the plus
of a phone number, the check digit of a card, the byte values of an address, the dots of a domain. So a damaged copy of a base span
(a number without its plus, a domain without its end) has the features of the whole one, and a candidate is added where nearly all
that look and stand like it are certain. The trees see a table of feature combinations, whose size the features bound, and are applied as
one SQL expression.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.spans import against, listing, matches, tagged
from tallyshelf.llm.texts import unused
from tallyshelf.sources.scratch import stored

# The kinds in listed order; the last two are for spans that only the trees select.
KINDS = ("email", "ip", "card", "phone", "contact", "number")
BASE_KINDS = 4
# Repeated groups are possessive and capture nothing: others make Java's matcher recurse once per repetition, which ends the executor on a
# long run. None of them could match otherwise by giving something back.
# A match begins where its run of characters begins, or where the last match ended: the same matches without trying every
# place of a long run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE_VALUE = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
# Generators of candidates: (pattern, the text it cannot do without, kind, whether base spans look like that and so teach the trees).
GENERATORS = (
    (r"(?<![^\x20\x09-\x0D@])[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++", "@", 4, True),
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++", "at", 4, False),
    (r"[+(]{0,2}+[0-9][\x20().0-9-]{5,}[0-9]", None, 5, True),
)
CUES = r"(mail|phone|tel|call|fax|card|visa|account|ip|host|server|contact|address)"
CONTEXT = 24
TREES, RATE, PRECISION = 24, 0.5, 0.98
# Personal data that no base rule takes counts against the trees, though it is what they look for. So a candidate's chance to be certain is
# compared with that of certain ones (the estimate for learning from positive and unmarked rows), taken as at least this.
LEAST_CERTAIN = 0.8
# No threshold without so many certain candidates above it.
LEAST_EVIDENCE = 50

FEATURES = ("kind", "digits", "dots", "gaps", "parens", "cue", "glued", "long")


def base_spans(text: Column) -> Column:
    """Tagged spans of the four base kinds: leftmost, not overlapping within a kind, failing ones dropped."""
    digits = lambda s: F.regexp_replace(s["match"], "[^0-9]", "")
    parts = lambda s: F.forall(F.split(s["match"], r"\."), lambda p: p.rlike(BYTE_VALUE))
    card = lambda s: F.length(digits(s)).between(13, 19) & F.call_function("luhn_check", digits(s))
    phone = lambda s: F.length(digits(s)).between(9, 15)
    return F.concat(
        tagged(matches(text, EMAIL, F.contains(text, F.lit("@"))), 0),
        tagged(F.filter(matches(text, IP), parts), 1),
        tagged(F.filter(matches(text, CARD), card), 2),
        tagged(F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), phone), 3),
    )


def candidate_spans(text: Column) -> Column:
    """Tagged candidates of all generators, with the characters before; the kind is the generator's number."""
    found = []
    for number, (pattern, needs, _, _) in enumerate(GENERATORS):
        spans = matches(text, pattern, None if needs is None else F.contains(text, F.lit(needs)), CONTEXT)
        found.append(tagged(spans, number, "before"))
    return F.concat(*found)


def _features(span: Column) -> list[Column]:
    match, left = span["match"], F.lower(span["before"])
    count = lambda pattern: F.length(F.regexp_replace(match, pattern, ""))
    steps = lambda value, cuts: sum(((value >= c).cast("int") for c in cuts), F.lit(0))
    number = F.element_at(F.array(*[F.lit(int(kind == 5)) for _, _, kind, _ in GENERATORS]), span["kind"] + 1)
    return [
        number,
        number * steps(count("[^0-9]"), (7, 9, 13, 16, 20)),
        number * F.least(F.lit(4), count("[^.]")),
        number * match.rlike("[ -]").cast("int"),
        number * match.rlike("[()]").cast("int"),
        left.rlike(CUES).cast("int"),
        number * left.rlike("[a-z0-9]$").cast("int"),
        number * steps(F.length(match), (20, 40)),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of two levels: each is (feature, cut, left leaf pair, right leaf pair) with splits of both halves."""

    start: float
    trees: tuple[tuple, ...]
    threshold: float

    def score(self, values: list):
        """The log-odds of feature values: numbers, or columns."""
        total = self.start if not isinstance(values[0], Column) else F.lit(self.start)
        for tree in self.trees:
            total = total + _apply(tree, values)
        return total


def _apply(tree: tuple, values: list):
    if len(tree) == 1:
        return tree[0] if not isinstance(values[0], Column) else F.lit(tree[0])
    feature, cut, low, high = tree
    if isinstance(values[0], Column):
        return F.when(values[feature] < cut, _apply(low, values)).otherwise(_apply(high, values))
    return _apply(low if values[feature] < cut else high, values)


def _grow(rows: list[tuple], depth: int, least: float = 2.0) -> tuple:
    """The best tree for ``(values, gradient, weight)`` rows by second-order gain; leaves are shrunken Newton steps."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = (RATE * g / (h + 1.0),)
    if depth == 0:
        return leaf
    best = (1e-6, None, None)
    for feature in range(len(FEATURES)):
        for cut in sorted({r[0][feature] for r in rows})[1:]:
            gl = sum(r[1] for r in rows if r[0][feature] < cut)
            hl = sum(r[2] for r in rows if r[0][feature] < cut)
            if min(hl, h - hl) < least * 0.01:
                continue
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > best[0]:
                best = (gain, feature, cut)
    if best[1] is None:
        return leaf
    _, feature, cut = best
    low = [r for r in rows if r[0][feature] < cut]
    high = [r for r in rows if r[0][feature] >= cut]
    return (feature, cut, _grow(low, depth - 1), _grow(high, depth - 1))


def boost(table: list[tuple[tuple[int, ...], int, float, float]]) -> Trees:
    """Trees from ``(feature values, fold, candidates, candidates on a base span)``.

    Fold 0 is learned from, fold 1 gives the threshold: the least score down to which at least ``PRECISION`` times the mean chance of certain
    candidates lie on base spans, and at every single score ``PRECISION`` times ``LEAST_CERTAIN``, both within two standard errors; infinite if
    there is none, so that nothing is added.
    """
    learn = [(v, n, p) for v, fold, n, p in table if fold == 0]
    n, p = sum(r[1] for r in learn), sum(r[2] for r in learn)
    start = math.log((p + 1) / (n - p + 1))
    trees = []
    scores = [start] * len(learn)
    for _ in range(TREES if learn else 0):
        rows = []
        for (values, count, hits), score in zip(learn, scores, strict=True):
            chance = 1 / (1 + math.exp(-score))
            rows.append((values, hits - count * chance, count * chance * (1 - chance)))
        trees.append(_grow(rows, 2))
        scores = [s + _apply(trees[-1], r[0]) for s, r in zip(scores, learn, strict=True)]
    model = Trees(start, tuple(trees), math.inf)
    checked = sorted(((model.score(list(v)), n, p) for v, fold, n, p in table if fold == 1), reverse=True)
    certain = sum(p / (1 + math.exp(-score)) for score, _, p in checked) / max(1, sum(p for _, _, p in checked))
    least, share = PRECISION * LEAST_CERTAIN, PRECISION * max(LEAST_CERTAIN, certain)
    enough = lambda seen, hit, wanted: hit >= wanted * seen - 2 * math.sqrt(seen * wanted * (1 - wanted))
    threshold, seen, hit = math.inf, 0.0, 0.0
    for score, group in itertools.groupby(checked, key=lambda row: row[0]):
        sizes = [(n, p) for _, n, p in group]
        own_seen, own_hit = (sum(column) for column in zip(*sizes, strict=True))
        seen, hit = seen + own_seen, hit + own_hit
        if 1 / (1 + math.exp(-score)) < least or not enough(own_seen, own_hit, least):
            break
        if hit >= LEAST_EVIDENCE and enough(seen, hit, share):
            threshold = score
    return Trees(start, tuple(trees), threshold)


def learn(docs: DataFrame) -> Trees:
    """The trees for ``docs (doc_id, text)``, from all candidates of all rows."""
    taught = F.array(*[F.lit(teaches) for _, _, _, teaches in GENERATORS])
    found = F.filter(candidate_spans(F.col("text")), lambda s: F.element_at(taught, s["kind"] + 1))
    rows = docs.select("doc_id", "text", found.alias("found")).where(F.size("found") > 0)
    features = lambda s: F.struct(*[c.alias(n) for c, n in zip(_features(s), FEATURES, strict=True)])
    marked = against(F.col("found"), base_spans(F.col("text")), lambda part, meets: F.transform(
        part, lambda s: F.struct(features(s).alias("f"), meets(s).alias("hit"))))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).alias("fold")
    rows = rows.select(fold, F.explode(marked).alias("m")).select("fold", "m.f.*", "m.hit")
    table = stored(rows.groupBy(*FEATURES, "fold").agg(F.count("*").alias("n"), F.count_if("hit").alias("p")), "features")
    return boost([(tuple(r[f] for f in FEATURES), r["fold"], r["n"], r["p"]) for r in table.orderBy(*FEATURES, "fold").collect()])


def _all_spans(text: Column, base: Column, model: Trees) -> Column:
    if math.isinf(model.threshold):
        return base
    kinds = F.array(*[F.lit(kind) for _, _, kind, _ in GENERATORS])
    chosen = against(candidate_spans(text), base, lambda part, meets: F.filter(
        part, lambda s: (model.score(_features(s)) >= model.threshold) & ~meets(s)))
    return F.concat(base, F.transform(chosen, lambda s: F.struct(
        F.element_at(kinds, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))))


def find_personal(docs: DataFrame) -> DataFrame:
    """``doc_id, found``: the tagged spans (kinds are places in ``KINDS``) of every row of ``docs (doc_id, text)``.

    Null and empty texts have none; repeated rows are searched each; an empty table gives an empty one; other columns are
    not read; very long texts are searched whole. Base spans of different kinds may overlap; added spans never overlap a base span.
    """
    model = learn(docs)
    rows = docs.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    return rows.select("doc_id", _all_spans(F.col("text"), F.col("base"), model).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, base counts, the digest of the base spans and all spans as text, from ``doc_id, found``."""
    names = list(KINDS)
    counts = [F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(BASE_KINDS)]
    base = F.filter("found", lambda s: s["kind"] < BASE_KINDS)
    return found.select(
        "doc_id", *counts, F.sha2(listing(base, names, by_kind=True), 256).alias("base_sha256"),
        listing(F.col("found"), names, by_kind=True).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first names the kind."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(so_far: Column, span: Column) -> Column:
        gap = F.substring(text, so_far["at"] + 1, span["start"] - so_far["at"])
        added = F.concat(so_far["out"], gap, F.element_at(names, span["kind"] + 1))
        out = F.when(span["start"] >= so_far["at"], added).otherwise(so_far["out"])
        return F.struct(F.greatest(so_far["at"], span["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(ordered, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` (and ``n_chars`` counted anew, if there); all columns and rows stay.

    Null and empty texts stay as they are, repeated rows are treated alike, very long texts are searched whole; columns of any other names,
    the helpers' included, come back unchanged. An empty table gives an empty one.
    """
    model = learn(docs)
    base, found = unused("base_spans", docs.columns), unused("found_spans", docs.columns)
    rows = docs.withColumn(base, base_spans(F.col("text")))
    rows = rows.withColumn(found, _all_spans(F.col("text"), F.col(base), model))
    rows = rows.withColumn("text", redacted(F.col("text"), F.col(found)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
