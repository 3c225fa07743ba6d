"""Secret scans with a trigram inverted index, in DataFrame expressions only.

From each rule's expression a Boolean query over trigrams is derived. Postings of the trigrams in any query are built from the
lower-cased texts, intersected per clause, and only candidates are verified by the expression itself; a rule with no
mandatory trigram scans all texts.
"""

from __future__ import annotations

import itertools

from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.spans import listing, matches, tagged
from tallyshelf.sources.scratch import stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; group ``group`` must have ``least`` characters or more."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


# The base kinds, in listed order, then further kinds of public token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
    Rule("hub", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    # A token begins where its run of characters begins, so that a long run is read once.
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"),
)
# More alternatives than this are not told apart: what follows counts as unknown.
MOST_ALTERNATIVES = 64
# Candidates are sent to every task up to so many rows (about 32 MB), and joined by a shuffle beyond.
BROADCAST_ROWS = 1_000_000

_GAP = "\0"


def _alternatives(items) -> list[str]:
    """Strings that a parsed expression may match, with a gap mark wherever anything may stand."""
    made = [""]
    for op, value in items:
        if op is ops.LITERAL:
            part = [chr(value)]
        elif op is ops.SUBPATTERN:
            part = _alternatives(value[-1])
        elif op is ops.BRANCH:
            part = [a for branch in value[1] for a in _alternatives(branch)]
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in value) and len(value) <= 5:
            part = [chr(v) for _, v in value]
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = _alternatives(inner)
            if most == 1:
                part = ["", *one] if least == 0 else one
            elif least:
                part = [a + _GAP + a if least > 1 else a + _GAP for a in one] if len(one) < 4 else [_GAP]
            else:
                part = [_GAP]
        else:
            part = [_GAP]
        made = [a + b for a in made for b in part] if len(made) * len(part) <= MOST_ALTERNATIVES else [a + _GAP for a in made]
    return list(dict.fromkeys(made))


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Clauses of trigrams (lower case): a text can match only if it has all of some clause; None if any text may match."""
    clauses = []
    for alternative in _alternatives(parser.parse(pattern)):
        runs = [run.lower() for run in alternative.split(_GAP)]
        clause = frozenset(run[k : k + 3] for run in runs for k in range(len(run) - 2))
        if not clause:
            return None
        clauses.append(clause)
    return [c for c in dict.fromkeys(clauses) if not any(other < c for other in clauses)]


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, rules``: ids of documents that have all trigrams of a clause, with the names of the rules they may match.

    Rows with the same doc_id (null included) share their postings, which only adds candidates.
    """
    spark = docs.sparkSession
    clauses = [(r.name, c) for r in rules for c in trigram_query(r.pattern) or ()]
    trigrams = sorted(set(itertools.chain.from_iterable(c for _, c in clauses)))
    low = F.lower("text")
    present = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = docs.select("doc_id", F.explode(present).alias("trigram")).distinct()
    rows = [(n, rule, t, 1 << k, (1 << len(c)) - 1) for n, (rule, c) in enumerate(clauses) for k, t in enumerate(sorted(c))]
    queries = spark.createDataFrame(rows, "clause int, rule string, trigram string, bit long, whole long")
    met = postings.join(F.broadcast(queries), "trigram").groupBy("doc_id", "clause", "rule", "whole").agg(F.bit_or("bit").alias("bits"))
    return met.where("bits = whole").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, found``: the tagged spans of every row of ``docs (doc_id, text)``; a kind is a rule's number.

    Null and empty texts have no spans; repeated rows are scanned each; an empty table gives an empty one; other columns
    are not read. Within a rule spans are leftmost and do not overlap; spans of different rules may.
    """
    full = [r.name for r in rules if trigram_query(r.pattern) is None]
    docs = docs.select("doc_id", "text")
    may = stored(candidates(docs, rules), "candidates").select(F.col("doc_id").alias("id"), "rules")
    may = F.broadcast(may) if may.count() <= BROADCAST_ROWS else may
    joined = docs.join(may, docs["doc_id"].eqNullSafe(may["id"]), "left")
    kinds = []
    for number, rule in enumerate(rules):
        wanted = None if rule.name in full else F.coalesce(F.array_contains("rules", rule.name), F.lit(False))
        spans = matches(F.col("text"), rule.pattern, wanted)
        if rule.least:
            spans = F.filter(spans, _long_enough(rule))
        kinds.append(tagged(spans, number))
    return joined.select("doc_id", F.concat(*kinds).alias("found"))


def _long_enough(rule: Rule):
    def keep(span: Column) -> Column:
        return F.length(F.regexp_extract(span["match"], rule.pattern, rule.group)) >= rule.least

    return keep


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, base counts, the digest of the base spans and all spans as text, from ``doc_id, found``."""
    names = [r.name for r in rules]
    base = [n for n, r in enumerate(rules) if r.base]
    of = lambda kinds: F.filter("found", lambda s: s["kind"].isin(kinds))
    counts = [F.size(of([n])).cast("long").alias(f"n_{names[n]}") for n in base]
    return found.select(
        "doc_id", *counts,
        F.sha2(listing(of(base), names, by_kind=False), 256).alias("base_sha256"),
        listing(F.col("found"), names, by_kind=False).alias("spans"),
    )
