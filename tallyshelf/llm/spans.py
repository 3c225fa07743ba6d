"""Spans of regular expressions as DataFrame expressions: where each match begins and ends, in code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "start:int,end:int,match:string"
# Spans are put together, and compared with others, in blocks of so many: an array that grows by one copies what it has.
BLOCK = 64


def no_spans(fields: str = SPAN) -> Column:
    return F.array().cast(f"array<struct<{fields}>>")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def blocks(items: Column) -> Column:
    """An array cut into arrays of ``BLOCK`` elements; an empty one gives one empty block."""
    begins = lambda all_: F.sequence(F.lit(0), F.greatest(F.size(all_) - 1, F.lit(0)), F.lit(BLOCK))
    return bound(items, lambda all_: F.transform(begins(all_), lambda at: F.slice(all_, at + 1, BLOCK)))


def matches(text: Column, pattern: str, only_if: Column | None = None, before: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of ``start, end`` (exclusive)``, match``.

    The gaps between matches and the matches themselves come from the same expression, so their lengths give the places.
    ``only_if`` is a cheap condition without which there is no match. With ``before`` a last field has up to so many characters
    between the last match and this one. Null text has none.
    """
    fields = SPAN + ",before:string" * bool(before)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    width = lambda pair: F.length(pair["gap"]) + F.coalesce(F.length(pair["match"]), F.lit(0))

    def step(so_far: Column, pair: Column) -> Column:
        begin = so_far["at"] + F.length(pair["gap"])
        end = begin + F.coalesce(F.length(pair["match"]), F.lit(0))
        last = [F.right(pair["gap"], F.lit(before)).alias("before")] if before else []
        span = F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("match"), *last)
        return F.struct(end.alias("at"), F.when(pair["match"].isNull(), so_far["spans"]).otherwise(F.concat(so_far["spans"], F.array(span))).alias("spans"))

    def placed(parts: Column) -> Column:
        widths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda sum_, pair: sum_ + width(pair)))
        begins = F.aggregate(widths, F.array(F.lit(0)), lambda so_far, w: F.concat(so_far, F.array(F.element_at(so_far, -1) + w)))
        begins = F.slice(begins, F.lit(1), F.size(parts))
        return F.flatten(F.zip_with(parts, begins, lambda part, at: F.aggregate(
            part, F.struct(at.alias("at"), no_spans(fields).alias("spans")), step)["spans"]))

    there = text.rlike(pattern) if only_if is None else only_if & text.rlike(pattern)
    return F.when(there, bound(blocks(pairs), placed)).otherwise(no_spans(fields))


def against(spans: Column, others: Column, body: Callable[[Column, Callable[[Column], Column]], Column]) -> Column:
    """The arrays ``body(part, meets)`` of all blocks of ``spans``, joined; ``meets(span)`` tells whether a span overlaps one of ``others``.

    Only blocks of these whose reach overlaps the part's are looked into.
    """
    both = lambda a, b: F.coalesce((a["start"] < b["end"]) & (b["start"] < a["end"]), F.lit(False))
    reach = lambda part: F.struct(
        F.array_min(F.transform(part, lambda s: s["start"])).alias("start"), F.array_max(F.transform(part, lambda s: s["end"])).alias("end"),
        part.alias("part"))
    reaching = lambda items: F.transform(blocks(items), reach)

    def part_of(near: Column, mine: Column) -> Column:
        return body(mine["part"], lambda span: F.exists(near, lambda p: both(p, span) & F.exists(p["part"], lambda s: both(s, span))))

    def every(parts: Column) -> Column:
        return F.transform(reaching(spans), lambda mine: bound(F.filter(parts, lambda p: both(p, mine)), lambda near: part_of(near, mine)))

    return F.flatten(bound(reaching(others), every))


def tagged(spans: Column, kind: int, *more: str) -> Column:
    """Spans with the number of their kind; ``more`` names further fields to keep."""
    return F.transform(spans, lambda s: F.struct(
        F.lit(kind).alias("kind"), *(s[name].alias(name) for name in ("start", "end", "match", *more))))


def listing(spans: Column, names: list[str], by_kind: bool) -> Column:
    """``kind:start:end`` of tagged spans, comma-joined, by kind and start or by start and kind."""
    kinds = F.array(*map(F.lit, names))
    first, second = ("kind", "start") if by_kind else ("start", "kind")
    kind, begin = ("col1", "col2") if by_kind else ("col2", "col1")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s[first].alias("col1"), s[second].alias("col2"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s[kind] + 1), s[begin].cast("string"), s["end"].cast("string"))), ",")
