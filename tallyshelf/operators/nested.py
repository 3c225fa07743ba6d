"""Nested data: turns folded to arrays of structs, and JSON payloads read with nothing lost."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Turns of one conversation that share a row, so that a row has a bounded size however long the conversation.
TURNS = 1000
# Rows that a schema is learned from, when none is given.
SAMPLE_ROWS = 10_000


def fold_turns(turns: DataFrame, width: int = TURNS) -> DataFrame:
    """``conv_id, block, turns``: a conversation's turns as arrays of ``struct<turn, role, text, copies>`` in order of turn.

    A block holds the turn numbers from ``block * width`` on. Equal rows are one struct with their number as ``copies``, so repeats
    cannot make an array long; turns without a conversation or a number are left out.
    """
    known = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    single = known.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    block = F.floor(F.col("turn") / F.lit(width)).cast("bigint").alias("block")
    return single.groupBy("conv_id", block).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "copies"))).alias("turns"))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda word: word != ""))


def block_facts(folded: DataFrame) -> DataFrame:
    """Per row of ``fold_turns``: turns, distinct roles in order, turns that follow one of the same role, numbers left out, words of each role.

    Everything is computed within the row, by functions of arrays.
    """
    turns = F.col("turns")
    later = F.slice(turns, 2, F.greatest(F.size(turns) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(turns, 1, F.size(later)), later, lambda a, b: F.struct(
        a.role.eqNullSafe(b.role).alias("same"), F.greatest(b.turn - a.turn - 1, F.lit(0)).alias("gap")))
    total = lambda column: F.aggregate(column, F.lit(0).cast("bigint"), lambda s, x: s + x)
    spoken = F.transform(turns, lambda t: F.struct(t.role.alias("role"), _words(t.text).cast("bigint").alias("words")))
    by_role = F.transform(
        F.array_sort(F.array_distinct(F.filter(F.transform(turns, lambda t: t.role), lambda r: r.isNotNull()))),
        lambda role: F.struct(role.alias("role"), total(F.transform(
            F.filter(spoken, lambda s: s.role == role), lambda s: s.words)).alias("words")))
    return folded.select(
        "conv_id", "block", F.size(turns).cast("bigint").alias("n_turns"),
        F.array_join(F.transform(by_role, lambda r: F.concat_ws(":", r.role, r.words.cast("string"))), ",").alias("words_by_role"),
        total(F.transform(pairs, lambda p: p.same.cast("bigint"))).alias("same_role"),
        total(F.transform(pairs, lambda p: p.gap.cast("bigint"))).alias("left_out"),
    )


def unfold_turns(folded: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` again, repeats included."""
    flat = folded.select("conv_id", F.inline("turns"))
    return flat.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def learned_schema(rows: DataFrame, column: str, n: int = SAMPLE_ROWS) -> T.StructType:
    """The schema of the JSON objects in ``n`` rows that hold one; ``read_payloads`` tells which rows of the whole table miss it.

    Fields with values of several types are text, fractions are doubles. No object at all gives an empty schema.
    """
    values = rows.select(F.try_parse_json(F.col(column)).alias("value"))
    found = values.where(_is_object(F.col("value"))).limit(n).agg(F.schema_of_variant_agg("value").alias("found")).first().found
    if not found or not found.startswith("OBJECT<"):
        return T.StructType([])
    for own, plain in (("OBJECT<", "STRUCT<"), (r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE"), ("VARIANT|VOID", "STRING")):
        found = re.sub(rf"\b(?:{own})", plain, found)
    return T.StructType.fromDDL(f"payload {found}")["payload"].dataType


def read_payloads(rows: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """``rows`` without ``column``, with ``payload`` (a struct), ``state`` and ``raw``.

    ``state`` is ``missing`` (null), ``broken`` (no JSON object: the payload is null), ``misfit`` (a field cannot be read as declared: that field
    is null), ``surplus`` (fields that the schema lacks) or ``fits``. ``raw`` keeps the text of every row that does not fit, so no value is
    lost. Other columns of ``rows`` must have other names than these three.
    """
    text = F.col(column)
    payload = F.from_json(text, schema)
    given = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    # A field is misread if it is given, and not as a JSON null, but comes out null.
    misread = reduce(Column.__or__, [
        F.try_element_at(given, F.lit(f.name)).isNotNull() & payload[f.name].isNull() for f in schema.fields], F.lit(False))
    surplus = F.size(F.array_except(F.map_keys(given), F.array(*map(F.lit, schema.names)).cast("array<string>"))) > 0
    state = (
        F.when(text.isNull(), "missing").when(~_is_object(F.try_parse_json(text)), "broken")
        .when(misread, "misfit").when(surplus, "surplus").otherwise("fits"))
    kept = [c for c in rows.columns if c != column]
    read = rows.select(*kept, payload.alias("payload"), state.alias("state"), text.alias("raw"))
    return read.withColumns({
        "payload": F.when(F.col("state") != "broken", F.col("payload")),
        "raw": F.when(F.col("state") != "fits", F.col("raw"))})


def payload_states(read: DataFrame) -> DataFrame:
    """``state, row_count``: how much of a table a schema misses."""
    return read.groupBy("state").agg(F.count("*").alias("row_count"))
