"""CSV exports of unknown encoding, with rows of the wrong width, into declared tables.

A pre-scan decides per file how it must be read; the files are then read in a few groups. A file
without quoted line breaks is split as usual, the records of a file with some are put together from its lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyshelf.schemas import TableSpec
from tallyshelf.sources import conform
from tallyshelf.sources.csv_records import FIELD, OPENS, read_records

UTF8 = "UTF-8"
LATIN1 = "ISO-8859-1"
_RAW = "_raw_record"


@dataclass(frozen=True)
class ReadPlan:
    """Files that are read with the same options."""

    encoding: str
    multiline: bool
    paths: tuple[str, ...]


@dataclass(frozen=True)
class LoadedTable:
    """A loaded table, its raw text columns, and how it was read."""

    spec: TableSpec
    table: DataFrame
    raw: DataFrame | None
    plans: tuple[ReadPlan, ...]
    resolved: str | None
    tried: tuple[str, ...]
    width: int

    @property
    def missing(self) -> bool:
        return self.raw is None

    def report(self) -> DataFrame:
        """One row: what was read, how, and how many rows were kept and skipped."""
        encodings = sorted({p.encoding for p in self.plans})
        facts = {
            "table_name": F.lit(self.spec.name),
            "resolved": F.lit(self.resolved).cast("string"),
            "missing": F.lit(self.missing),
            "tried": F.lit(",".join(self.tried)),
            "encoding": F.lit(",".join(encodings) or None).cast("string"),
            "multiline": F.lit(any(p.multiline for p in self.plans)),
            "bad_rows": F.lit("skip"),
            "cols": F.lit(self.width).cast("bigint"),
        }
        if self.raw is None:
            counts = self.table.agg(
                F.count("*").alias("row_count"), F.lit(0).cast("bigint").alias("skipped_rows")
            )
        else:
            too_wide = F.col("too_wide")
            counts = self.raw.agg(
                F.count_if(~too_wide).alias("row_count"),
                F.count_if(too_wide).alias("skipped_rows"),
            )
        return counts.select(*[c.alias(n) for n, c in facts.items()], "row_count", "skipped_rows")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` (file, folder or glob) names anything Spark can read."""
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def plan_reads(spark: SparkSession, paths: Sequence[str]) -> list[ReadPlan]:
    """Encoding and line-break handling per file, as groups of files.

    One pass over the lines with a map-side aggregate, one row per file. A file whose bytes are
    not UTF-8 is ISO-8859-1. The first line that would end inside a quoted field starts outside of one,
    so it begins a value that goes on in the next line.
    """
    lines = spark.read.text(list(paths)).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
    )
    per_file = lines.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
        F.bool_or(F.col("value").rlike(OPENS)).alias("multiline"),
    )
    # One small row per input file: Spark's own file index on the driver is larger than this.
    groups: dict[tuple[str, bool], list[str]] = {}
    for row in per_file.collect():
        key = (UTF8 if row.utf8 else LATIN1, row.multiline)
        groups.setdefault(key, []).append(unquote(row.file))
    if len(groups) == 1:
        (encoding, multiline), = groups
        return [ReadPlan(encoding, multiline, tuple(paths))]
    return [
        ReadPlan(encoding, multiline, tuple(sorted(files)))
        for (encoding, multiline), files in sorted(groups.items())
    ]


def _header(spark: SparkSession, plan: ReadPlan) -> list[str | None]:
    reader = spark.read.options(encoding=plan.encoding, multiLine=plan.multiline, escape='"')
    first = reader.csv(list(plan.paths)).first()
    return [None if value is None else str(value) for value in first]


def reader_options(encoding: str, multiline: bool, check_headers: bool) -> dict[str, object]:
    """Options for reading every column as text with the raw record beside rows of odd width."""
    return {
        "header": True,
        "encoding": encoding,
        "multiLine": multiline,
        "escape": '"',
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _RAW,
        # Compares the header of every file to the schema and raises when one differs.
        "enforceSchema": not check_headers,
        # Width can only be judged when every field of the record is parsed.
        "columnPruning": False,
    }


def text_schema(headers: Sequence[str | None]) -> tuple[T.StructType, bool]:
    """A schema of text columns named as in the files, and whether headers can be compared to it
    (not when some are empty or repeated)."""
    plain = all(headers) and len({h.lower() for h in headers}) == len(headers)
    names = headers if plain else [f"_{i}" for i in range(len(headers))]
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RAW]]), plain


def shape_rows(rows: DataFrame, headers: Sequence[str | None], spec: TableSpec) -> DataFrame:
    """All columns as text under normalised headers, plus ``too_wide`` for rows to be skipped.

    Rows with fewer fields than the header keep nulls for the rest; blank lines are dropped.
    """
    names = conform.normal_headers(headers, spec)
    # Spark keeps the raw record of rows of another width only; wide ones have a comma after as many
    # fields as the header has.
    too_wide = F.coalesce(F.col(_RAW).rlike(f"^{FIELD}{{{len(names)}}}"), F.lit(False))
    not_blank = F.trim(F.concat_ws("", F.col(f"`{names[0]}`"), F.col(_RAW))) != ""
    return (
        rows.toDF(*names, _RAW)
        .where(F.col(_RAW).isNull() | not_blank)
        .select(*[F.col(f"`{n}`") for n in names], too_wide.alias("too_wide"))
    )


def read_raw(spark: SparkSession, plan: ReadPlan, spec: TableSpec) -> DataFrame:
    """The files of one plan, shaped as above."""
    headers = _header(spark, plan)
    schema, plain = text_schema(headers)
    options = reader_options(plan.encoding, plan.multiline, plain)
    if plan.multiline:
        rows = _parse_records(read_records(spark, plan.paths, plan.encoding), headers, schema)
    else:
        rows = spark.read.schema(schema).options(**options).csv(list(plan.paths))
    return shape_rows(rows, headers, spec)


def _parse_records(
    records: DataFrame, headers: Sequence[str | None], schema: T.StructType
) -> DataFrame:
    """The fields of every record but each file's first, which must be the expected header."""
    fields = F.from_csv("record", schema.toDDL(), {
        "mode": "PERMISSIVE", "escape": '"', "columnNameOfCorruptRecord": _RAW,
    })
    parsed = records.select("file", "record_no", fields.alias("fields"))
    found = F.array(*[F.col("fields").getField(n) for n in schema.fieldNames()[:-1]])
    expected = F.array(*[F.lit(h).cast("string") for h in headers])
    message = F.concat(F.lit("CSV header does not conform to the others: "), F.col("file"))
    is_row = F.when(F.col("record_no") > 1, True).otherwise(
        F.when(found == expected, False).otherwise(F.raise_error(message).cast("boolean"))
    )
    return parsed.where(is_row).select("fields.*")


def load_table(
    spark: SparkSession,
    spec: TableSpec,
    candidates: str | Sequence[str],
    *,
    formats: Sequence[str] = (),
    encoding: str | None = None,
    multiline: bool | None = None,
) -> LoadedTable:
    """The first existing candidate path as a declared table; an empty table when none exists.

    Giving both ``encoding`` and ``multiline`` skips the pre-scan.
    """
    paths = [candidates] if isinstance(candidates, str) else list(candidates)
    tried: list[str] = []
    for path in paths:
        if path_exists(spark, path):
            break
        tried.append(path)
    else:
        empty = spark.createDataFrame([], spec.schema)
        return LoadedTable(spec, empty, None, (), None, tuple(tried), len(spec.columns))

    if encoding is not None and multiline is not None:
        plans = [ReadPlan(encoding, multiline, (path,))]
    else:
        plans = []
        for p in plan_reads(spark, [path]):
            breaks = p.multiline if multiline is None else multiline
            plans.append(ReadPlan(encoding or p.encoding, breaks, p.paths))
    if not plans:  # no line in any file
        empty = spark.createDataFrame([], spec.schema)
        return LoadedTable(spec, empty, None, (), path, tuple(tried), 0)
    raws = [read_raw(spark, plan, spec) for plan in plans]
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), raws)
    kept = raw.where(~F.col("too_wide")).drop("too_wide")
    table = conform.conform(kept, spec, formats)
    return LoadedTable(spec, table, raw, tuple(plans), path, tuple(tried), len(raw.columns) - 1)
