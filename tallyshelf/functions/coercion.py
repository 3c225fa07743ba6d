"""Text-to-typed conversion where a value that does not fit becomes null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words pandas reads as missing by default.
NA_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

def null_words(text: Column) -> Column:
    """Null when the text is one of the missing-value words."""
    return F.when(~text.isin(NA_WORDS), text)


def nan_to_null(value: Column) -> Column:
    """Null when a double is NaN."""
    return F.when(~F.isnan(value), value)


# A failed cast costs far more than a pattern, so only text of the right shape is cast.
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITY = r"(?i)^\s*[+-]?inf(inity)?\s*$"


def to_double(text: Column) -> Column:
    """A number, or null. What only Java takes for one (``1d``, ``2f``) is null."""
    return F.when(text.rlike(_NUMBER) | text.rlike(_INFINITY), text.try_cast("double"))


def to_long(text: Column) -> Column:
    """A whole number, or null; ``5.0`` and ``1e3`` are whole, ``2.5`` is not."""
    exact = text.try_cast("decimal(38,18)")
    whole = F.when(exact == F.floor(exact), exact).try_cast("bigint")
    return F.when(text.rlike(_WHOLE), text.try_cast("bigint")).when(text.rlike(_NUMBER), whole)


def _utc_wall_clock(instant: Column) -> Column:
    """The UTC wall clock of an instant, whatever the session time zone is."""
    seconds = F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


# Text of these shapes is read without being told its format, month first; each shape has its patterns.
DEFAULT_FORMATS = {
    r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}": ("M/d/yyyy", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm"),
    r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}": ("yyyy/M/d", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm"),
    r"^[A-Z][a-z]{2} [0-9]{1,2},? [0-9]{4}": ("MMM d yyyy", "MMM d, yyyy"),
    r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}": ("d MMM yyyy",),
}
_ZONED = r"(?i):[0-9]{2}(\.[0-9]+)?\s*(z|utc|gmt|[+-][0-9]{2}(:?[0-9]{2})?|[a-z]+(/[a-z_+-]+)+)$"
# What the cast may read as a wall clock: no other shape, as it drops zone names without a word.
_WALL_CLOCK = r"^[0-9]{4,}(-[0-9]{1,2}(-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]+)?)?)?)?)?$"


def to_timestamp_ntz(text: Column, formats: Sequence[str] = ()) -> Column:
    """A zone-less timestamp, or null.

    Text with an offset or the name of a zone is moved to UTC; an unknown name makes it null. ISO forms are tried first, then
    each of ``formats`` (Spark datetime patterns) in turn, then the patterns of ``DEFAULT_FORMATS`` for the text's shape: so
    ``01/05/2024`` is the fifth of January unless ``formats`` has ``dd/MM/yyyy``.
    """
    clean = F.trim(text)
    # Spark's cast wants +05:30, exports also write +0530.
    colon = F.regexp_replace(clean, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    iso = F.when(clean.rlike(_ZONED), _utc_wall_clock(colon.try_cast("timestamp"))).when(
        clean.rlike(_WALL_CLOCK), clean.try_cast("timestamp_ntz")
    )
    usual = [
        F.when(clean.rlike(shape), F.coalesce(*[_parse_with(clean, pattern) for pattern in patterns]))
        for shape, patterns in DEFAULT_FORMATS.items()
    ]
    return F.coalesce(iso, *[_parse_with(clean, pattern) for pattern in formats], *usual)


def _parse_with(text: Column, pattern: str) -> Column:
    if any(letter in pattern for letter in "XxZVO"):
        return _utc_wall_clock(F.try_to_timestamp(text, F.lit(pattern)))
    # A pattern without a zone: the text is already a wall clock, keep it as one.
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def coerce(text: Column, dtype: T.DataType, formats: Sequence[str] = ()) -> Column:
    """``text`` as ``dtype`` by the rules above; no missing-value word reads as a value."""
    if isinstance(dtype, T.LongType):
        return to_long(text)
    if isinstance(dtype, T.DoubleType):
        return to_double(text)
    if isinstance(dtype, T.TimestampNTZType):
        return to_timestamp_ntz(text, formats)
    if isinstance(dtype, T.StringType):
        return null_words(text)
    raise ValueError(f"no coercion to {dtype.simpleString()}")
