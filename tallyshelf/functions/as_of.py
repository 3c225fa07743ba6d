"""The declared tables as they were known at an instant: what happened later is left out."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Instant = str | dt.date | dt.datetime

# Timestamps of later steps of a row that was already there.
_LATER = {"orders": ("shipped_at", "delivered_at", "returned_at"), "inventory": ("sold_at",)}


def instant(as_of: Instant) -> Column:
    """A zone-less timestamp; one with an offset is moved to UTC, a date is its first instant."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of)
    if not isinstance(as_of, dt.datetime):
        as_of = dt.datetime.combine(as_of, dt.time())
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(dt.UTC).replace(tzinfo=None)
    return F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")


def _created_by(table: DataFrame, name: str, as_of: Instant | None) -> DataFrame:
    if as_of is None:
        return table
    now = instant(as_of)
    known = table.where(F.col("created_at") <= now)
    later = {c: F.when(F.col(c) <= now, F.col(c)) for c in _LATER[name] if c in table.columns}
    return known.withColumns(later) if later else known


def orders_at(orders: DataFrame, as_of: Instant | None) -> DataFrame:
    """Items created at or before ``as_of``; later shipping, delivery and return are not known yet. Items without a date are left out."""
    return _created_by(orders, "orders", as_of)


def inventory_at(inventory: DataFrame, as_of: Instant | None) -> DataFrame:
    """Units received at or before ``as_of``; those sold later are on hand. Units without a date are left out."""
    return _created_by(inventory, "inventory", as_of)


def mg_at(mg: DataFrame, as_of: Instant | None) -> DataFrame:
    """Worker-months that began at or before ``as_of``; months are text of the form ``yyyy-MM``."""
    return mg if as_of is None else mg.where(F.col("month") <= F.date_format(instant(as_of), "yyyy-MM"))


def tables_at(tables: dict[str, DataFrame], as_of: Instant | None) -> dict[str, DataFrame]:
    """The declared tables by name, each at ``as_of``."""
    known = {"orders": orders_at, "inventory": inventory_at, "mg": mg_at}
    return {name: known[name](table, as_of) for name, table in tables.items()}
