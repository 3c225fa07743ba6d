"""The three table schemas, their column aliases and the synonyms used for suggestions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG = T.LongType()
DOUBLE = T.DoubleType()
STRING = T.StringType()
TIMESTAMP = T.TimestampNTZType()


@dataclass(frozen=True)
class TableSpec:
    """One declared table: canonical columns in order, header aliases, suggestion synonyms."""

    name: str
    schema: T.StructType
    aliases: dict[str, str] = field(default_factory=dict)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    spaces_to_underscore: bool = False

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def type_of(self, column: str) -> T.DataType:
        return self.schema[column].dataType

    def sources_of(self, column: str) -> list[str]:
        """Header names that may carry ``column``: the canonical name first, then its aliases."""
        return [column] + [alias for alias, target in self.aliases.items() if target == column]


def _struct(columns: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in columns])


# Column names, order, types, aliases and synonyms are the tables' contract.

ORDERS = TableSpec(
    name="orders",
    schema=_struct([
        ("id", LONG),
        ("order_id", LONG),
        ("user_id", LONG),
        ("product_id", LONG),
        ("inventory_item_id", LONG),
        ("status", STRING),
        ("created_at", TIMESTAMP),
        ("shipped_at", TIMESTAMP),
        ("delivered_at", TIMESTAMP),
        ("returned_at", TIMESTAMP),
        ("sale_price", DOUBLE),
    ]),
    aliases={
        "price": "sale_price",
        "customer_id": "user_id",
        "buyer_id": "user_id",
        "client_id": "user_id",
    },
    synonyms={
        "user_id": ["customer", "customer_id", "buyer_id", "client_id"],
        "sale_price": ["price", "unit_price", "amount"],
        "order_id": ["oid", "sales_order_id"],
    },
)

INVENTORY = TableSpec(
    name="inventory",
    schema=_struct([
        ("id", LONG),
        ("product_id", LONG),
        ("created_at", TIMESTAMP),
        ("sold_at", TIMESTAMP),
        ("cost", DOUBLE),
        ("product_category", STRING),
        ("product_name", STRING),
        ("product_brand", STRING),
        ("product_retail_price", DOUBLE),
        ("product_department", STRING),
        ("product_sku", STRING),
        ("product_distribution_center_id", LONG),
    ]),
    aliases={"unit_cost": "cost", "buy_price": "cost"},
    synonyms={
        "product_id": ["pid", "item_id"],
        "cost": ["unit_cost", "buy_price"],
    },
)

MG = TableSpec(
    name="mg",
    schema=_struct([
        ("month", STRING),
        ("id_user", LONG),
        ("name", STRING),
        ("fleet", STRING),
        ("city", STRING),
        ("vendor_name", STRING),
        ("rate", DOUBLE),
        ("joining_date", TIMESTAMP),
        ("total_calendar_days", LONG),
        ("attendance", LONG),
        ("total_attendance", LONG),
        ("perfect_attendance", LONG),
        ("pa_needed", LONG),
        ("mg_eligible", LONG),
        ("total_delivered_month", LONG),
        ("monthly_mg", DOUBLE),
        ("eligible_mg", DOUBLE),
        ("mg_month", LONG),
        ("payout", DOUBLE),
        ("mg_amount", DOUBLE),
        ("total_payout", DOUBLE),
        ("mot", STRING),
        ("final_mg_check", STRING),
        ("fnd_ndr_penalty_amount", DOUBLE),
        ("da_level_final_amount", DOUBLE),
    ]),
    aliases={
        "vendor": "vendor_name",
        "final_amount": "da_level_final_amount",
        "penalty": "fnd_ndr_penalty_amount",
    },
    synonyms={
        "vendor_name": ["vendor"],
        "fnd_ndr_penalty_amount": ["penalty", "fnd_ndr_penalty"],
        "da_level_final_amount": ["final_amount", "da_final_amount"],
    },
    spaces_to_underscore=True,
)

# End of fixed values.

TABLES: dict[str, TableSpec] = {spec.name: spec for spec in (ORDERS, INVENTORY, MG)}
