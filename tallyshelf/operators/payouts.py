"""The monthly payout listing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyshelf.functions.as_of import Instant, mg_at
from tallyshelf.functions.ordering import asc, desc, take, then_by_rest

# Listed columns in order, and the row limit.
PAYOUT_COLUMNS = [
    "month", "city", "vendor_name", "fleet", "id_user", "name",
    "rate", "attendance", "perfect_attendance", "mg_eligible",
    "total_delivered_month", "monthly_mg", "eligible_mg",
    "fnd_ndr_penalty_amount", "da_level_final_amount", "total_payout",
]
PAYOUT_ROWS = 200


def payouts(mg: DataFrame, n: int = PAYOUT_ROWS, as_of: Instant | None = None) -> DataFrame:
    """The ``n`` worker-months of highest total payout, unknown totals last; of months begun by ``as_of`` if given."""
    listed = mg_at(mg, as_of).select(*PAYOUT_COLUMNS)
    ties = ["id_user", "month"]
    keys = [desc("total_payout"), *[asc(c) for c in ties]]
    return take(listed, [*keys, *then_by_rest(listed, ["total_payout", *ties])], n)
