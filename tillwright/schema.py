"""Column roles: operators name roles, a ``SalesSchema`` says which physical column plays each."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

# Roles the operators read, with the type each has in a raw frame.
RAW_TYPES: dict[str, str] = {
    "order_id": "string",
    "date": "date",
    "status": "string",
    "fulfilment": "string",
    "service_level": "string",
    "style": "string",
    "sku": "string",
    "category": "string",
    "size": "string",
    "courier_status": "string",
    "qty": "int",
    "amount": "decimal(18,2)",
    "city": "string",
    "state": "string",
    "promotion_ids": "string",
    "b2b": "boolean",
}

# A raw frame's column with the sortable place of each row in its source; no audit counts it as data.
PLACE = "file_order"

# Roles that are cleaned when present but that no report reads.
CARRIED_ROLES = ("sales_channel", "currency", "fulfilled_by")

# Roles derived from others during cleaning.
DERIVED_FROM: dict[str, str] = {
    "month": "date",
    "month_name": "date",
    "week": "date",
    "day_of_week": "date",
    "is_cancelled": "status",
    "is_shipped": "status",
    "is_b2b": "b2b",
}


@dataclass(frozen=True)
class SalesSchema:
    """Maps roles to the physical column names of one kind of sales table."""

    columns: Mapping[str, str]
    junk: tuple[str, ...] = ()

    def name(self, role: str) -> str:
        return self.columns[role]

    def to_roles(self, df: DataFrame) -> DataFrame:
        """Trim headers, drop junk columns and rename physical columns to roles; others pass through."""
        trimmed = df.toDF(*[c.strip() for c in df.columns])
        renames = {physical: role for role, physical in self.columns.items() if physical in trimmed.columns}
        return trimmed.drop(*self.junk).withColumnsRenamed(renames)


# Headers of the order report CSV.
ORDER_REPORT = SalesSchema(
    columns={
        "order_id": "Order ID",
        "date": "Date",
        "status": "Status",
        "fulfilment": "Fulfilment",
        "sales_channel": "Sales Channel",
        "service_level": "ship-service-level",
        "style": "Style",
        "sku": "SKU",
        "category": "Category",
        "size": "Size",
        "courier_status": "Courier Status",
        "qty": "Qty",
        "currency": "currency",
        "amount": "Amount",
        "city": "ship-city",
        "state": "ship-state",
        "promotion_ids": "promotion-ids",
        "b2b": "B2B",
        "fulfilled_by": "fulfilled-by",
    },
    junk=("Unnamed: 22", "_c22"),
)

# The star-schema view names its columns after the roles, but for the two places.
STAR_SCHEMA = SalesSchema(columns={**{r: r for r in RAW_TYPES}, "city": "ship_city", "state": "ship_state"})
