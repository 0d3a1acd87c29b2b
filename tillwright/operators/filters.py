"""Global filters, composed with AND."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALL = "All"
PARTITION_MONTH = "sales_month"

# Row classes: predicates over a single line's quantity and amount.
EVERY = "every"
SOLD = "sold"
PRICED = "priced"
EARNING = "earning"


def row_class(name: str) -> Column | None:
    return {
        EVERY: None,
        SOLD: F.col("qty") > 0,
        PRICED: F.col("revenue").isNotNull(),
        EARNING: F.col("revenue") > 0,
    }[name]


@dataclass(frozen=True)
class FilterSpec:
    """Date range (inclusive, needs both ends), category, fulfilment and order type."""

    date_from: dt.date | None = None
    date_to: dt.date | None = None
    category: str = ALL
    fulfilment: str = ALL
    order_type: str = ALL

    def __post_init__(self) -> None:
        if self.order_type not in (ALL, "B2B", "B2C"):
            raise ValueError(f"order_type must be All, B2B or B2C, not {self.order_type!r}")

    def _has_dates(self) -> bool:
        return self.date_from is not None and self.date_to is not None

    def roles(self) -> set[str]:
        wanted = {
            "date": self._has_dates(),
            "category": self.category != ALL,
            "fulfilment": self.fulfilment != ALL,
            "b2b": self.order_type != ALL,
        }
        return {role for role, used in wanted.items() if used}

    def apply(self, df: DataFrame) -> DataFrame:
        if self._has_dates():
            df = df.where(F.col("date").between(F.lit(self.date_from), F.lit(self.date_to)))
            if PARTITION_MONTH in df.columns:
                months = [f"{d:%Y-%m}" for d in (self.date_from, self.date_to)]
                df = df.where(F.col(PARTITION_MONTH).between(*months))
        if self.category != ALL:
            df = df.where(F.col("category") == self.category)
        if self.fulfilment != ALL:
            df = df.where(F.col("fulfilment") == self.fulfilment)
        if self.order_type != ALL:
            df = df.where(F.col("b2b") if self.order_type == "B2B" else ~F.col("b2b"))
        return df
