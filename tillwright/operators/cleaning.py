"""Cleaning as one expression per role, so a frame holding only some roles cleans the same way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwright.fixed_values import (
    CANCELLED_PREFIX,
    DEFAULT_CURRENCY,
    FULFILLED_BY_PLATFORM,
    FULFILLED_BY_SELLER,
    NO_PROMOTION,
    PLATFORM_FULFILMENT,
    SHIPPED_PREFIX,
    UNKNOWN_COURIER,
    UNKNOWN_PLACE,
)
from tillwright.functions import calendar, text
from tillwright.schema import DERIVED_FROM, SalesSchema

# Per-row counts and sums every report adds up. A frame may carry them per line or already summed
# over several lines; reports only ever add them, so both give the same result.
MEASURES = (
    "lines",
    "orders",
    "qty",
    "units",
    "revenue",
    "priced",
    "earned",
    "earning_lines",
    "earning_orders",
    "earning_qty",
)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats})


def _with(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Replace or add columns given as SQL."""
    if not rules:
        return df
    kept = [f"`{c}`" for c in df.columns if c not in rules]
    return df.selectExpr(*kept, *[f"{rule} AS {name}" for name, rule in rules.items()])


def clean_roles(df: DataFrame, tidy_places: bool = False) -> DataFrame:
    """Clean the text and date roles that are present; ``tidy_places`` only need their gaps filled."""
    kinds = dict(df.dtypes)
    is_platform = f"fulfilment = '{PLATFORM_FULFILMENT}'"
    by_whom = f"CASE WHEN {is_platform} THEN '{FULFILLED_BY_PLATFORM}' ELSE '{FULFILLED_BY_SELLER}' END"
    rules = {
        "date": calendar.report_date("date") if kinds.get("date") == "string" else "CAST(date AS DATE)",
        "state": f"coalesce(state, '{UNKNOWN_PLACE}')" if tidy_places else text.state("state"),
        "city": f"coalesce(city, '{UNKNOWN_PLACE}')" if tidy_places else text.place("city"),
        "courier_status": f"coalesce(courier_status, '{UNKNOWN_COURIER}')",
        "promotion_ids": f"coalesce(promotion_ids, '{NO_PROMOTION}')",
        "currency": f"coalesce(currency, '{DEFAULT_CURRENCY}')",
        "fulfilled_by": f"coalesce(fulfilled_by, {by_whom})",
    }
    return _with(df, {role: rule for role, rule in rules.items() if role in kinds})


def add_derived(df: DataFrame) -> DataFrame:
    """Calendar columns and 0/1 flags for the roles that are present."""
    rules = {
        "month": "month(date)",
        "month_name": calendar.month_name("date"),
        "week": "weekofyear(date)",
        "day_of_week": calendar.weekday_name("date"),
        "is_cancelled": text.has_prefix("status", CANCELLED_PREFIX),
        "is_shipped": text.has_prefix("status", SHIPPED_PREFIX),
        "is_b2b": "CAST(b2b AS INT)",
    }
    present = set(df.columns)
    return _with(df, {name: rule for name, rule in rules.items() if DERIVED_FROM[name] in present})


def add_measures(df: DataFrame) -> DataFrame:
    """Line-level measures from ``order_id``, ``qty`` and ``amount``, and the ``kind`` of line.

    Sums over lines of one kind fall into the same row classes as the lines themselves.
    """
    priced = _with(df, {"qty": "CAST(qty AS BIGINT)", "revenue": "CASE WHEN qty > 0 THEN amount END"})
    measures = {
        "lines": "1L",
        "orders": "CAST(order_id IS NOT NULL AS BIGINT)",
        "units": "CASE WHEN qty > 0 THEN qty END",
        "priced": "CAST(revenue IS NOT NULL AS BIGINT)",
        "earned": "CASE WHEN revenue > 0 THEN revenue END",
        "earning_lines": "CASE WHEN revenue > 0 THEN 1L ELSE 0L END",
        "earning_orders": "CASE WHEN revenue > 0 AND order_id IS NOT NULL THEN 1L ELSE 0L END",
        "earning_qty": "CASE WHEN revenue > 0 THEN qty END",
        "kind": """CASE WHEN revenue > 0 THEN 'earning' WHEN revenue IS NOT NULL THEN 'priced'
            WHEN qty > 0 THEN 'sold' ELSE 'unsold' END""",
    }
    return _with(priced, measures)


def clean(raw: DataFrame, schema: SalesSchema) -> DataFrame:
    """Raw sales lines to clean lines with roles, derived columns and measures."""
    return add_measures(add_derived(clean_roles(nan_to_null(schema.to_roles(raw)))))
