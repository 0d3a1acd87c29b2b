"""Overview: headline figures and their breakdowns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.fixed_values import HEALTHY_CANCEL_PCT, SIZES
from tillwright.functions.numbers import percent, ratio
from tillwright.operators.rollups import (
    cancelled,
    domain_totals,
    lines,
    rev,
    rollup_by,
    table,
    total,
    value_counts,
)


def kpi_overview(src) -> DataFrame:
    """One row of headline figures. Average order value is per distinct order."""
    per_order = (
        src.lines("order_key", "is_cancelled")
        .groupBy("order_key")
        .agg(rev(), total("units"), lines(), cancelled())
    )
    ordered = F.when(F.col("order_key").isNotNull(), F.col("rev"))
    headline = per_order.agg(
        F.count("order_key").alias("total_orders"),
        total("rev", "total_revenue"),
        total("units", "total_qty"),
        ratio(F.sum(ordered), F.count("order_key")).alias("avg_order_value"),
        percent(F.sum("cancelled"), F.sum("rows")).alias("cancel_rate_pct"),
    )
    by_category = rollup_by(src.totals("category"), ["category"], rev())
    leader = by_category.agg(F.min(F.struct(-F.col("rev"), "category"))["category"]).scalar()
    return table(
        headline.select(
            "total_orders",
            "total_revenue",
            "total_qty",
            F.round("avg_order_value", 4).alias("avg_order_value"),
            F.round("cancel_rate_pct", 4).alias("cancel_rate_pct"),
            F.coalesce(leader, F.lit("N/A")).alias("top_category"),
            F.when(F.col("cancel_rate_pct") <= HEALTHY_CANCEL_PCT, "Healthy").otherwise("Monitor").alias("health"),
        )
    )


def daily_revenue(src) -> DataFrame:
    return table(rollup_by(src.totals("date"), ["date"], rev()).orderBy("date"))


def category_revenue(src) -> DataFrame:
    return table(rollup_by(src.totals("category"), ["category"], rev()).orderBy("rev", "category"))


def counts_of(src, role: str) -> DataFrame:
    return value_counts(src.totals(role), role)


def order_type_counts(src) -> DataFrame:
    return value_counts(src.totals("b2b"), "b2b", F.when(F.col("b2b"), "B2B").otherwise("B2C"))


def size_quantities(src) -> DataFrame:
    return domain_totals(src.totals("size"), "size", SIZES, "qty", "qty").orderBy("ordinal")
