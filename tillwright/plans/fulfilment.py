"""Orders and fulfilment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.functions.numbers import half_even, percent
from tillwright.operators.rollups import cancelled, lines, rollup_by, total


def daily_shipped_cancelled(src) -> DataFrame:
    counts = rollup_by(src.totals("date", "is_cancelled"), ["date", "is_cancelled"], lines("cnt"))
    label = F.when(F.col("is_cancelled") == 1, "Cancelled").otherwise("Shipped/Other")
    return counts.select("date", label.alias("type"), "cnt").orderBy("date", "type")


def cancel_rate_by_category(src) -> DataFrame:
    """Cancelled lines as a percentage of lines with an order id, one decimal."""
    totals = rollup_by(
        src.totals("category", "is_cancelled"), ["category"], total("orders", "total"), cancelled()
    )
    rate = half_even(percent(F.col("cancelled"), F.col("total")), 1)
    return totals.withColumn("cancel_rate_pct", rate).orderBy(F.desc("cancel_rate_pct"), "category")
