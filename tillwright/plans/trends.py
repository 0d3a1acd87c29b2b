"""Sales over time, by category and by SKU."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.fixed_values import WEEKDAYS
from tillwright.functions import calendar
from tillwright.operators.filters import PRICED
from tillwright.operators.rollups import completed_grid, orders, qty, rev, rollup_by, table, top_k, total


def _per_day(src, *keys: str) -> DataFrame:
    """Totals per day: the text of weeks, months and weekdays is then made per day, not per line."""
    return rollup_by(src.totals("date", *keys), ["date", *keys], orders(), rev(), qty())


def _again(df: DataFrame, key: str) -> DataFrame:
    return rollup_by(df, [key], total("orders"), total("rev"), total("qty"))


def daily(src) -> DataFrame:
    return table(_per_day(src).orderBy("date"))


def weekly(src, iso_year: bool = False) -> DataFrame:
    weeks = _per_day(src).withColumn("year_week", F.expr(calendar.year_week("date", iso_year)))
    return table(_again(weeks, "year_week").orderBy("year_week"))


def monthly(src) -> DataFrame:
    """Months in calendar order, labelled like "Apr 2022"."""
    months = _again(_per_day(src).withColumn("first_day", F.trunc("date", "month")), "first_day").orderBy("first_day")
    return table(months.selectExpr(f"{calendar.month_name('first_day')} AS month_name", "orders", "rev", "qty"))


def trend(src, granularity: str = "Daily") -> DataFrame:
    """Orders, revenue and quantity over time: Daily, Weekly or Monthly."""
    by = {"Daily": daily, "Weekly": weekly, "Monthly": monthly}
    if granularity not in by:
        raise ValueError(f"granularity must be one of {sorted(by)}, not {granularity!r}")
    return by[granularity](src)


def category_summary(src) -> DataFrame:
    by_category = rollup_by(src.totals("category"), ["category"], rev(), orders(), qty())
    return table(by_category.orderBy(F.desc("rev"), "category"))


def top_skus(src, k: int = 20) -> DataFrame:
    """Best SKUs by revenue; lines with a revenue of zero take part."""
    keys = ["sku", "category"]
    totals = rollup_by(src.totals(*keys, rows=PRICED), keys, rev(), qty(), orders())
    return table(top_k(totals, "rev", k, keys))


def weekday_category(src) -> DataFrame:
    """Revenue per weekday that occurs and category, Monday first."""
    days = rollup_by(src.totals("date", "category"), ["date", "category"], rev())
    named = days.withColumn("day_of_week", F.expr(calendar.weekday_name("date")))
    grid = completed_grid(named, "category", "day_of_week", WEEKDAYS, "rev", "rev")
    position = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("day_of_week"))
    return table(grid.orderBy(position, "category").select("day_of_week", "category", "rev"))


def weekday_matrix(src, categories: Sequence[str]) -> DataFrame:
    """``weekday_category`` as a matrix: a row per weekday that occurs, a column per named category."""
    grid = weekday_category(src)
    position = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("day_of_week"))
    cells = grid.groupBy("day_of_week").pivot("category", list(categories)).agg(F.sum("rev"))
    return cells.na.fill(0.0).orderBy(position)
