"""Facets for the global filters, and views of the cleaned lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.fixed_values import REPORT_DATE_FORMAT
from tillwright.functions import calendar
from tillwright.operators.rollups import lines, rev, rollup_by, table
from tillwright.schema import ORDER_REPORT, RAW_TYPES
from tillwright.sources.flat import FlatSales


def facet(src, role: str) -> DataFrame:
    """Distinct non-missing values of a role, sorted; callers offer "All" on top."""
    found = src.totals(role).select(F.col(role).alias("value"))
    return found.where(F.col("value").isNotNull()).distinct().orderBy("value")


def date_bounds(src) -> DataFrame:
    return src.totals("date").agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def clean_sales(src) -> DataFrame:
    """The cleaned line table."""
    roles = ("order_id", "sku", "date", "status", "state", "city", "courier_status", "promotion_ids")
    flags = ("is_cancelled", "is_shipped", "is_b2b")
    return table(src.lines(*roles, *flags).select(*roles, "qty", "revenue", *flags))


def report_form(src) -> DataFrame:
    """The raw lines as the order report has them: its headers with blanks around, two-digit years, an
    empty column without a header, and gaps in the columns that cleaning fills."""
    columns = {ORDER_REPORT.name(role): F.col(f"`{src.raw_name(role)}`") for role in RAW_TYPES}
    columns[ORDER_REPORT.name("date")] = F.date_format(columns[ORDER_REPORT.name("date")], REPORT_DATE_FORMAT)
    columns["currency"] = F.when(F.col(f"`{src.raw_name('qty')}`") % 2 == 1, "USD")
    columns["fulfilled-by"] = F.when(F.col(f"`{src.raw_name('promotion_ids')}`").isNotNull(), "Courier")
    columns[ORDER_REPORT.junk[0]] = F.lit(None).cast("string")
    return src.raw().select(*[c.alias(f" {name} ") for name, c in columns.items()])


def clean_report(src) -> DataFrame:
    """The lines once more, by way of the order report's form and its cleaning."""
    report = FlatSales.from_raw(report_form(src), ORDER_REPORT)
    roles = ("order_id", "date", "status", "fulfilment", "sku", "category", "size", "courier_status", "state", "city", "promotion_ids")
    filled = ("currency", "fulfilled_by", "is_b2b")
    return table(report.lines(*roles, *filled).select(*roles, *filled, "qty", "revenue"))


def states(src) -> DataFrame:
    return rollup_by(src.totals("state"), ["state"], lines()).orderBy("state")


def calendar_of(src, iso_year: bool = False) -> DataFrame:
    """Calendar columns of every date that occurs."""
    days = src.totals("date").select("date").where("date IS NOT NULL").distinct()
    return days.selectExpr(
        "date",
        "CAST(month(date) AS BIGINT) AS month",
        f"{calendar.month_name('date')} AS month_name",
        "CAST(weekofyear(date) AS BIGINT) AS week",
        f"{calendar.weekday_name('date')} AS day_of_week",
        f"{calendar.year_week('date', iso_year)} AS year_week",
    ).orderBy("date")


def category_totals(src) -> DataFrame:
    """Rows and revenue per category under the source's filters."""
    return table(rollup_by(src.totals("category"), ["category"], lines(), rev()).orderBy("category"))
