"""Sales analytics and demand forecasting as Spark jobs."""

from tillwright.operators.filters import FilterSpec
from tillwright.schema import ORDER_REPORT, STAR_SCHEMA, SalesSchema
from tillwright.sources import FlatSales, StarSales, read_sales_csv, read_sales_table, write_sales_table

__all__ = [
    "FilterSpec",
    "FlatSales",
    "ORDER_REPORT",
    "STAR_SCHEMA",
    "SalesSchema",
    "StarSales",
    "read_sales_csv",
    "read_sales_table",
    "write_sales_table",
]
