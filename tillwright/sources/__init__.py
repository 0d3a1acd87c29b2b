"""Where sales lines come from."""

from tillwright.sources.flat import FlatSales, read_sales_table, write_sales_table
from tillwright.sources.order_report import read_sales_csv, with_file_order
from tillwright.sources.star import StarSales

__all__ = ["FlatSales", "StarSales", "read_sales_csv", "read_sales_table", "with_file_order", "write_sales_table"]
