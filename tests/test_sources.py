"""The same reports over one wide table, stored or not, and the order report CSV."""

import datetime as dt
from decimal import Decimal

import pytest
from conftest import SF_DIR, one, rows

from check import rows_of
from tillwright.catalog import REPORTS
from tillwright.operators.filters import FilterSpec
from tillwright.plans import overview, quality, selection
from tillwright.schema import ORDER_REPORT, STAR_SCHEMA
from tillwright.sources import FlatSales, StarSales, read_sales_csv, read_sales_table, write_sales_table
from tillwright.sources.order_report import with_file_order


@pytest.fixture(scope="module")
def flat(spark):
    raw = StarSales(spark, SF_DIR).raw(placed=True).cache()
    yield FlatSales.from_raw(raw, STAR_SCHEMA)
    raw.unpersist()


@pytest.fixture(scope="module")
def stored(spark, flat, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sales") / "table")
    write_sales_table(flat.clean_lines, path)
    return read_sales_table(spark, path)


@pytest.mark.parametrize("name", REPORTS)
def test_one_wide_table_gives_the_same(spark, flat, name):
    star = REPORTS[name](StarSales(spark, SF_DIR))
    wide = REPORTS[name](flat)
    assert rows_of(wide.columns, wide.collect()) == rows_of(star.columns, star.collect())


@pytest.mark.parametrize("name", ["kpi_overview", "trend_weekly", "state_summary", "fc_features", "filtered_sales", "ins_cards"])
def test_stored_table_gives_the_same(flat, stored, name):
    a, b = REPORTS[name](flat), REPORTS[name](stored)
    assert rows_of(a.columns, a.collect()) == rows_of(b.columns, b.collect())


def test_storing_without_rebalancing(spark, flat, stored, tmp_path):
    path = str(tmp_path / "plain")
    write_sales_table(flat.clean_lines, path, rebalance=False)
    again = read_sales_table(spark, path)
    assert again.clean_lines.count() == stored.clean_lines.count() == flat.clean_lines.count()


def test_date_filter_prunes_stored_months(stored):
    spec = FilterSpec(dt.date(1996, 1, 10), dt.date(1996, 2, 20))
    plan = stored.where(spec).lines("category")._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "sales_month" in pruned and "1996-01" in pruned


def test_not_a_sales_table(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="lacks"):
        read_sales_table(spark, str(tmp_path / "t"))


HEADER = (
    "index,Order ID,Date,Status,Fulfilment,Sales Channel ,ship-service-level,Style,SKU,Category,Size,ASIN,Courier Status,"
    "Qty,currency,Amount,ship-city,ship-state,ship-postal-code,ship-country,promotion-ids,B2B,fulfilled-by,"
)
BODY = [
    '0,A1,04-30-22,Cancelled,Merchant,Site,Standard,S1,K1,Set,S,B0,,0,INR,647.62,MUMBAI,MAHARASHTRA,400081,IN,,False,Easy Ship,',
    '1,A1,04-30-22,Shipped - Delivered to Buyer,Merchant,Site,Standard,S2,K2,kurta,3XL,B1,Shipped,1,,406.00,bengaluru, rj ,560085,IN,"P1, ""big"" P2",True,,',
    '2,A2,13-01-22,Shipped,Amazon,Site,Expedited,S3,K3,N/A,XL,B2,Shipped,1.0,INR,NaN,,Rajsthan,410210,IN,null,FALSE,,',
    '3,A3,4-3-22,Shipped,Amazon,Site,Expedited,S3,K3,Set,Free,B2,N/A,2,INR,0,x,New Delhi,410210,IN,P3,false,,',
]


@pytest.fixture
def report(spark, tmp_path):
    path = tmp_path / "report.csv"
    path.write_text("\n".join([HEADER, *BODY]) + "\n")
    return read_sales_csv(spark, str(path))


def test_csv_raw(report):
    assert len(report.columns) == 24
    assert "Sales Channel " in report.columns and "_c23" in report.columns
    kinds = dict(report.dtypes)
    assert (kinds["Qty"], kinds["Amount"], kinds["B2B"], kinds["Date"]) == ("int", "decimal(18,2)", "boolean", "string")
    got = rows(report.select("Qty", "Amount", "B2B", "Category", "`promotion-ids`", "`Courier Status`", "`ship-state`"))
    assert got == [
        (0, Decimal("647.62"), False, "Set", None, None, "MAHARASHTRA"),
        (1, Decimal("406.00"), True, "kurta", 'P1, "big" P2', "Shipped", " rj "),
        (1, None, False, None, None, "Shipped", "Rajsthan"),
        (2, Decimal("0.00"), False, "Set", "P3", None, "New Delhi"),
    ]


def test_csv_cleaning(report):
    clean = FlatSales.from_raw(report, ORDER_REPORT).clean_lines
    assert "_c22" not in clean.columns and "ASIN" in clean.columns
    got = rows(clean.select("date", "state", "city", "courier_status", "promotion_ids", "currency", "fulfilled_by", "revenue", "is_b2b", "is_shipped"))
    d = dt.date
    assert got == [
        (d(2022, 4, 30), "MAHARASHTRA", "MUMBAI", "Unknown", "None", "INR", "Easy Ship", None, 0, 0),
        (d(2022, 4, 30), "RAJASTHAN", "BENGALURU", "Shipped", 'P1, "big" P2', "INR", "Easy Ship", Decimal("406.00"), 1, 1),
        (None, "RAJASTHAN", "UNKNOWN", "Shipped", "None", "INR", "Amazon FBA", None, 0, 1),
        (d(2022, 4, 3), "DELHI", "X", "Unknown", "P3", "INR", "Amazon FBA", Decimal("0.00"), 0, 1),
    ]


def test_csv_reports(report):
    src = FlatSales.from_raw(report, ORDER_REPORT)
    assert rows(selection.facet(src, "category")) == [("Set",), ("kurta",)]
    assert one(overview.kpi_overview(src)) == {
        "total_orders": 3,
        "total_revenue": 406.0,
        "total_qty": 4,
        "avg_order_value": round(406 / 3, 4),
        "cancel_rate_pct": 25.0,
        "top_category": "kurta",
        "health": "Monitor",
    }
    assert one(quality.shape(src)) == {"n_rows": 4, "n_cols": 24, "dup_rows": 0, "dup_order_ids": 1}
    absent = {r["column"]: (r["missing"], r["missing_pct"]) for r in quality.missing(src).collect()}
    assert absent["Amount"] == (1, 25.0) and absent["promotion-ids"] == (2, 50.0) and absent["_c23"] == (4, 100.0)
    assert absent["fulfilled-by"] == (3, 75.0) and "Qty" not in absent


def test_first_sample_in_file_order(report):
    got = dict(rows(quality.samples(with_file_order(report), "file_order")))
    assert got["Courier Status"] == "Shipped" and got["promotion-ids"] == 'P1, "big" P2'
    assert got["Amount"] == "647.62" and got["_c23"] == "N/A"


def test_missing_report_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="nowhere.csv"):
        read_sales_csv(spark, str(tmp_path / "nowhere.csv"))
