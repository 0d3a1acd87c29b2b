"""Null handling, ties, denominators, rounding and formats on hand-made lines."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from conftest import one, rows, sales
from pyspark.sql import functions as F

from tillwright.functions import calendar, text
from tillwright.functions.numbers import half_even
from tillwright.operators.cleaning import nan_to_null
from tillwright.operators.filters import FilterSpec
from tillwright.plans import demand, fulfilment, geography, insights, overview, products, quality, selection, trends

D = Decimal


def test_report_dates(spark):
    words = ["04-30-22", "4-3-22", "06-29-70", "12-31-68", "01-01-69", "13-01-22", "04-30-2022", "", None]
    df = spark.createDataFrame([(w,) for w in words], "d string").selectExpr(f"{calendar.report_date('d')} AS d")
    d = dt.date
    assert [r[0] for r in df.collect()] == [d(2022, 4, 30), d(2022, 4, 3), d(1970, 6, 29), d(2068, 12, 31), d(1969, 1, 1), None, None, None, None]


def test_calendar_text(spark):
    days = [dt.date(2022, 1, 1), dt.date(2022, 3, 31), dt.date(2022, 6, 5)]
    df = spark.createDataFrame([(d,) for d in days], "d date").selectExpr(
        calendar.month_name("d"), calendar.weekday_name("d"), calendar.year_week("d"), calendar.year_week("d", True)
    )
    assert rows(df) == [
        ("Jan 2022", "Saturday", "2022-W52", "2021-W52"),
        ("Mar 2022", "Thursday", "2022-W13", "2022-W13"),
        ("Jun 2022", "Sunday", "2022-W22", "2022-W22"),
    ]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        (" rj ", "RAJASTHAN"),
        ("RAJSHTHAN", "RAJASTHAN"),
        ("New Delhi", "DELHI"),
        ("PUNJAB/MOHALI/ZIRAKPUR", "PUNJAB"),
        ("APO", "UNKNOWN"),
        ("\tGoa \n", "GOA"),
        ("NEW DELHI WEST", "NEW DELHI WEST"),
        ("   ", "UNKNOWN"),
        (None, "UNKNOWN"),
    ],
)
def test_states(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "s string").selectExpr(f"{text.state('s')} AS s")
    assert df.collect()[0][0] == clean


def test_revenue_and_row_classes(spark):
    src = sales(
        spark,
        {"qty": 1, "amount": "10"},
        {"qty": 0, "amount": "10"},
        {"qty": 1, "amount": None},
        {"qty": 1, "amount": "0"},
        {"qty": None, "amount": "10"},
    )
    assert [r[0] for r in src.clean_lines.select("revenue").collect()] == [D("10.00"), None, None, D("0.00"), None]
    assert [src.lines("sku", rows=k).count() for k in ("every", "sold", "priced", "earning")] == [5, 3, 2, 1]


def test_null_keys_vanish_and_null_sums_are_zero(spark):
    src = sales(spark, {"category": "a", "amount": None}, {"category": None}, {"category": "b", "amount": "2"})
    assert rows(overview.category_revenue(src)) == [("a", 0.0), ("b", 2.0)]
    assert one(overview.kpi_overview(src))["total_revenue"] == 12.0


def test_nan_is_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"))
    assert one(df.agg(F.count("x").alias("n"), F.sum("x").alias("s"))) == {"n": 1, "s": 1.0}


def test_order_counts_and_values(spark):
    src = sales(spark, {"order_id": "a"}, {"order_id": "a", "amount": "20"}, {"order_id": "b", "amount": None}, {"order_id": None, "qty": -2})
    kpi = one(overview.kpi_overview(src))
    assert (kpi["total_orders"], kpi["total_qty"], kpi["avg_order_value"]) == (2, 3, 15.0)
    assert one(trends.category_summary(src)) == {"category": "Kurta", "rev": 30.0, "orders": 3, "qty": 1}


def test_ties_go_to_the_first_key(spark):
    src = sales(spark, {"category": "b", "sku": "y"}, {"category": "a", "sku": "z"}, {"category": "c", "amount": "1"})
    assert one(overview.kpi_overview(src))["top_category"] == "a"
    assert rows(trends.top_skus(src, 2).select("sku")) == [("y",), ("z",)]
    assert rows(insights.sku_extremes(src).select("which", "sku", "rev")) == [("best", "y", 10.0), ("worst", "sk1", 1.0)]


def test_rounding(spark):
    cases = [(0.125, 2), (0.5, 0), (2.5, 0), (2.675, 2), (14.25, 1), (1.005, 2), (-0.35, 1)]
    df = spark.range(1).select(*[half_even(F.lit(x), digits) for x, digits in cases])
    assert rows(df) == [tuple(float(np.round(x, digits)) for x, digits in cases)]
    assert rows(df)[0][:3] == (0.12, 0.0, 2.0)


def test_cancel_rate_is_coarse_in_one_report_and_fine_in_the_other(spark):
    lines = [{"status": "Cancelled"}] + [{}] * 6
    src = sales(spark, *lines)
    assert one(products.category_performance(src))["cancel_rate_pct"] == 14.0
    assert one(fulfilment.cancel_rate_by_category(src))["cancel_rate_pct"] == 14.3


def test_average_order_value_is_per_priced_line_by_category(spark):
    src = sales(spark, {"amount": "10"}, {"amount": "0"}, {"amount": None})
    assert one(products.category_performance(src))["avg_row_revenue"] == 5.0
    assert one(insights.category_stats_table(src))["avg_row_revenue"] == 10.0


def test_products_that_never_earn_have_no_stats(spark):
    src = sales(spark, {"category": "a"}, {"category": "b", "qty": 0, "status": "Cancelled - Refunded"})
    assert rows(insights.category_stats_table(src).select("category", "cancel_rate_pct")) == [("a", 0.0)]


def test_sizes_follow_the_domain(spark):
    src = sales(spark, {"size": "XL", "qty": 3}, {"size": "Other"}, {"size": "XS"}, {"size": None})
    got = rows(overview.size_quantities(src))
    assert len(got) == 11 and got[0] == ("XS", 0, 1) and got[4] == ("XL", 4, 3) and got[10] == ("Free", 10, 0)


def test_grids_are_complete_over_what_occurs(spark):
    src = sales(
        spark,
        {"category": "a", "size": "XL", "qty": 3},
        {"category": "b", "size": "S"},
        {"category": "c", "size": "Other"},
        {"category": None, "size": "M"},
    )
    assert rows(products.category_sizes(src)) == [
        ("a", "S", 0), ("a", "XL", 3), ("b", "S", 1), ("b", "XL", 0), ("c", "S", 0), ("c", "XL", 0),
    ]
    days = sales(spark, {"date": "06-06-22", "category": "a"}, {"date": "06-05-22", "category": "b"}, {"date": None, "category": "z"})
    assert rows(trends.weekday_category(days)) == [
        ("Monday", "a", 10.0), ("Monday", "b", 0.0), ("Sunday", "a", 0.0), ("Sunday", "b", 10.0),
    ]


def test_matrices(spark):
    src = sales(spark, {"category": "a", "size": "XL", "qty": 3, "date": "06-06-22"}, {"category": "b", "size": "S", "date": "06-05-22"})
    sizes = products.size_matrix(src).collect()
    assert [(r["category"], r["S"], r["XL"], r["M"]) for r in sizes] == [("a", 0, 3, 0), ("b", 1, 0, 0)]
    assert rows(trends.weekday_matrix(src, ["a", "b"])) == [("Monday", 10.0, 0.0), ("Sunday", 0.0, 10.0)]


def test_value_counts_leave_out_nulls(spark):
    src = sales(spark, {"status": "x"}, {"status": "x"}, {"status": "a"}, {"status": None})
    assert rows(overview.counts_of(src, "status")) == [("x", 2, 2 / 3), ("a", 1, 1 / 3)]


def test_state_shares(spark):
    src = sales(spark, {"state": "a", "amount": "60"}, {"state": "b", "amount": "20"}, {"state": "c", "amount": "20"}, {"state": "APO", "amount": "900"})
    assert rows(geography.state_shares(src, 2)) == [("A", 60.0, 0.75, 0.6), ("B", 20.0, 0.25, 0.2)]
    assert one(insights.top_state_share(src, 2)) == {"top3_share_pct": 80.0}


def test_months_sort_by_calendar(spark):
    src = sales(spark, {"date": "04-01-22"}, {"date": "12-01-21"}, {"date": "01-05-22"})
    assert [r[0] for r in rows(trends.monthly(src))] == ["Dec 2021", "Jan 2022", "Apr 2022"]


def test_filters(spark):
    src = sales(
        spark,
        {"date": "04-01-22", "b2b": True},
        {"date": "04-30-22", "fulfilment": "Merchant"},
        {"date": "05-01-22", "b2b": None},
        {"date": None},
    )

    def count(**spec):
        return src.where(FilterSpec(**spec)).lines("category").count()

    april = {"date_from": dt.date(2022, 4, 1), "date_to": dt.date(2022, 4, 30)}
    assert count() == 4
    assert count(**april) == 2
    assert count(date_from=dt.date(2022, 4, 15)) == 4
    assert count(order_type="B2B") == 1 and count(order_type="B2C") == 2
    assert count(fulfilment="Merchant", **april) == 1 and count(category="Saree") == 0
    with pytest.raises(ValueError, match="order_type"):
        FilterSpec(order_type="b2b")


def test_duplicates(spark):
    same = {"order_id": None, "city": None}
    src = sales(spark, same, same, {"order_id": "x"}, {"order_id": "x", "qty": 9})
    assert one(quality.shape(src)) == {"n_rows": 4, "n_cols": 16, "dup_rows": 1, "dup_order_ids": 2}


def test_quartiles_and_outliers(spark):
    src = sales(spark, *[{"amount": str(a), "qty": q} for a, q in zip((1, 2, 3, 4, 10, 50), (0, 1, 1, 1, 2, None), strict=True)])
    got = {r["column"]: r for r in quality.describe(src).collect()}
    assert [got["amount"][c] for c in ("cnt", "p25", "p50", "p75", "std", "min", "max")] == [6, 2.25, 3.5, 8.5, 19.0438, 1.0, 50.0]
    out = {r["column"]: tuple(r)[1:] for r in quality.iqr_outliers(src).collect()}
    assert out == {"amount": (6.25, 1, 16.6667), "qty": (0.0, 2, 40.0)}
    box = {r["column"]: r.asDict() for r in quality.box_stats(src).collect()}
    assert (box["amount"]["whisker_hi"], box["amount"]["outliers"], box["qty"]["q1"]) == (10.0, 1, 1.0)


def test_histogram_of_one_value(spark):
    src = sales(spark, {"amount": "5"}, {"amount": "5"}, {"amount": None})
    got = rows(quality.amount_histogram(src, 4))
    assert [r[3] for r in got] == [2, 0, 0, 0] and got[0][1:3] == (5.0, 5.0)


def test_cardinality(spark):
    src = sales(spark, {"sku": "a"}, {"sku": "b"}, {"sku": None}, {"sku": "b"})
    exact = dict(rows(quality.cardinality(src)))
    assert exact["sku"] == 2 and exact["promotion_ids"] == 0 and len(exact) == 16
    assert dict(rows(quality.cardinality(src, approx=True))) == exact


def _days(n, value=lambda i: 10 * (i + 1), step=1):
    start = dt.date(2022, 4, 1)
    return [{"date": f"{start + dt.timedelta(days=i * step):%m-%d-%y}", "amount": str(value(i))} for i in range(n)]


def test_trend_leaves_out_the_middle_day(spark):
    got = one(insights.trend(sales(spark, *_days(15))))
    assert (got["first_half_avg"], got["second_half_avg"], got["direction"]) == (40.0, 120.0, "upward")
    assert got["trend_pct"] == 200.0


def test_trend_needs_fourteen_days_and_may_be_flat(spark):
    assert one(insights.trend(sales(spark, *_days(13))))["direction"] == "stable"
    assert one(insights.trend(sales(spark, *_days(14, lambda i: 5))))["direction"] == "stable"
    assert one(insights.trend(sales(spark, *_days(14, lambda i: 50 - i))))["direction"] == "downward"


def test_rates_have_their_own_denominators(spark):
    src = sales(
        spark,
        {"status": "Cancelled", "qty": 0, "promotion_ids": "p"},
        {"b2b": True, "promotion_ids": "p"},
        {"fulfilment": None, "amount": "30"},
        {"fulfilment": "Merchant", "amount": "0", "promotion_ids": "p"},
    )
    assert one(insights.rates(src)) == {"cancel_rate_pct": 25.0, "b2b_revenue_pct": 25.0, "amazon_fulfilled_pct": 50.0, "promotion_pct": 50.0}


def test_empty_input(spark):
    src = sales(spark, {"qty": 1}).where(FilterSpec(category="none"))
    kpi = one(overview.kpi_overview(src))
    assert (kpi["total_orders"], kpi["total_revenue"], kpi["top_category"]) == (0, 0.0, "N/A")
    for plan in (trends.daily, trends.top_skus, insights.sku_extremes, insights.category_stats_table, geography.state_shares, selection.calendar_of):
        assert rows(plan(src)) == []
    assert rows(demand.split_summary(demand.daily(src))) == []
    assert len(rows(insights.cards(src))) == 12
    assert one(insights.rates(src))["b2b_revenue_pct"] == 0.0
