"""Physical plans: what is read, joined and shuffled."""

import datetime as dt
import re

import pytest
from conftest import SF_DIR

from tillwright.catalog import REPORTS
from tillwright.operators.filters import FilterSpec
from tillwright.plans import overview, trends
from tillwright.sources import FlatSales
from tillwright.sources.star import StarSales


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(plan):
    return set(re.findall(r"/(\w+)\.parquet", plan))


@pytest.mark.parametrize("name", REPORTS)
def test_no_pairing_joins_and_no_python(spark, shuffle_joins, name):
    plan = plan_of(REPORTS[name](StarSales(spark, SF_DIR)))
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert forbidden not in plan


def test_only_needed_tables_and_columns_are_read(spark):
    plan = plan_of(overview.category_revenue(StarSales(spark, SF_DIR)))
    assert tables(plan) == {"lineitem", "part"}
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in read.split(",")} == {"l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"}
    assert tables(plan_of(overview.counts_of(StarSales(spark, SF_DIR), "fulfilment"))) == {"lineitem"}


def test_date_filter_reaches_the_scan(spark):
    spec = FilterSpec(dt.date(1996, 1, 1), dt.date(1996, 12, 31))
    plan = plan_of(trends.category_summary(StarSales(spark, SF_DIR).where(spec)))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(o_orderdate", plan)


def test_lines_are_summed_before_a_join_that_shuffles(spark, shuffle_joins):
    plan = plan_of(trends.daily(StarSales(spark, SF_DIR)))
    assert "partial_sum" in plan.split("SortMergeJoin")[1]


def test_lines_are_not_shuffled_for_small_dimensions(spark):
    plan = plan_of(StarSales(spark, SF_DIR).lines("date"))
    assert "SortMergeJoin" not in plan and "hashpartitioning(l_" not in plan


@pytest.mark.parametrize("limit", ["-1", "10m"])
@pytest.mark.parametrize("role", ["state", "city", "category", "date", "order_key"])
def test_lines_are_lines_whatever_is_broadcast(spark, role, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    star = StarSales(spark, SF_DIR)
    try:
        assert star.lines(role).count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
        totals = plan_of(star.totals(role))
        assert ("partial_sum" in totals) == (role != "order_key")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_flat_sources_have_a_row_per_line_too(spark):
    star = StarSales(spark, SF_DIR)
    flat = FlatSales(star.lines("state", "order_id", "date"))
    assert flat.lines("state").count() == flat.totals("order_key").count() == star.lines("state").count()


def test_orders_are_summed_where_the_join_left_them(spark, shuffle_joins):
    plan = plan_of(overview.kpi_overview(StarSales(spark, SF_DIR)))
    assert plan.count("hashpartitioning(l_orderkey") == 1 and "CAST(l_orderkey AS STRING)" not in plan


def test_top_k_does_not_sort_everything(spark):
    plan = plan_of(trends.top_skus(StarSales(spark, SF_DIR)))
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def _scans(node, seen):
    """Scans that a plan really ran: what is reused, exchange or subquery, counts once."""
    name, found = node.nodeName(), []
    if name.startswith("AdaptiveSparkPlan"):
        return _scans(node.executedPlan(), seen)
    if name.startswith("Reused"):
        return found
    if "QueryStage" in name:
        return _scans(node.plan(), seen)
    if name.startswith(("Scan parquet", "FileScan")):
        found.append(re.search(r"/(\w+)\.parquet", node.simpleString(10_000))[1])
    subqueries, children = node.subqueries(), node.children()
    for subquery in (subqueries.apply(i) for i in range(subqueries.size())):
        if not subquery.nodeName().startswith("Reused") and subquery.name() not in seen:
            seen.add(subquery.name())
            found += _scans(subquery.child(), seen)
    for child in (children.apply(i) for i in range(children.size())):
        found += _scans(child, seen)
    return found


@pytest.mark.parametrize("name", ["ins_cards", "ins_recommendations"])
def test_insights_read_the_lines_once_per_join_path(spark, shuffle_joins, name):
    """Categories with their orders, SKUs, and everything about states, days and rates; no job while building."""
    src = StarSales(spark, SF_DIR)
    src.raw().columns  # reads the tables' schemas  # noqa: B018
    spark.sparkContext.setJobGroup(f"building {name}", "insights while they are built")
    df = REPORTS[name](src)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"building {name}")
    spark.sparkContext.setJobGroup("running", "insights")
    assert not jobs
    df.collect()
    read = _scans(df._jdf.queryExecution().executedPlan(), set())
    assert read.count("lineitem") <= 3 and read.count("customer") <= 1
