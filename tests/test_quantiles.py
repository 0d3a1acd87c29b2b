"""Exact quantiles against brute force."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import lines_frame
from pyspark.sql import functions as F

from tillwright.operators.quantiles import exact_quantiles

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99, "p100": 1.0}


def quantiles(spark, cents):
    df = spark.createDataFrame([(c, c % 7) for c in cents], "cents long, n int").selectExpr("CAST(cents / 100 AS DECIMAL(18,2)) AS x", "n")
    return exact_quantiles(df, ["x", "n"], PROBS)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-(10**12), 10**12), min_size=1, max_size=60))
def test_any_values(spark, cents):
    got = quantiles(spark, cents)
    for name, p in PROBS.items():
        assert got["x"][name] == pytest.approx(np.quantile(np.array(cents) / 100, p), rel=1e-9, abs=1e-6)
        assert got["n"][name] == pytest.approx(np.quantile([c % 7 for c in cents], p))


def test_one_value_holding_most_rows_and_far_outliers(spark):
    cents = [500] * 3000 + list(range(1000)) + [9 * 10**17, -(9 * 10**17)]
    got = quantiles(spark, cents)
    for name in ("p25", "p50", "p75", "p99"):
        assert got["x"][name] == pytest.approx(np.quantile(np.array(cents) / 100, PROBS[name]))


def test_no_values(spark):
    df = spark.createDataFrame([(None, 3)], "x int, y int")
    assert exact_quantiles(df, ["x", "y"], {"p50": 0.5}) == {"x": {"p50": None}, "y": {"p50": 3.0}}


@pytest.mark.parametrize("values", [
    [19.99, 0.29, 1.15], [-1.5, 0.0, 2.5, -0.0, 1e-310, 5e-324, -3e-320], [1.7976931348623157e308, 2.0**-1022, 2.0**-1021 * 1.5, -1e300],
    [float(2**i) for i in range(-60, 60)] + [-(2.0**i) * (1 + 2.0**-52) for i in range(-60, 60)], [0.1 * i for i in range(-500, 700)],
])
def test_floating_numbers(spark, values):
    rows = [(v,) for v in [*values, float("nan"), None]]
    got = exact_quantiles(spark.createDataFrame(rows, "x double"), ["x"], PROBS)["x"]
    ordered = sorted(values)
    for name, p in PROBS.items():
        at = p * (len(ordered) - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
        assert got[name] == (low if at == int(at) else low + (high - low) * (at - int(at)))


def test_finer_decimals_and_whole_numbers(spark):
    df = spark.sql("SELECT CAST(x AS DECIMAL(18,4)) AS x, CAST(x * 10000 AS BIGINT) AS n FROM VALUES (1.2345D), (2.3456D), (-7.0001D) AS v(x)")
    got = exact_quantiles(df, ["x", "n"], {"p50": 0.5, "p100": 1.0, "p0": 0.0})
    assert got == {"x": {"p50": 1.2345, "p100": 2.3456, "p0": -7.0001}, "n": {"p50": 12345.0, "p100": 23456.0, "p0": -70001.0}}


def test_raw_audits_take_nan_as_missing(spark):
    from tillwright.plans import quality
    from tillwright.schema import RAW_TYPES, SalesSchema
    from tillwright.sources import FlatSales

    raw = lines_frame(spark, {"sku": "a"}, {"sku": "b"}, {"sku": "c"})
    raw = raw.withColumn("amount", F.expr("CASE sku WHEN 'a' THEN 19.99D WHEN 'b' THEN double('nan') END"))
    src = FlatSales.from_raw(raw, SalesSchema({r: r for r in RAW_TYPES}))
    assert {r["column"]: r["missing"] for r in quality.missing(src).collect()}["amount"] == 2
    assert {r["column"]: (r["cnt"], r["p50"]) for r in quality.describe(src).collect()}["amount"] == (1, 19.99)
