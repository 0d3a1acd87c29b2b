"""Quantiles found inside a plan, against brute force."""

import os
import random

import pytest
from conftest import SF_DIR, one, rows, sales

from tillwright.catalog import QUARTILE_REPORTS, page
from tillwright.operators import rank_search
from tillwright.operators.rank_search import quantile_row
from tillwright.plans import quality
from tillwright.sources.star import StarSales

PROBS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def exact(values, p):
    ordered = sorted(values)
    at = p * (len(ordered) - 1)
    low, high = ordered[int(at)], ordered[min(int(at) + 1, len(ordered) - 1)]
    return low if at == int(at) or low == high else low + (high - low) * (at - int(at))


@pytest.fixture
def sketched(monkeypatch):
    """Sketches and enclosures at every size."""
    monkeypatch.setattr(rank_search, "FEW", 0)


def test_any_numbers(spark):
    values = [-1.5, 0.0, 2.5, -0.0, 1e-310, 5e-324, -3e-320, 1.7976931348623157e308, -1e300, 19.99]
    frame = spark.createDataFrame([(v,) for v in [*values, float("nan"), None]], "x double")
    frame = frame.selectExpr("x", "CAST(NULL AS INT) AS none", "CAST(round(x % 100, 2) AS DECIMAL(18,4)) AS d", "cast(x % 9 as decimal(30,2)) as wide")
    got = one(quantile_row(frame.where("x is null or not isnan(x)"), PROBS))
    assert got["x"].asDict() == {name: exact(values, p) for name, p in PROBS.items()}
    assert set(got["none"].asDict().values()) == {None}
    held = rows(frame.where("x is not null and not isnan(x)").selectExpr("cast(d as double)", "cast(wide as double)"))
    for i, name in enumerate(("d", "wide")):
        assert got[name].asDict() == pytest.approx({k: exact([r[i] for r in held], p) for k, p in PROBS.items()}, abs=1e-12)


def test_not_a_number(spark):
    with pytest.raises(TypeError):
        quantile_row(spark.createDataFrame([("a",)], "x string"), PROBS)


def test_enclosures_hold_at_size(spark, sketched):
    """One value that holds most rows, negatives, far outliers, and whole numbers that floating ones can't tell apart."""
    rng = random.Random(2)
    big = [2**62 + rng.randint(0, 5000) for _ in range(60_000)]
    some = [rng.choice([7, 7, 7, 7, rng.randint(-(10**6), 10**6)]) for _ in range(59_998)] + [9 * 10**17, -(9 * 10**17)]
    real = [rng.gauss(0, 1) * 10 ** rng.randint(-30, 30) for _ in range(60_000)]
    frame = spark.createDataFrame(list(zip(big, some, real, strict=True)), "big long, some long, real double").repartition(6)
    got = one(quantile_row(frame.selectExpr("big", "CAST(some AS DECIMAL(18,0)) AS some", "real"), PROBS))
    for name, p in PROBS.items():
        assert got["big"][name] == pytest.approx(exact(big, p), rel=1e-15) and got["some"][name] == exact(some, p)
        assert got["real"][name] == pytest.approx(exact(real, p), rel=1e-12)


def test_reports_on_sketches_agree(spark, monkeypatch):
    src = StarSales(spark, os.path.join(os.path.dirname(SF_DIR), "sf0.01"))
    whole = one(quality.quartiles(src))
    monkeypatch.setattr(rank_search, "FEW", 20_000)
    assert one(quality.quartiles(src)) == whole


def test_building_runs_no_job_and_a_page_searches_once(spark):
    src = StarSales(spark, SF_DIR)
    src.raw().columns  # reads the tables' schemas  # noqa: B018
    spark.sparkContext.setJobGroup("building", "reports while they are built")
    reports = {name: report for name, report in page("quality", src).items() if name in QUARTILE_REPORTS}
    alone = [report(src) for report in QUARTILE_REPORTS.values()]
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("building")
    spark.sparkContext.setJobGroup("running", "reports")
    assert not jobs and len(alone) == len(reports) == 3
    for name, report in reports.items():
        assert "InMemoryTableScan" in report._jdf.queryExecution().executedPlan().toString()
        assert rows(report) == rows(QUARTILE_REPORTS[name](src))


def test_no_numbers_at_all(spark):
    src = sales(spark, {"qty": None, "amount": None})
    assert [(r["column"], r["cnt"], r["p50"]) for r in quality.describe(src).collect()] == [("amount", 0, None), ("qty", 0, None)]
    assert [(r["n_outliers"], r["outlier_pct"]) for r in quality.iqr_outliers(src).collect()] == [(0, None), (0, None)]
    assert [r["q1"] for r in quality.box_stats(src).collect()] == [None, None]
