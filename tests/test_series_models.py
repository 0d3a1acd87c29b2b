"""Every series with a model of its own, against fits of one series at a time."""

import datetime as dt

import pytest
from conftest import rows, sales

from tillwright.plans.demand import DemandConfig, DemandModel, SeriesModels

SMALL = DemandConfig(trees=4, depth=3)


def history(category, n, step):
    days = [dt.date(2022, 4, 1) + dt.timedelta(days=i) for i in range(n)]
    return [{"date": f"{d:%m-%d-%y}", "category": category, "qty": 3 + (i * step) % 11} for i, d in enumerate(days)]


@pytest.fixture(scope="module")
def src(spark):
    lines = [*history("Kurta", 40, 7), *history("Set", 33, 5), *history("Brief", 9, 3)]
    return sales(spark, *lines)


@pytest.fixture(scope="module")
def each(src):
    return SeriesModels.fit(src, SMALL, parallelism=3)


def test_each_model_is_the_one_fitted_alone(src, each):
    assert sorted(each.models) == ["All", "Kurta", "Set"]
    want = {"metrics": [], "backtest": [], "forecast": [], "importance": []}
    for name in each.models:
        alone = DemandModel.fit(src, DemandConfig(series=name, trees=4, depth=3))
        for report, found in want.items():
            found += rows(getattr(alone, report)(**({"horizon": 7} if report == "forecast" else {})))
    for report, found in want.items():
        got = [r for r in rows(getattr(each, report)()) if r[0] != "Brief"]
        assert sorted(got, key=str) == sorted(found, key=str)


def test_series_without_enough_days_have_a_status(each):
    for report in (each.metrics(), each.backtest(), each.forecast(30)):
        (short,) = [r for r in report.collect() if r["series"] == "Brief"]
        assert short["status"] == "insufficient_data" and all(v is None for v in short[1:-1])
    assert len(rows(each.forecast(30).where("status = 'ok'"))) == 3 * 30


def test_no_series_at_all(spark):
    none = SeriesModels.fit(sales(spark, *history("Kurta", 5, 1)), SMALL)
    assert none.models == {} and none.importance().collect() == []
    assert [(r["series"], r["mae"], r["status"]) for r in none.metrics().orderBy("series").collect()] == [("All", None, "insufficient_data"), ("Kurta", None, "insufficient_data")]
    assert [r["status"] for r in none.forecast().collect()] == ["insufficient_data"] * 2
