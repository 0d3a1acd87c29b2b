"""Demand features, split and forecasts."""

import datetime as dt

import pytest
from conftest import SF_DIR, one, rows, sales
from pyspark.sql import functions as F

from tillwright.plans import demand
from tillwright.plans.demand import DemandConfig, DemandModel
from tillwright.sources.star import StarSales

START = dt.date(2022, 4, 1)


def history(n, category="Kurta", skip=(), qty=lambda i: 5 + (i * 7) % 11):
    days = [START + dt.timedelta(days=i) for i in range(n + len(skip)) if i not in skip]
    return [{"date": f"{d:%m-%d-%y}", "category": category, "qty": qty(i)} for i, d in enumerate(days)]


@pytest.fixture(scope="module")
def star(spark):
    return StarSales(spark, SF_DIR)


@pytest.fixture(scope="module")
def pooled(star):
    return DemandModel.fit(star, DemandConfig(series=None, trees=10))


def test_daily_series(spark):
    src = sales(
        spark,
        {"category": "a", "qty": 2},
        {"category": "a", "qty": 0},
        {"category": None, "qty": 5},
        {"category": "All", "qty": 1},
        {"category": "b", "qty": 1, "date": None},
    )
    day = dt.date(2022, 4, 30)
    got = {(r["series"], r["date"]): (r["qty"], r["rev"]) for r in demand.daily_table(src).collect()}
    assert got == {("a", day): (2, 10.0), ("All", day): (8, 30.0), ("category All", day): (1, 10.0)}
    for series in ("a", "All", "category All"):
        alone = {(r["series"], r["date"]): (r["qty"], float(r["rev"])) for r in demand.daily(src, series=series).collect()}
        assert alone == {k: v for k, v in got.items() if k[0] == series}


def test_one_series_reads_only_its_lines(star):
    overall = demand.daily(star, series="All")._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" not in overall and "Expand" not in overall
    category = demand.daily(star, series="ECONOMY")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,ECONOMY)" in category and "Expand" not in category


@pytest.mark.parametrize(("n", "train", "test", "status"), [
    (13, 0, 0, "insufficient_data"), (14, 0, 0, "insufficient_data"), (15, 0, 1, "insufficient_data"), (16, 1, 1, "ok"), (30, 12, 4, "ok"),
])
def test_split(spark, n, train, test, status):
    got = {r["series"]: r for r in demand.split_summary(demand.daily(sales(spark, *history(n)))).collect()}
    assert set(got) == {"All", "Kurta"}
    assert (got["All"]["n_train"], got["All"]["n_test"], got["All"]["status"]) == (train, test, status)


def test_lags_count_observed_days_unless_gaps_are_filled(spark):
    src = sales(spark, *history(20, skip=(17,)))
    last = demand.features(demand.daily(src)).where("series = 'All'").orderBy(F.desc("date")).first()
    assert last["lag_3"] == 5 + (16 * 7) % 11
    filled = demand.features(demand.daily(src, fill_gaps=True)).where("series = 'All'").orderBy(F.desc("date")).first()
    assert filled["lag_3"] == 0


def test_features_by_hand(spark):
    src = sales(spark, *history(15, qty=lambda i: i + 1))
    got = one(demand.features(demand.daily(src)).where("series = 'All'"))
    assert got["date"] == START + dt.timedelta(days=14) and got["day_of_week"] == got["date"].weekday()
    assert (got["lag_1"], got["lag_3"], got["lag_7"], got["lag_14"]) == (14, 12, 8, 1)
    assert (got["rolling_mean_3"], got["rolling_std_3"], got["rolling_mean_14"]) == (13.0, 1.0, 7.5)


def test_no_feature_sees_its_own_or_later_days(spark):
    a = demand.features(demand.daily(sales(spark, *history(40))))
    changed = history(40)
    changed[-1]["qty"] = 999
    b = demand.features(demand.daily(sales(spark, *changed)))
    keep = ["series", "date", *demand.FEATURES]
    assert sorted(rows(a.select(keep))) == sorted(rows(b.select(keep)))


def test_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("b", 1.0, 1.0), ("c", 2.0, 1.0), ("c", 2.0, 3.0)], "series string, actual double, prediction double")
    got = {r["series"]: tuple(r)[1:] for r in demand.scores(df).collect()}
    assert got == {"a": (0.5, 0.7071, 0.5), "b": (0.0, 0.0, None), "c": (1.0, 1.0, None)}


def test_backtest_covers_the_test_days(star, pooled):
    split = {r["series"]: r for r in demand.split_summary(demand.daily(star)).collect()}
    back = {}
    for r in pooled.backtest().collect():
        if r["status"] != "ok":
            assert r["date"] is None and r["predicted"] is None
            continue
        back.setdefault(r["series"], []).append(r)
        assert round(r["predicted"], 1) == r["predicted"]
    for series, got in back.items():
        assert len(got) == split[series]["n_test"]
        assert min(r["date"] for r in got) == split[series]["first_test_date"] > split[series]["last_train_date"]
    assert set(back) == {s for s, r in split.items() if r["status"] == "ok"}


def test_forecast_rows(pooled):
    last = {r["series"]: r["d"] for r in pooled.rows.groupBy("series").agg(F.max("date").alias("d")).collect()}
    got = rows(pooled.forecast(7).where("status = 'ok'"))
    assert len(got) == 7 * len(last)
    for series, start in last.items():
        mine = [r for r in got if r[0] == series]
        assert [r[1] for r in mine] == [start + dt.timedelta(days=i) for i in range(1, 8)]
        assert all(r[2] >= 0 and round(r[2], 1) == r[2] for r in mine)


def test_same_seed_same_forecast(star, pooled):
    again = DemandModel.fit(star, DemandConfig(series=None, trees=10))
    assert rows(pooled.forecast(3)) == rows(again.forecast(3))


def test_forecast_does_not_depend_on_where_lineage_is_cut(pooled, monkeypatch):
    plain = rows(pooled.forecast(4))
    monkeypatch.setattr(demand, "STEPS_PER_CUT", 1)
    assert rows(pooled.forecast(4)) == plain


def test_next_features_match_training_features(spark, star):
    """Features of the next day, from the state, equal those of a training row for that day."""
    days = demand.daily(star)
    history_rows = demand.features(days).where("series = 'All'").orderBy("date").collect()
    target, past = history_rows[-1], history_rows[-15:-1]
    state = spark.createDataFrame(
        [("All", target["date"] - dt.timedelta(days=1), [float(r["qty"]) for r in past])], "series string, last_date date, history array<double>"
    )
    got = one(demand._add_next_features(state, 1, parity=False))
    for name in demand.FEATURES:
        assert got[name] == pytest.approx(float(target[name])), name


def test_short_history_falls_back_to_its_mean(spark):
    state = spark.createDataFrame([("a", START, [2.0, 4.0])], "series string, last_date date, history array<double>")
    got = one(demand._add_next_features(state, 1, parity=False))
    assert (got["lag_1"], got["lag_3"], got["lag_14"], got["rolling_mean_3"], got["rolling_std_7"]) == (4.0, 3.0, 3.0, 3.0, 0.0)


def test_parity_uses_population_deviation(spark):
    state = spark.createDataFrame([("a", START, [1.0, 2.0, 3.0, 4.0, 10.0, 50.0, 0.0])], "series string, last_date date, history array<double>")
    sample = one(demand._add_next_features(state, 1, parity=False))["rolling_std_3"]
    population = one(demand._add_next_features(state, 1, parity=True))["rolling_std_3"]
    assert population == pytest.approx(sample * (2 / 3) ** 0.5)


def test_shortest_series_that_can_be_modelled(spark):
    model = DemandModel.fit(sales(spark, *history(16)), DemandConfig(trees=3))
    assert len(rows(model.backtest())) == 1
    got = rows(model.forecast(30))
    assert len(got) == 30 and got[0][1] == START + dt.timedelta(days=16)


def test_too_short_a_series(spark):
    model = DemandModel.fit(sales(spark, *history(15)), DemandConfig(trees=3))
    assert rows(model.metrics()) == [("All", None, None, None, "insufficient_data")]
    assert rows(model.backtest()) == [("All", None, None, None, "insufficient_data")]
    assert rows(model.forecast(7)) == [("All", None, None, "insufficient_data")]
    assert rows(model.importance()) == [] and rows(model.combined()) == []


def test_a_short_series_beside_a_long_one(spark):
    src = sales(spark, *history(20), *history(5, category="Set"))
    model = DemandModel.fit(src, DemandConfig(series=None, trees=3))
    assert {r["series"]: r["status"] for r in model.metrics().collect()} == {"All": "ok", "Kurta": "ok", "Set": "insufficient_data"}


def test_the_naive_model_repeats_a_week(spark):
    model = DemandModel.fit(sales(spark, *history(30)), DemandConfig(model="naive"))
    last = [float(5 + (i * 7) % 11) for i in range(23, 30)]
    assert [r[2] for r in rows(model.forecast(10))] == last + last[:3]


def test_single_series_refit_boosting_and_outputs(star):
    model = DemandModel.fit(star, DemandConfig(model="gradient_boosting", series="ECONOMY", trees=3, refit=True))
    assert {r["series"] for r in model.metrics().collect()} == {"ECONOMY"}
    combined = model.combined(7)
    kinds = {r["kind"]: r["count"] for r in combined.groupBy("kind").count().collect()}
    assert kinds == {"history": model.rows.count(), "forecast": 7}
    weights = rows(model.importance())
    assert len(weights) == 12 and [w[2] for w in weights] == sorted((w[2] for w in weights), reverse=True)


def test_unknown_model(star):
    with pytest.raises(ValueError, match="unknown model"):
        DemandConfig(model="linear").estimator()
