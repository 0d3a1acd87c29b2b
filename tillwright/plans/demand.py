"""Daily demand series, their features, tree models and day-by-day forecasts."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwright.fixed_values import LAGS, MIN_MODEL_DAYS, TOP_FEATURES, TRAIN_SHARE, WINDOWS
from tillwright.functions.numbers import half_even, ratio
from tillwright.operators.filters import ALL, SOLD
from tillwright.operators.rollups import table, total, union_all
from tillwright.session import settle

CALENDAR = ("day_of_week", "day_of_month", "week_of_year", "month", "is_weekend")
FEATURES = (
    *CALENDAR,
    *[f"lag_{k}" for k in LAGS],
    *[f"rolling_mean_{w}" for w in WINDOWS],
    *[f"rolling_std_{w}" for w in WINDOWS],
)
HISTORY = max(LAGS)
LEVEL = "series_level"
OVERALL_NAMES = re.compile(f"(category )*{ALL}")


# -- series and features ------------------------------------------------------------------------


def daily(src, fill_gaps: bool = False, series: str | None = None) -> DataFrame:
    """Daily quantity and revenue of sold lines, per category and for all categories together.

    The lines are scanned and grouped once, by category and date; the overall series is summed from
    those few rows. Asked for one ``series``, only its lines are read: the overall one needs no
    category, and a category goes down to its scan. Categories named like the overall series have
    "category" put before their name, once more than they bring along.
    """
    if series == ALL:
        sold = src.totals("date", rows=SOLD).where(F.col("date").isNotNull())
        days = sold.groupBy("date").agg(total("qty"), total("revenue", "rev")).select(F.lit(ALL).alias("series"), "date", "qty", "rev")
        return _without_gaps(days) if fill_gaps else days
    sold = src.totals("category", "date", rows=SOLD).where(F.col("date").isNotNull())
    if series is not None:
        sold = sold.where(F.col("category") == (series.removeprefix("category ") if OVERALL_NAMES.fullmatch(series) else series))
    per_category = sold.groupBy("category", "date").agg(total("qty"), total("revenue", "rev"))
    named = F.when(F.col("category").rlike(f"^{OVERALL_NAMES.pattern}$"), F.concat(F.lit("category "), "category")).otherwise(F.col("category"))
    if series is not None:
        days = per_category.select(named.alias("series"), "date", "qty", "rev")
        return _without_gaps(days) if fill_gaps else days
    both = per_category.groupingSets([["category", "date"], ["date"]], "category", "date").agg(
        F.when(F.grouping("category") == 1, ALL).otherwise(named).alias("series"), F.sum("qty").alias("qty"), F.sum("rev").alias("rev")
    )
    days = both.where(F.col("series").isNotNull()).select("series", "date", "qty", "rev")
    return _without_gaps(days) if fill_gaps else days


def _without_gaps(days: DataFrame) -> DataFrame:
    """Add the days between a series' first and last that it did not sell on."""
    spans = days.groupBy("series").agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return spans.join(days, ["series", "date"], "left").select(
        "series", "date", F.coalesce("qty", F.lit(0)).alias("qty"), F.coalesce("rev", F.lit(0)).alias("rev")
    )


def _calendar(date: str) -> list[str]:
    rules = ("weekday({0})", "dayofmonth({0})", "weekofyear({0})", "month({0})", "weekday({0}) >= 5")
    return [f"CAST({rule.format(date)} AS BIGINT) AS {name}" for name, rule in zip(CALENDAR, rules, strict=True)]


def _with_features(days: DataFrame) -> DataFrame:
    """All days with their features; features that reach before the series are null."""
    by_date = "PARTITION BY series ORDER BY date"
    columns = [f"lag(qty, {k}) OVER ({by_date}) AS lag_{k}" for k in LAGS]
    for w in WINDOWS:
        before = f"({by_date} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
        full = f"count(qty) OVER {before} = {w}"
        columns.append(f"CASE WHEN {full} THEN avg(qty) OVER {before} END AS rolling_mean_{w}")
        columns.append(f"CASE WHEN {full} THEN stddev_samp(qty) OVER {before} END AS rolling_std_{w}")
    return days.selectExpr("*", *_calendar("date"), *columns)


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)


def features(days: DataFrame) -> DataFrame:
    """The days whose features are all known."""
    return _with_features(days).where(_COMPLETE).select("series", "date", "qty", *FEATURES)


def _with_split(days: DataFrame) -> DataFrame:
    """Days with features, marked as training or test days; the first 80 % of complete days train."""
    series = Window.partitionBy("series")
    marked = _with_features(days).withColumn("complete", F.expr(_COMPLETE))
    counted = marked.withColumns(
        {
            "n_days": F.count(F.lit(1)).over(series),
            "n_rows": F.count_if("complete").over(series),
            "row": F.count_if("complete").over(series.orderBy("date")),
        }
    )
    return counted.withColumn("is_train", F.col("row") <= F.floor(F.col("n_rows") * F.lit(TRAIN_SHARE)))


def split_summary(days: DataFrame) -> DataFrame:
    """Sizes and boundary dates of the split per series, and whether there is enough to model."""
    d, train = F.col("date"), F.col("complete") & F.col("is_train")
    test = F.col("complete") & ~F.col("is_train")
    enough = F.max("n_days") >= MIN_MODEL_DAYS
    return (
        _with_split(days)
        .groupBy("series")
        .agg(
            F.count_if(train).alias("n_train"),
            F.count_if(test).alias("n_test"),
            F.max(F.when(train, d)).alias("last_train_date"),
            F.min(F.when(test, d)).alias("first_test_date"),
            F.when(enough, "ok").otherwise("insufficient_data").alias("status"),
        )
        .orderBy("series")
    )


def model_rows(days: DataFrame) -> DataFrame:
    """Complete days of the series that have enough of them, with split mark and training level."""
    level = F.avg(F.when(F.col("is_train"), F.col("qty"))).over(Window.partitionBy("series"))
    return (
        _with_split(days)
        .where((F.col("n_days") >= MIN_MODEL_DAYS) & F.col("complete"))
        .withColumn(LEVEL, level)
        .select("series", "date", F.col("qty").cast("double").alias("qty"), "is_train", LEVEL, *FEATURES)
    )


# -- scores -------------------------------------------------------------------------------------


def scores(predicted: DataFrame) -> DataFrame:
    """MAE, RMSE and R2 per series from ``actual`` and unrounded ``prediction``."""
    mean = F.avg("actual").over(Window.partitionBy("series"))
    error = F.col("actual") - F.col("prediction")
    sse, sst = F.sum(error * error), F.sum((F.col("actual") - F.col("mean")) * (F.col("actual") - F.col("mean")))
    return (
        predicted.withColumn("mean", mean)
        .groupBy("series")
        .agg(
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            F.when(F.count(F.lit(1)) >= 2, 1 - ratio(sse, sst)).alias("r2"),
        )
        .select("series", *[F.round(m, 4).alias(m) for m in ("mae", "rmse", "r2")])
    )


def naive_scores(days: DataFrame) -> DataFrame:
    """Scores of "same as seven observed days ago" on the test days."""
    test = model_rows(days).where(~F.col("is_train"))
    return scores(test.selectExpr("series", "qty AS actual", "CAST(lag_7 AS DOUBLE) AS prediction"))


# -- models -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Repeat:
    """Predicts a feature, such as the quantity of seven observed days ago; needs no fitting."""

    feature: str = "lag_7"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.col(self.feature).cast("double"))


@dataclass(frozen=True)
class DemandConfig:
    """What to fit.

    ``series`` names one series to model by itself; without it one pooled model learns from all
    series at once, told apart by their mean training quantity. ``refit`` trains on the test days
    too before forecasting. ``parity`` forecasts with population deviations although training used
    sample deviations. Forest trees grow as deep as the library allows unless ``depth`` says less;
    boosted ones have four levels. The bootstrap follows ``partitions``, so it is a fixed number.
    The model "naive" repeats the quantity of seven observed days ago.
    """

    model: str = "random_forest"
    series: str | None = ALL
    trees: int = 200
    depth: int | None = None
    bins: int = 256
    memory_mb: int = 256
    partitions: int = 8
    seed: int = 42
    refit: bool = False
    parity: bool = False

    def inputs(self) -> list[str]:
        return [*FEATURES] if self.series is not None else [*FEATURES, LEVEL]

    def estimator(self):
        common = {"featuresCol": "features", "labelCol": "qty", "seed": self.seed, "maxMemoryInMB": self.memory_mb, "maxBins": self.bins}
        if self.model == "random_forest":
            deepest = 30 if self.depth is None else self.depth
            return RandomForestRegressor(numTrees=self.trees, maxDepth=deepest, minInstancesPerNode=1, featureSubsetStrategy="all", **common)
        if self.model == "gradient_boosting":
            return GBTRegressor(maxIter=self.trees, maxDepth=self.depth or 4, stepSize=0.1, **common)
        raise ValueError(f"unknown model {self.model!r}")


@dataclass(frozen=True)
class DemandModel:
    """A fitted model with the rows it was fitted and tested on, and every series with its status.

    Without a series that has enough days nothing is fitted, and results hold the statuses alone.
    """

    config: DemandConfig
    fitted: Model | Repeat | None
    rows: DataFrame
    status: DataFrame

    @classmethod
    def fit(cls, src, config: DemandConfig = DemandConfig(), fill_gaps: bool = False) -> DemandModel:
        """Fit on the training days. Tree fitting passes over its input many times, so the daily
        rows are written out first; they number days times series, however many lines there are."""
        days = settle(daily(src, fill_gaps, config.series))
        rows = settle(model_rows(days))
        status = split_summary(days).select("series", "status")
        return cls(config, cls._fit_on(rows if config.refit else rows.where("is_train"), config), rows, status)

    @staticmethod
    def _fit_on(train: DataFrame, config: DemandConfig) -> Model | Repeat | None:
        if train.isEmpty():
            return None
        if config.model == "naive":
            return Repeat()
        vectors = _assembler(config).transform(train)
        # A fixed order of rows makes the bootstrap, and so the model, repeatable.
        spread = vectors.repartition(config.partitions, "series", "date")
        return config.estimator().fit(spread.sortWithinPartitions("series", "date").select("features", "qty"))

    def _tested(self) -> DataFrame:
        if self.fitted is None:
            return self.rows.selectExpr("series", "date", "qty AS actual", "CAST(NULL AS DOUBLE) AS prediction").limit(0)
        test = _assembler(self.config).transform(self.rows.where(~F.col("is_train")))
        return self.fitted.transform(test).select("series", "date", F.col("qty").alias("actual"), "prediction")

    def _every_series(self, results: DataFrame) -> DataFrame:
        """Results with the status of their series, and a row without results for the other series."""
        return self.status.join(results, "series", "left").select(*results.columns, "status")

    def backtest(self) -> DataFrame:
        """Actual and predicted quantity of the test days; predictions to one decimal."""
        tested = self._tested().select("series", "date", "actual", half_even(F.col("prediction"), 1).alias("predicted"))
        return self._every_series(tested)

    def metrics(self) -> DataFrame:
        return self._every_series(scores(self._tested()))

    def importance(self, top: int = TOP_FEATURES) -> DataFrame:
        """Most important features first; none without a fitted tree model."""
        label = self.config.series or "(pooled)"
        known = getattr(self.fitted, "featureImportances", None)
        weights = zip(self.config.inputs(), known.toArray().tolist() if known is not None else [], strict=known is not None)
        ranked = self.rows.sparkSession.createDataFrame(
            [(label, name, weight) for name, weight in weights], "series string, feature string, importance double"
        )
        return ranked.orderBy(F.desc("importance"), "feature").limit(top)

    def forecast(self, horizon: int = 7) -> DataFrame:
        """Predict day by day; every predicted day is history for the next.

        The state is one row per series with its last 14 quantities. A step is a projection over
        that row, so the steps need no shuffle. Quantities are to one decimal and not below zero.
        """
        return self._every_series(self._forecast(horizon)).orderBy("series", "date")

    def _forecast(self, horizon: int) -> DataFrame:
        if self.fitted is None:
            return self.rows.selectExpr("series", "date", "qty AS forecast_qty").limit(0)
        recent = Window.partitionBy("series").orderBy(F.desc("date"))
        last = self.rows.withColumn("back", F.row_number().over(recent)).where(F.col("back") <= HISTORY)
        pairs = F.array_sort(F.collect_list(F.struct("date", "qty")))
        state = last.groupBy("series").agg(
            F.max("date").alias("last_date"),
            F.max(LEVEL).alias(LEVEL),
            F.transform(pairs, lambda p: p["qty"]).alias("history"),
        ).withColumn("predicted", F.array().cast("array<double>"))
        assembler = _assembler(self.config)
        for step in range(1, horizon + 1):
            scored = self.fitted.transform(assembler.transform(_add_next_features(state, step, self.config.parity)))
            valued = scored.withColumn("value", F.greatest(F.lit(0.0), half_even(F.col("prediction"), 1)))
            state = valued.selectExpr(
                "series",
                "last_date",
                LEVEL,
                f"slice(array_append(history, value), -least({HISTORY}, size(history) + 1), {HISTORY}) AS history",
                "array_append(predicted, value) AS predicted",
            )
            if step % STEPS_PER_CUT == 0 and step < horizon:
                state = settle(state)
        return state.select("series", "last_date", F.posexplode("predicted").alias("ahead", "forecast_qty")).select(
            "series", F.date_add("last_date", F.col("ahead") + 1).alias("date"), "forecast_qty"
        )

    def combined(self, horizon: int = 7) -> DataFrame:
        """History and forecast in one frame."""
        past = self.rows.selectExpr("series", "date", "'history' AS kind", "qty")
        future = self._forecast(horizon).selectExpr("series", "date", "'forecast' AS kind", "forecast_qty AS qty")
        return past.unionByName(future)


@dataclass(frozen=True)
class SeriesModels:
    """A model of its own for every series, all fitted side by side.

    The lines are read once and the daily rows of all series written out. Each series is a fit of its
    own over its few rows, and ``parallelism`` fits run as Spark jobs at a time, so that one fit's small
    stages fill the cores that another leaves idle. A series' model is the one that ``DemandModel.fit``
    makes for it alone.
    """

    models: dict[str, DemandModel]
    status: DataFrame
    rows: DataFrame

    @classmethod
    def fit(cls, src, config: DemandConfig = DemandConfig(), fill_gaps: bool = False, parallelism: int = 4) -> SeriesModels:
        days = settle(daily(src, fill_gaps))
        rows = settle(model_rows(days))
        status = split_summary(days).select("series", "status")
        names = sorted(r["series"] for r in rows.select("series").distinct().collect())

        def of_series(name: str) -> DemandModel:
            own, mine = replace(config, series=name), rows.where(F.col("series") == name)
            train = mine if own.refit else mine.where("is_train")
            return DemandModel(own, DemandModel._fit_on(train, own), mine, status.where(F.col("series") == name))

        with ThreadPool(max(1, min(parallelism, len(names)))) as pool:
            fitted = pool.map(inheritable_thread_target(rows.sparkSession)(of_series), names, chunksize=1)
        return cls(dict(zip(names, fitted, strict=True)), status, rows)

    def _union(self, of: Callable[[DemandModel], DataFrame]) -> DataFrame:
        """The models' results together; without models, those of one that was not fitted."""
        models = list(self.models.values()) or [DemandModel(DemandConfig(), None, self.rows, self.status)]
        return union_all([of(model) for model in models])

    def _every_series(self, results: DataFrame) -> DataFrame:
        return self.status.join(results, "series", "left").select(*results.columns, "status")

    def backtest(self) -> DataFrame:
        """As of one model, for all series."""
        tested = self._union(DemandModel._tested)
        return self._every_series(tested.select("series", "date", "actual", half_even(F.col("prediction"), 1).alias("predicted")))

    def metrics(self) -> DataFrame:
        return self._every_series(scores(self._union(DemandModel._tested)))

    def forecast(self, horizon: int = 7) -> DataFrame:
        return self._every_series(self._union(lambda model: model._forecast(horizon))).orderBy("series", "date")

    def importance(self, top: int = TOP_FEATURES) -> DataFrame:
        """Most important features of each series' model."""
        return self._union(lambda model: model.importance(top)).orderBy("series", F.desc("importance"), "feature")


# Forecast steps whose projections are planned together before the state is written out.
STEPS_PER_CUT = 5


def _assembler(config: DemandConfig) -> VectorAssembler:
    return VectorAssembler(inputCols=config.inputs(), outputCol="features")


def _add_next_features(state: DataFrame, step: int, parity: bool) -> DataFrame:
    """Features of the day after ``history``; short histories fall back to their mean, and to no deviation."""
    total_of = "aggregate({0}, 0D, (a, x) -> a + x)"
    size, overall = "size(history)", f"{total_of.format('history')} / size(history)"
    # Counting from the front keeps the slice valid for histories shorter than the window.
    tails = {w: f"slice(history, greatest({size} - {w} + 1, 1), {w})" for w in WINDOWS}
    lags = [f"CASE WHEN {size} >= {k} THEN try_element_at(history, -{k}) ELSE {overall} END AS lag_{k}" for k in LAGS]
    means = [
        f"CASE WHEN {size} >= {w} THEN {total_of.format(tail)} / {w} ELSE {overall} END AS rolling_mean_{w}"
        for w, tail in tails.items()
    ]
    squares = "aggregate({0}, 0D, (a, x) -> a + (x - rolling_mean_{1}) * (x - rolling_mean_{1}))"
    deviations = [
        f"CASE WHEN {size} < {w} THEN 0D ELSE sqrt({squares.format(tail, w)} / {w if parity else w - 1}) END AS rolling_std_{w}"
        for w, tail in tails.items()
    ]
    dated = state.selectExpr("*", *_calendar(f"date_add(last_date, {step})"), *lags, *means)
    return dated.selectExpr("*", *deviations)


def daily_table(src) -> DataFrame:
    return table(daily(src))


def features_table(src) -> DataFrame:
    """Features as doubles to four decimals, for comparison across engines."""
    fine = [F.round(c, 4).alias(c) if c.startswith("rolling") else F.col(c) for c in FEATURES]
    return features(daily(src)).select("series", "date", "qty", *fine)

