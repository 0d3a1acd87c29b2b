"""The named queries, each a plan over a source of sales lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame

from tillwright.operators.filters import FilterSpec
from tillwright.plans import demand, fulfilment, geography, insights, overview, products, quality, selection, trends

Plan = Callable[..., DataFrame]

ALL_FOUR = FilterSpec(dt.date(1996, 1, 1), dt.date(1997, 12, 31), "ECONOMY", "Amazon", "B2B")
B2C_RANGE = FilterSpec(dt.date(1995, 3, 1), dt.date(1998, 8, 31), order_type="B2C")

# Forests of the named queries stop at eight levels; without a depth, they grow as deep as they can.
POOLED = demand.DemandConfig(series=None, depth=8)
OVERALL = demand.DemandConfig(depth=8)
CATEGORY = demand.DemandConfig(series="ECONOMY", depth=8)
EACH = demand.DemandConfig(trees=50, depth=8)
BOOSTED = demand.DemandConfig(model="gradient_boosting")
NAIVE = demand.DemandConfig(model="naive", series=None)
HORIZON = 14

REPORTS: dict[str, Plan] = {
    "facet_category": lambda src: selection.facet(src, "category"),
    "facet_fulfilment": lambda src: selection.facet(src, "fulfilment"),
    "facet_date_bounds": selection.date_bounds,
    "clean_sales": selection.clean_sales,
    "clean_report": selection.clean_report,
    "state_normalised": selection.states,
    "derived_calendar": selection.calendar_of,
    "filtered_sales": lambda src: selection.category_totals(src.where(ALL_FOUR)),
    "filter_b2c_range": lambda src: selection.category_totals(src.where(B2C_RANGE)),
    "kpi_overview": overview.kpi_overview,
    "daily_revenue": overview.daily_revenue,
    "category_revenue": overview.category_revenue,
    "vc_status": lambda src: overview.counts_of(src, "status"),
    "vc_fulfilment": lambda src: overview.counts_of(src, "fulfilment"),
    "vc_courier": lambda src: overview.counts_of(src, "courier_status"),
    "vc_service_level": lambda src: overview.counts_of(src, "service_level"),
    "vc_b2b": overview.order_type_counts,
    "size_qty": overview.size_quantities,
    "trend_daily": trends.daily,
    "trend_weekly": trends.weekly,
    "trend_monthly": trends.monthly,
    "category_summary": trends.category_summary,
    "top20_sku": trends.top_skus,
    "dow_category_heatmap": trends.weekday_category,
    "state_summary": geography.state_summary,
    "state_top20": geography.top_states,
    "state_share_top10": geography.state_shares,
    "city_top25": geography.top_cities,
    "daily_shipped_cancelled": fulfilment.daily_shipped_cancelled,
    "cancel_rate_category": fulfilment.cancel_rate_by_category,
    "top15_style": products.best_styles,
    "bottom15_style": products.worst_styles,
    "category_performance": products.category_performance,
    "category_size_heatmap": products.category_sizes,
    "top30_sku": products.top_sku_table,
    "dq_shape": quality.shape,
    "dq_missing": quality.missing,
    "dq_types": quality.types,
    "dq_inferred_types": quality.inferred_types,
    "dq_unique": quality.cardinality,
    "dq_unique_estimates": quality.estimates_checked,
    "dq_describe": quality.describe,
    "hist_amount": quality.amount_histogram,
    "hist_qty": quality.qty_histogram,
    "hist_amount_round": quality.amount_histogram_round,
    "hist_qty_round": quality.qty_histogram_round,
    "box_stats": quality.box_stats,
    "dq_iqr_outliers": quality.iqr_outliers,
    "dq_raw_states": quality.raw_states,
    "dq_status": quality.status_counts,
    "dq_zero_null": quality.zero_and_null,
    "fc_daily": demand.daily_table,
    "fc_features": demand.features_table,
    "fc_split": lambda src: demand.split_summary(demand.daily(src)),
    "fc_metrics_naive": lambda src: demand.naive_scores(demand.daily(src)),
    "fc_forecast_naive": lambda src: demand.DemandModel.fit(src, NAIVE)._forecast(HORIZON),
    "fc_forecast_naive_7": lambda src: demand.DemandModel.fit(src, NAIVE)._forecast(7),
    "fc_forecast_naive_30": lambda src: demand.DemandModel.fit(src, NAIVE)._forecast(30),
    "fc_combined_naive": lambda src: demand.DemandModel.fit(src, NAIVE).combined(HORIZON),
    "ins_category_stats": insights.category_stats_table,
    "ins_category_extremes": insights.category_extremes,
    "ins_sku_extremes": insights.sku_extremes,
    "ins_state_extremes": insights.state_extremes,
    "ins_trend": insights.trend,
    "ins_rates": insights.rates,
    "ins_weekday_extremes": insights.weekday_extremes,
    "ins_top3_state_share": insights.top_state_share,
    "ins_cards": insights.cards,
    "ins_recommendations": insights.recommendations,
}

# Queries that fit a model first; another engine cannot repeat them row for row.
MODELS: dict[str, Plan] = {
    "fc_backtest": lambda src: demand.DemandModel.fit(src, POOLED).backtest(),
    "fc_metrics": lambda src: demand.DemandModel.fit(src, POOLED).metrics(),
    "fc_metrics_boosted": lambda src: demand.DemandModel.fit(src, BOOSTED).metrics(),
    "fc_metrics_category": lambda src: demand.DemandModel.fit(src, CATEGORY).metrics(),
    "fc_backtest_boosted": lambda src: demand.DemandModel.fit(src, BOOSTED).backtest(),
    "fc_forecast_boosted": lambda src: demand.DemandModel.fit(src, BOOSTED).forecast(HORIZON),
    "fc_forecast": lambda src: demand.DemandModel.fit(src, POOLED).forecast(HORIZON),
    "fc_combined": lambda src: demand.DemandModel.fit(src, OVERALL).combined(HORIZON),
    "fc_metrics_each": lambda src: demand.SeriesModels.fit(src, OVERALL).metrics(),
    "fc_forecast_each": lambda src: demand.SeriesModels.fit(src, EACH).forecast(7),
    "fc_importance_each": lambda src: demand.SeriesModels.fit(src, EACH).importance(),
    "fc_importance": lambda src: demand.DemandModel.fit(src, OVERALL).importance(),
}

# Which named queries make up each report page.
PAGES: dict[str, tuple[str, ...]] = {
    "filters": ("facet_date_bounds", "facet_category", "facet_fulfilment"),
    "overview": ("kpi_overview", "daily_revenue", "category_revenue", "vc_status", "size_qty", "vc_fulfilment"),
    "quality": (
        "dq_shape", "dq_missing", "dq_types", "dq_unique", "dq_describe", "hist_amount", "hist_qty",
        "box_stats", "dq_iqr_outliers", "dq_raw_states", "dq_status", "dq_zero_null",
    ),
    "sales": (
        "trend_daily", "trend_weekly", "trend_monthly", "category_summary", "size_qty", "top20_sku",
        "dow_category_heatmap",
    ),
    "geography": ("state_summary", "state_top20", "state_share_top10", "city_top25"),
    "orders": (
        "vc_status", "vc_fulfilment", "vc_courier", "daily_shipped_cancelled", "vc_service_level", "vc_b2b",
        "cancel_rate_category",
    ),
    "products": ("top15_style", "bottom15_style", "category_performance", "category_size_heatmap", "top30_sku"),
    "insights": ("ins_cards", "ins_recommendations"),
}


# Reports that see the quartiles, and may be given a row of them.
QUARTILE_REPORTS: dict[str, Plan] = {"dq_describe": quality.describe, "box_stats": quality.box_stats, "dq_iqr_outliers": quality.iqr_outliers}


def page(name: str, src) -> dict[str, DataFrame]:
    """All reports of a page over one source; its quartiles are searched once, when the first report runs.

    Forecasts have settings of their own: see ``DemandModel``.
    """
    found = quality.quartiles(src).persist() if set(PAGES[name]) & set(QUARTILE_REPORTS) else None
    return {query: QUARTILE_REPORTS[query](src, found) if query in QUARTILE_REPORTS else REPORTS[query](src) for query in PAGES[name]}
