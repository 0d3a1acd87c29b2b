"""Reports over random lines with gaps, zeros and ties, against plain pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from conftest import sales

from tillwright.catalog import PAGES, page
from tillwright.plans import fulfilment, geography, insights, overview, products, quality, trends


def random_lines(seed, n=400):
    rng = random.Random(seed)

    def maybe(values, gap=0.1):
        return None if rng.random() < gap else rng.choice(values)

    days = [dt.date(2022, 3, 28) + dt.timedelta(days=i) for i in range(24)]
    return [
        {
            "order_id": maybe([f"o{i}" for i in range(150)], 0.05),
            "date": None if rng.random() < 0.05 else f"{rng.choice(days):%m-%d-%y}",
            "status": maybe(["Cancelled", "Shipped", "Shipped - Returned", "Pending"]),
            "fulfilment": maybe(["Amazon", "Merchant"]),
            "style": maybe(["s1", "s2", "s3", "s4"]),
            "sku": maybe([f"k{i}" for i in range(9)]),
            "category": maybe(["Set", "Kurta", "Top", "Saree"]),
            "size": maybe(["S", "M", "XL", "Free", "Huge"]),
            "courier_status": maybe(["Shipped", "Unshipped"]),
            "qty": maybe([0, 1, 1, 2, 3, -1]),
            "amount": maybe(["0", "10.50", "99.99", "250.00", "-5.00"]),
            "city": maybe(["pune ", "PUNE", "Delhi", " "]),
            "state": maybe(["goa", " GOA", "rj", "Rajasthan", "APO", "Orissa"]),
            "promotion_ids": maybe(["p1", "p2"], 0.5),
            "b2b": maybe([True, False, False]),
        }
        for _ in range(n)
    ]


@pytest.fixture(scope="module", params=[1, 2])
def both(request, spark):
    records = random_lines(request.param)
    src = sales(spark, *records)
    src.raw_lines.cache()
    p = pd.DataFrame(records)
    p["date"] = pd.to_datetime(p["date"], format="%m-%d-%y").dt.date
    p["amount"] = p["amount"].astype(float)
    p["qty"] = p["qty"].astype(float)
    p["rev"] = p["amount"].where(p["qty"] > 0)
    p["cancelled"] = p["status"].fillna("").str.startswith("Cancelled").astype(int)
    names = {"RJ": "RAJASTHAN", "APO": "UNKNOWN", "ORISSA": "ODISHA"}
    p["state"] = p["state"].str.strip().str.upper().fillna("UNKNOWN").replace(names)
    p["city"] = p["city"].str.strip().str.upper().replace("", "UNKNOWN").fillna("UNKNOWN")
    return src, p


def table(df, key):
    """Report rows by key, floats rounded for comparison."""
    keys = [key] if isinstance(key, str) else key
    out = {}
    for r in df.collect():
        values = r.asDict()
        k = tuple(values.pop(x) for x in keys)
        out[k if len(keys) > 1 else k[0]] = {c: round(v, 4) if isinstance(v, float) else v for c, v in values.items()}
    return out


def grouped(p, keys, **measures):
    g = p.groupby(keys).apply(lambda d: pd.Series({name: f(d) for name, f in measures.items()}), include_groups=False)
    return {k: {c: round(v, 4) for c, v in row.items()} for k, row in g.to_dict("index").items()}


REV = {"rev": lambda d: d["rev"].sum()}
ORDERS = {"orders": lambda d: d["order_id"].count()}
QTY = {"qty": lambda d: d["qty"].sum()}


def test_categories(both):
    src, p = both
    assert table(trends.category_summary(src), "category") == grouped(p, "category", **REV, **ORDERS, **QTY)
    rates = grouped(p, "category", cancel_rate_pct=lambda d: np.round(d["cancelled"].sum() / d["order_id"].count() * 100, 1))
    got = table(fulfilment.cancel_rate_by_category(src), "category")
    assert {k: {"cancel_rate_pct": v["cancel_rate_pct"]} for k, v in got.items()} == rates
    perf = grouped(
        p, "category", **REV, **ORDERS, **QTY,
        cancel_rate_pct=lambda d: np.round(np.round(d["cancelled"].mean(), 2) * 100, 1),
        avg_row_revenue=lambda d: np.round(d["rev"].mean(), 2),
    )
    assert table(products.category_performance(src), "category") == perf


def test_trends(both):
    src, p = both
    assert table(trends.daily(src), "date") == grouped(p, "date", **ORDERS, **REV, **QTY)
    dated = p[p["date"].notna()].copy()
    dated["week"] = pd.to_datetime(dated["date"]).dt.strftime("%Y-W%V")
    assert table(trends.trend(src, "Weekly"), "year_week") == grouped(dated, "week", **ORDERS, **REV, **QTY)
    with pytest.raises(ValueError, match="granularity"):
        trends.trend(src, "Yearly")


def test_headline_figures(both):
    src, p = both
    (k,) = overview.kpi_overview(src).collect()
    per_order = p.groupby("order_id")["rev"].sum()
    assert k["total_orders"] == p["order_id"].nunique()
    assert k["total_revenue"] == pytest.approx(p["rev"].sum())
    assert k["total_qty"] == p.loc[p["qty"] > 0, "qty"].sum()
    assert k["avg_order_value"] == pytest.approx(per_order.mean(), abs=1e-4)
    assert k["cancel_rate_pct"] == pytest.approx(p["cancelled"].mean() * 100, abs=1e-4)
    assert k["top_category"] == p.groupby("category")["rev"].sum().round(2).idxmax()


def test_places(both):
    src, p = both
    known = p[p["state"] != "UNKNOWN"]
    assert table(geography.state_summary(src), "state") == grouped(known, "state", **REV, **ORDERS, **QTY)
    assert table(geography.top_cities(src), "city") == grouped(p[p["city"] != "UNKNOWN"], "city", **REV, **ORDERS)


def test_products(both):
    src, p = both
    earning = p[p["rev"] > 0]
    assert table(products.top_sku_table(src, 10**6), ["sku", "style", "category"]) == grouped(
        earning, ["sku", "style", "category"], **REV, **QTY, **ORDERS
    )
    priced = p[p["rev"].notna()]
    assert table(trends.top_skus(src, 10**6), ["sku", "category"]) == grouped(priced, ["sku", "category"], **REV, **QTY, **ORDERS)


def test_value_counts(both):
    src, p = both
    for role in ("status", "fulfilment"):
        got = {r["value"]: (r["cnt"], r["share"]) for r in overview.counts_of(src, role).collect()}
        counts = p[role].value_counts()
        assert got == {v: (c, pytest.approx(c / counts.sum())) for v, c in counts.items()}


def test_category_insights(both):
    src, p = both
    earning = p[p["rev"] > 0]
    stats = grouped(earning, "category", rev=lambda d: np.round(d["rev"].sum(), 1), **QTY, **ORDERS, avg_row_revenue=lambda d: np.round(d["rev"].mean(), 1))
    rates = (p.groupby("category")["cancelled"].mean() * 100).round(1)
    for category, row in stats.items():
        row["cancel_rate_pct"] = rates[category]
    assert table(insights.category_stats(src), "category") == stats


def test_rates(both):
    src, p = both
    (r,) = insights.rates(src).collect()
    earning = p[p["rev"] > 0]
    assert r["b2b_revenue_pct"] == pytest.approx(earning.loc[earning["b2b"] == True, "rev"].sum() / earning["rev"].sum() * 100, abs=1e-4)  # noqa: E712
    assert r["amazon_fulfilled_pct"] == pytest.approx((p["fulfilment"] == "Amazon").mean() * 100, abs=1e-4)
    assert r["promotion_pct"] == pytest.approx(earning["promotion_ids"].notna().mean() * 100, abs=1e-4)


def test_trend_halves(both):
    src, p = both
    (r,) = insights.trend(src).collect()
    days = p[p["rev"] > 0].groupby("date")["rev"].sum().sort_index()
    half = len(days) // 2
    first, second = days.head(half).mean(), days.tail(half).mean()
    assert r["first_half_avg"] == pytest.approx(first, abs=1e-4)
    assert r["trend_pct"] == pytest.approx((second - first) / first * 100, abs=1e-3)


def test_audit(both):
    src, p = both
    raw = src.raw_lines.toPandas()
    (shape,) = quality.shape(src).collect()
    assert tuple(shape) == (len(raw), raw.shape[1], raw.duplicated().sum(), raw["order_id"].duplicated().sum())
    absent = raw.isna().sum()
    got = {r["column"]: (r["missing"], r["missing_pct"]) for r in quality.missing(src).collect()}
    assert got == {c: (n, round(n / len(raw) * 100, 2)) for c, n in absent.items() if n}
    assert {r["column"]: r["n_unique"] for r in quality.cardinality(src).collect()} == raw.nunique().to_dict()
    numbers = {c: raw[c].dropna().astype(float) for c in ("qty", "amount")}
    for r in quality.describe(src).collect():
        d = numbers[r["column"]].describe()
        assert [r["cnt"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]] == pytest.approx(d.tolist(), abs=1e-4)
    for r in quality.iqr_outliers(src).collect():
        s = numbers[r["column"]]
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        assert r["n_outliers"] == ((s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))).sum()


def test_pages_answer(both):
    src, _ = both
    for name in PAGES:
        for df in page(name, src).values():
            assert df.columns
