"""The named queries once more as plain SQL for another engine, written from their definitions.

Every statement starts from the same two views: ``raw`` lines and cleaned ``sales`` lines.
"""

from __future__ import annotations


_RAW = """
raw AS (
  SELECT
    CAST(l_orderkey AS VARCHAR) AS order_id,
    CAST(o_orderdate AS DATE) AS date,
    CASE WHEN l_returnflag = 'R' AND o_orderstatus = 'F' THEN 'Cancelled'
         WHEN o_orderstatus = 'P' THEN 'Pending'
         WHEN l_returnflag = 'A' THEN 'Shipped - Delivered to Buyer'
         ELSE 'Shipped' END AS status,
    CASE WHEN l_linestatus = 'F' THEN 'Amazon' ELSE 'Merchant' END AS fulfilment,
    o_orderpriority AS service_level,
    p_brand AS style,
    CAST(l_partkey AS VARCHAR) AS sku,
    p_type AS category,
    CASE p_size % 12 WHEN 0 THEN 'XS' WHEN 1 THEN 'S' WHEN 2 THEN 'M' WHEN 3 THEN 'L' WHEN 4 THEN 'XL'
         WHEN 5 THEN 'XXL' WHEN 6 THEN '3XL' WHEN 7 THEN '4XL' WHEN 8 THEN '5XL' WHEN 9 THEN '6XL'
         WHEN 10 THEN 'Free' ELSE 'Other' END AS size,
    CASE WHEN l_linenumber = 6 THEN NULL WHEN l_returnflag = 'R' THEN 'Cancelled' ELSE 'Shipped' END AS courier_status,
    CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS INT) END AS qty,
    CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount,
    CASE WHEN l_linenumber = 5 THEN NULL ELSE s_name END AS ship_city,
    CASE n_nationkey WHEN 24 THEN NULL WHEN 0 THEN ' rj ' WHEN 1 THEN 'Rajsthan' WHEN 2 THEN 'RAJASTHAN'
         WHEN 3 THEN 'APO' ELSE lower(n_name) END AS ship_state,
    CASE WHEN l_discount = 0 THEN NULL ELSE 'PROMO' END AS promotion_ids,
    c_mktsegment = 'MACHINERY' AS b2b
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""

# Written out here, so that a wrong entry in the engine's own lists shows.
_ALIASES = """WHEN 'RJ' THEN 'RAJASTHAN' WHEN 'PB' THEN 'PUNJAB' WHEN 'NL' THEN 'NAGALAND' WHEN 'AR' THEN 'ARUNACHAL PRADESH'
  WHEN 'RAJSHTHAN' THEN 'RAJASTHAN' WHEN 'RAJSTHAN' THEN 'RAJASTHAN' WHEN 'ORISSA' THEN 'ODISHA' WHEN 'PONDICHERRY' THEN 'PUDUCHERRY'
  WHEN 'NEW DELHI' THEN 'DELHI' WHEN 'PUNJAB/MOHALI/ZIRAKPUR' THEN 'PUNJAB' WHEN 'APO' THEN 'UNKNOWN'"""
_SIZE_ORDER = "('XS', 0), ('S', 1), ('M', 2), ('L', 3), ('XL', 4), ('XXL', 5), ('3XL', 6), ('4XL', 7), ('5XL', 8), ('6XL', 9), ('Free', 10)"
_SIZE_LIST = "'XS', 'S', 'M', 'L', 'XL', 'XXL', '3XL', '4XL', '5XL', '6XL', 'Free'"
_WEEK = "'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'"

_SALES = f"""
sales AS (
  SELECT * REPLACE (
      coalesce(courier_status, 'Unknown') AS courier_status,
      coalesce(promotion_ids, 'None') AS promotion_ids),
    CASE coalesce(nullif(upper(trim(ship_state)), ''), 'UNKNOWN') {_ALIASES}
         ELSE coalesce(nullif(upper(trim(ship_state)), ''), 'UNKNOWN') END AS state,
    coalesce(nullif(upper(trim(ship_city)), ''), 'UNKNOWN') AS city,
    CASE WHEN starts_with(status, 'Cancelled') THEN 1 ELSE 0 END AS is_cancelled,
    CASE WHEN starts_with(status, 'Shipped') THEN 1 ELSE 0 END AS is_shipped,
    CAST(b2b AS INT) AS is_b2b,
    dayname(date) AS day_of_week,
    CASE WHEN amount IS NOT NULL AND qty > 0 THEN amount END AS revenue
  FROM raw
)"""

REV = "CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS rev"
ORDERS = "count(order_id) AS orders"
QTY = "CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty"


def _raw(sql: str) -> str:
    return f"WITH {_RAW.strip()}\n{sql.strip()}"


def _sales(sql: str, *views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in (_RAW, _SALES, *views)) + "\n" + sql.strip()


def _even(x: str, digits: int) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"(round_even(({x})::DOUBLE * {scale}, 0) / {scale})"


def _value_counts(role: str, label: str | None = None) -> str:
    return _sales(f"""
SELECT {label or role} AS value, count(*) AS cnt, count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE AS share
FROM sales WHERE {role} IS NOT NULL GROUP BY {role}""")


def _numbers(sold_only: bool) -> str:
    qty = "CASE WHEN qty > 0 THEN qty END" if sold_only else "qty"
    return f"""
numbers AS (
  SELECT 'qty' AS "column", CAST({qty} AS DOUBLE) AS x FROM raw
  UNION ALL SELECT 'amount', CAST(amount AS DOUBLE) FROM raw),
quartiles AS (
  SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS q2, quantile_cont(x, 0.75) AS q3
  FROM numbers WHERE x IS NOT NULL GROUP BY "column"),
fenced AS (
  SELECT n."column", x, q1, q2, q3, x BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) AS inside
  FROM numbers n JOIN quartiles q ON n."column" = q."column" WHERE x IS NOT NULL)"""


def _histogram(column: str, bins: int, where: str) -> str:
    return f"""
WITH {_RAW.strip()},
xs AS (SELECT CAST({column} AS DOUBLE) AS x FROM raw WHERE {column} IS NOT NULL AND {where}),
bounds AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / {bins}.0::DOUBLE AS w FROM xs),
counted AS (
  SELECT CAST(least(floor((x - lo) / w), {bins - 1}) AS BIGINT) AS bin, count(*) AS cnt FROM xs, bounds GROUP BY 1)
SELECT CAST(b.bin AS BIGINT) AS bin, round(lo + b.bin::DOUBLE * w, 6) AS lo, round(lo + (b.bin + 1)::DOUBLE * w, 6) AS hi,
  coalesce(cnt, 0) AS cnt
FROM range({bins}) AS b(bin) CROSS JOIN bounds LEFT JOIN counted c ON c.bin = b.bin"""


def _round_histogram(column: str, most: int, where: str) -> str:
    """Steps of 1, 2 and 5 times powers of ten, all tried, the smallest that leaves few enough bins."""
    return f"""
WITH {_RAW.strip()},
xs AS (SELECT CAST({column} AS DOUBLE) AS x FROM raw WHERE {column} IS NOT NULL AND {where}),
ends AS (SELECT min(x) AS lo, max(x) AS hi FROM xs),
steps AS (
  SELECT CASE WHEN e < 0 THEN m::DOUBLE / power(10.0::DOUBLE, -e) ELSE m::DOUBLE * power(10.0::DOUBLE, e) END AS s
  FROM (VALUES (1), (2), (5)) AS ms(m) CROSS JOIN range(-8, 12) AS es(e)),
chosen AS (
  SELECT lo, hi, CASE WHEN hi > lo THEN min(s) ELSE 1.0::DOUBLE END AS step FROM ends, steps
  WHERE hi = lo OR floor(hi / s) - floor(lo / s) + 1 <= {most} GROUP BY lo, hi),
counted AS (SELECT floor(x / step) AS place, count(*) AS cnt FROM xs, chosen GROUP BY 1)
SELECT CAST(b.bin AS BIGINT) AS bin, round((floor(lo / step) + b.bin) * step, 6) AS lo, round((floor(lo / step) + b.bin + 1) * step, 6) AS hi,
  coalesce(cnt, 0) AS cnt
FROM range({most}) AS b(bin) CROSS JOIN chosen LEFT JOIN counted c ON c.place = floor(lo / step) + b.bin
WHERE floor(lo / step) + b.bin <= floor(hi / step)"""


_EARNING = """
earning AS (SELECT * FROM sales WHERE revenue > 0)"""

_DAYS = """
by_category AS (
  SELECT category, date, sum(qty) AS qty, coalesce(sum(revenue), 0) AS rev
  FROM sales WHERE qty > 0 AND date IS NOT NULL GROUP BY category, date),
days AS (
  SELECT CASE WHEN regexp_full_match(category, '(category )*All') THEN 'category ' || category ELSE category END AS series, date, qty, rev
  FROM by_category WHERE category IS NOT NULL
  UNION ALL SELECT 'All', date, sum(qty), sum(rev) FROM by_category GROUP BY date)"""


def _windowed() -> str:
    parts = [f"lag(qty, {k}) OVER w AS lag_{k}" for k in (1, 3, 7, 14)]
    for n in (3, 7, 14):
        frame = f"(PARTITION BY series ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
        parts.append(f"CASE WHEN count(qty) OVER {frame} = {n} THEN avg(qty) OVER {frame} END AS rolling_mean_{n}")
        parts.append(f"CASE WHEN count(qty) OVER {frame} = {n} THEN stddev_samp(qty) OVER {frame} END AS rolling_std_{n}")
    return ",\n    ".join(parts)


# A day is complete once fourteen earlier days are known; all other features need fewer.
_SPLIT = f"""
windowed AS (
  SELECT series, date, CAST(qty AS BIGINT) AS qty,
    {_windowed()},
    count(*) OVER (PARTITION BY series) AS n_days
  FROM days WINDOW w AS (PARTITION BY series ORDER BY date)),
complete AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS pos,
    floor(0.8::DOUBLE * count(*) OVER (PARTITION BY series)) AS cut
  FROM windowed WHERE lag_14 IS NOT NULL)"""

_CATEGORY_STATS = f"""
stats AS (
  SELECT e.category, {_even("rev", 1)} AS rev, qty, orders, {_even("rev / n", 1)} AS avg_row_revenue,
    {_even("cancel_rate", 1)} AS cancel_rate_pct
  FROM (SELECT category, CAST(sum(revenue) AS DOUBLE) AS rev, CAST(sum(qty) AS BIGINT) AS qty, count(order_id) AS orders,
          count(*)::DOUBLE AS n
        FROM earning WHERE category IS NOT NULL GROUP BY category) e
  LEFT JOIN (SELECT category, sum(is_cancelled)::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE AS cancel_rate
             FROM sales GROUP BY category) c ON e.category = c.category)"""

_SKUS = """
skus AS (
  SELECT sku, category, sum(revenue) AS rev FROM earning
  WHERE sku IS NOT NULL AND category IS NOT NULL GROUP BY sku, category),
sku_ends AS (
  SELECT 'best' AS which, * FROM (SELECT * FROM skus ORDER BY rev DESC, sku, category LIMIT 1)
  UNION ALL SELECT 'worst', * FROM (SELECT * FROM skus ORDER BY rev, sku, category LIMIT 1))"""

_STATES = """
states AS (SELECT state, sum(revenue) AS rev, count(order_id) AS orders FROM earning WHERE state <> 'UNKNOWN' GROUP BY state),
state_ends AS (
  SELECT 'best' AS which, * FROM (SELECT * FROM states ORDER BY rev DESC, state LIMIT 1)
  UNION ALL SELECT 'worst', * FROM (SELECT * FROM states ORDER BY rev, state LIMIT 1)),
state_share AS (
  SELECT round((SELECT sum(rev) FROM (SELECT rev FROM states ORDER BY rev DESC, state LIMIT 3))::DOUBLE
    / sum(rev)::DOUBLE * 100.0::DOUBLE, 4) AS top3_share_pct FROM states)"""

_WEEKDAYS = """
weekdays AS (SELECT day_of_week, sum(revenue) AS rev FROM earning WHERE date IS NOT NULL GROUP BY day_of_week),
weekday_ends AS (
  SELECT 'best' AS which, * FROM (SELECT * FROM weekdays ORDER BY rev DESC, day_of_week LIMIT 1)
  UNION ALL SELECT 'worst', * FROM (SELECT * FROM weekdays ORDER BY rev, day_of_week LIMIT 1))"""

_TREND = """
daily_rev AS (SELECT date, sum(revenue)::DOUBLE AS rev FROM earning WHERE date IS NOT NULL GROUP BY date),
ordered AS (SELECT rev, row_number() OVER (ORDER BY date) AS pos, count(*) OVER () AS n FROM daily_rev),
halves AS (
  SELECT avg(rev) FILTER (WHERE pos <= n // 2) AS a, avg(rev) FILTER (WHERE pos > n - n // 2) AS b
  FROM ordered WHERE n >= 14),
trend AS (
  SELECT round(a, 4) AS first_half_avg, round(b, 4) AS second_half_avg,
    round(coalesce((b - a) / nullif(a, 0) * 100, 0), 4) AS trend_pct,
    CASE WHEN coalesce((b - a) / nullif(a, 0), 0) > 0 THEN 'upward'
         WHEN coalesce((b - a) / nullif(a, 0), 0) < 0 THEN 'downward' ELSE 'stable' END AS direction
  FROM halves)"""

_RATES = """
rates AS (
  SELECT
    round(sum(is_cancelled)::DOUBLE / count(*) * 100, 4) AS cancel_rate_pct,
    round(coalesce(sum(revenue) FILTER (WHERE revenue > 0 AND b2b), 0)::DOUBLE
      / (sum(revenue) FILTER (WHERE revenue > 0))::DOUBLE * 100, 4) AS b2b_revenue_pct,
    round(count(*) FILTER (WHERE fulfilment = 'Amazon')::DOUBLE / count(*) * 100, 4) AS amazon_fulfilled_pct,
    round(count(*) FILTER (WHERE revenue > 0 AND promotion_ids <> 'None')::DOUBLE
      / count(*) FILTER (WHERE revenue > 0) * 100, 4) AS promotion_pct
  FROM sales)"""

_FACTS = (_EARNING, _CATEGORY_STATS, _SKUS, _STATES, _WEEKDAYS, _TREND, _RATES, f"""
facts AS (
  SELECT
    top.category AS top_cat, format('{{:,.2f}}', {_even("top.rev / 1e6", 2)}) AS top_cat_m,
    bad.category AS bad_cat, format('{{:,.1f}}%', bad.cancel_rate_pct) AS bad_cat_pct,
    best_sku.sku AS best_sku, best_sku.category AS best_sku_cat, format('{{:,.0f}}', {_even("best_sku.rev", 0)}) AS best_sku_rev,
    worst_sku.sku AS worst_sku, format('{{:,.0f}}', {_even("worst_sku.rev", 0)}) AS worst_sku_rev,
    upper(best_state.state[1]) || lower(best_state.state[2:]) AS best_state,
    format('{{:,.2f}}', {_even("best_state.rev / 1e6", 2)}) AS best_state_m, format('{{:,}}', best_state.orders) AS best_state_orders,
    upper(worst_state.state[1]) || lower(worst_state.state[2:]) AS worst_state,
    best_day.day_of_week AS best_day, worst_day.day_of_week AS worst_day,
    direction, trend_pct, format('{{:,.1f}}%', {_even("trend_pct", 1)}) AS trend_text,
    cancel_rate_pct AS cancel, b2b_revenue_pct AS b2b, promotion_pct AS promo, top3_share_pct AS top3,
    format('{{:,.1f}}%', {_even("rates.cancel_rate_pct", 1)}) AS cancel_text, format('{{:,.1f}}%', {_even("b2b_revenue_pct", 1)}) AS b2b_text,
    format('{{:,.1f}}%', {_even("amazon_fulfilled_pct", 1)}) AS platform_text, format('{{:,.1f}}%', {_even("promotion_pct", 1)}) AS promo_text,
    format('{{:,.1f}}%', {_even("top3_share_pct", 1)}) AS share_text
  FROM (SELECT * FROM stats ORDER BY rev DESC, category LIMIT 1) top,
    (SELECT category, cancel_rate_pct FROM stats ORDER BY cancel_rate_pct DESC, category LIMIT 1) AS bad(category, cancel_rate_pct),
    (SELECT * FROM sku_ends WHERE which = 'best') best_sku, (SELECT * FROM sku_ends WHERE which = 'worst') worst_sku,
    (SELECT * FROM state_ends WHERE which = 'best') best_state, (SELECT * FROM state_ends WHERE which = 'worst') worst_state,
    (SELECT * FROM weekday_ends WHERE which = 'best') best_day, (SELECT * FROM weekday_ends WHERE which = 'worst') worst_day,
    trend, rates, state_share)""".replace("cancel_rate_pct AS cancel,", "rates.cancel_rate_pct AS cancel,"))

# "Same as seven observed days ago", day by day: the last seven quantities over and over.
_NAIVE_FORECAST = """
SELECT series, last_date + CAST(ahead AS INTEGER) AS date, greatest(0.0::DOUBLE, qty::DOUBLE) AS forecast_qty
FROM (SELECT series, qty, max(date) OVER (PARTITION BY series) AS last_date,
        row_number() OVER (PARTITION BY series ORDER BY date DESC) AS back FROM complete WHERE n_days >= 16) h
JOIN range(1, 15) AS r(ahead) ON h.back = 7 - (r.ahead - 1) % 7 WHERE h.back <= 7"""

_AUDITED = (
    ("order_id", "string"), ("date", "date"), ("status", "string"), ("fulfilment", "string"),
    ("service_level", "string"), ("style", "string"), ("sku", "string"), ("category", "string"),
    ("size", "string"), ("courier_status", "string"), ("qty", "int"), ("amount", "decimal(18,2)"),
    ("ship_city", "string"), ("ship_state", "string"), ("promotion_ids", "string"), ("b2b", "boolean"),
)

# Spellings that mean "missing" in a CSV, written out once more.
_MISSING = """'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'"""


def _inferred_types() -> str:
    """Types by what kinds of text a column holds."""
    texts = " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS t FROM raw""" for c, _ in _AUDITED)
    return _raw(f"""
, texts AS (SELECT "column", CASE WHEN t NOT IN ({_MISSING}) THEN t END AS t FROM ({texts})),
kinds AS (
  SELECT "column", t, CASE WHEN t IS NULL THEN 'missing'
    WHEN regexp_full_match(t, '[ \t]*[+-]?[0-9]+[ \t]*') THEN
      CASE WHEN TRY_CAST(trim(t, ' \t') AS BIGINT) < 0 THEN 'negative' WHEN TRY_CAST(trim(t, ' \t') AS BIGINT) >= 0 THEN 'whole'
           WHEN TRY_CAST(trim(t, ' \t') AS UBIGINT) IS NOT NULL THEN 'unsigned' ELSE 'huge' END
    WHEN regexp_full_match(t, '[ \t]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t]*') AND isfinite(TRY_CAST(trim(t, ' \t') AS DOUBLE)) THEN 'fraction'
    WHEN lower(t) IN ('true', 'false') THEN 'flag'
    WHEN lower(ltrim(t, '+-')) IN ('inf', 'infinity') THEN 'fraction' ELSE 'text' END AS kind FROM texts)
SELECT "column", count(t) AS present, CASE WHEN bool_and(kind = 'missing') THEN 'double' WHEN bool_and(kind = 'flag') THEN 'boolean'
    WHEN bool_or(kind IN ('text', 'flag')) THEN 'string' WHEN bool_or(kind = 'fraction') THEN 'double' WHEN bool_or(kind = 'huge') THEN 'string'
    WHEN bool_or(kind = 'unsigned') THEN CASE WHEN bool_or(kind IN ('negative', 'missing')) THEN 'string' ELSE 'decimal(20,0)' END
    WHEN bool_or(kind = 'missing') THEN 'double' ELSE 'bigint' END AS type
FROM kinds GROUP BY "column" """)


_SHARE_OF = f"""
known AS (SELECT state, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS rev, {ORDERS}, {QTY}
  FROM sales WHERE state <> 'UNKNOWN' GROUP BY state)"""

ORACLE: dict[str, str] = {
    "facet_category": _sales("SELECT DISTINCT category AS value FROM sales WHERE category IS NOT NULL"),
    "facet_fulfilment": _sales("SELECT DISTINCT fulfilment AS value FROM sales WHERE fulfilment IS NOT NULL"),
    "facet_date_bounds": _sales("SELECT min(date) AS min_date, max(date) AS max_date FROM sales"),
    "clean_sales": _sales("""
SELECT order_id, sku, date, status, state, city, courier_status, promotion_ids, CAST(qty AS BIGINT) AS qty,
  CAST(revenue AS DOUBLE) AS revenue, is_cancelled, is_shipped, is_b2b FROM sales"""),
    "clean_report": _sales("""
SELECT order_id, date, status, fulfilment, sku, category, size, courier_status, state, city, promotion_ids,
  CASE WHEN qty % 2 = 1 THEN 'USD' ELSE 'INR' END AS currency,
  CASE WHEN promotion_ids <> 'None' THEN 'Courier' WHEN fulfilment = 'Amazon' THEN 'Amazon FBA' ELSE 'Easy Ship' END AS fulfilled_by,
  is_b2b, CAST(qty AS BIGINT) AS qty, CAST(revenue AS DOUBLE) AS revenue FROM sales"""),
    "state_normalised": _sales("SELECT state, count(*) AS rows FROM sales GROUP BY state"),
    "derived_calendar": _sales("""
SELECT DISTINCT date, month(date) AS month, strftime(date, '%b %Y') AS month_name, weekofyear(date) AS week, day_of_week,
  year(date) || '-W' || lpad(weekofyear(date)::VARCHAR, 2, '0') AS year_week
FROM sales WHERE date IS NOT NULL"""),
    "filtered_sales": _sales(f"""
SELECT category, count(*) AS rows, {REV} FROM sales
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND category = 'ECONOMY' AND fulfilment = 'Amazon' AND b2b
GROUP BY category"""),
    "filter_b2c_range": _sales(f"""
SELECT category, count(*) AS rows, {REV} FROM sales
WHERE date BETWEEN DATE '1995-03-01' AND DATE '1998-08-31' AND NOT b2b AND category IS NOT NULL GROUP BY category"""),
    "kpi_overview": _sales("""
SELECT
  (SELECT count(DISTINCT order_id) FROM sales) AS total_orders,
  (SELECT coalesce(sum(revenue), 0)::DOUBLE FROM sales) AS total_revenue,
  (SELECT CAST(sum(qty) AS BIGINT) FROM sales WHERE qty > 0) AS total_qty,
  (SELECT round(sum(rev)::DOUBLE / count(*), 4) FROM (
     SELECT coalesce(sum(revenue), 0) AS rev FROM sales WHERE order_id IS NOT NULL GROUP BY order_id)) AS avg_order_value,
  round(rate, 4) AS cancel_rate_pct,
  (SELECT category FROM sales WHERE category IS NOT NULL GROUP BY category
   ORDER BY coalesce(sum(revenue), 0) DESC, category LIMIT 1) AS top_category,
  CASE WHEN rate <= 15 THEN 'Healthy' ELSE 'Monitor' END AS health
FROM (SELECT sum(is_cancelled)::DOUBLE / count(*) * 100 AS rate FROM sales)"""),
    "daily_revenue": _sales(f"SELECT date, {REV} FROM sales WHERE date IS NOT NULL GROUP BY date"),
    "category_revenue": _sales(f"SELECT category, {REV} FROM sales WHERE category IS NOT NULL GROUP BY category"),
    "vc_status": _value_counts("status"),
    "vc_fulfilment": _value_counts("fulfilment"),
    "vc_courier": _value_counts("courier_status"),
    "vc_service_level": _value_counts("service_level"),
    "vc_b2b": _value_counts("b2b", "CASE WHEN b2b THEN 'B2B' ELSE 'B2C' END"),
    "size_qty": _sales(f"""
SELECT d.size, CAST(d.ordinal AS BIGINT) AS ordinal, CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty
FROM (VALUES {_SIZE_ORDER}) AS d(size, ordinal) LEFT JOIN sales s ON s.size = d.size GROUP BY d.size, d.ordinal"""),
    "trend_daily": _sales(f"SELECT date, {ORDERS}, {REV}, {QTY} FROM sales WHERE date IS NOT NULL GROUP BY date"),
    "trend_weekly": _sales(f"""
SELECT year(date) || '-W' || lpad(weekofyear(date)::VARCHAR, 2, '0') AS year_week, {ORDERS}, {REV}, {QTY}
FROM sales WHERE date IS NOT NULL GROUP BY 1"""),
    "trend_monthly": _sales(f"""
SELECT strftime(date, '%b %Y') AS month_name, {ORDERS}, {REV}, {QTY} FROM sales WHERE date IS NOT NULL GROUP BY 1"""),
    "category_summary": _sales(f"SELECT category, {REV}, {ORDERS}, {QTY} FROM sales WHERE category IS NOT NULL GROUP BY category"),
    "top20_sku": _sales(f"""
SELECT sku, category, {REV}, {QTY}, {ORDERS} FROM sales
WHERE revenue IS NOT NULL AND sku IS NOT NULL AND category IS NOT NULL
GROUP BY sku, category ORDER BY sum(revenue) DESC, sku, category LIMIT 20"""),
    "dow_category_heatmap": _sales(f"""
SELECT d.day_of_week, c.category, CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS rev
FROM (SELECT DISTINCT day_of_week FROM sales WHERE category IS NOT NULL AND day_of_week IN ({_WEEK})) d
CROSS JOIN (SELECT DISTINCT category FROM sales WHERE category IS NOT NULL AND date IS NOT NULL) c
LEFT JOIN sales s ON s.day_of_week = d.day_of_week AND s.category = c.category GROUP BY 1, 2"""),
    "state_summary": _sales("SELECT * FROM known", _SHARE_OF),
    "state_top20": _sales("SELECT * FROM known ORDER BY rev DESC, state LIMIT 20", _SHARE_OF),
    "state_share_top10": _sales("""
SELECT state, rev, round(rev / sum(rev) OVER (), 6) AS share_of_top, round(rev / (SELECT sum(rev) FROM known), 6) AS share_of_all
FROM (SELECT state, rev FROM known ORDER BY rev DESC, state LIMIT 10)""", _SHARE_OF),
    "city_top25": _sales(f"""
SELECT city, {REV}, {ORDERS} FROM sales WHERE city <> 'UNKNOWN' GROUP BY city ORDER BY coalesce(sum(revenue), 0) DESC, city LIMIT 25"""),
    "daily_shipped_cancelled": _sales("""
SELECT date, CASE WHEN is_cancelled = 1 THEN 'Cancelled' ELSE 'Shipped/Other' END AS type, count(*) AS cnt
FROM sales WHERE date IS NOT NULL GROUP BY date, is_cancelled"""),
    "cancel_rate_category": _sales(f"""
SELECT category, count(order_id) AS total, CAST(sum(is_cancelled) AS BIGINT) AS cancelled,
  {_even("sum(is_cancelled)::DOUBLE / count(order_id)::DOUBLE * 100.0::DOUBLE", 1)} AS cancel_rate_pct
FROM sales WHERE category IS NOT NULL GROUP BY category"""),
    "top15_style": _sales(f"""
SELECT style, category, {REV}, {QTY}, {ORDERS} FROM earning WHERE style IS NOT NULL AND category IS NOT NULL
GROUP BY style, category ORDER BY sum(revenue) DESC, style, category LIMIT 15""", _EARNING),
    "bottom15_style": _sales(f"""
SELECT style, category, {REV}, {QTY} FROM earning WHERE style IS NOT NULL AND category IS NOT NULL
GROUP BY style, category ORDER BY sum(revenue), style, category LIMIT 15""", _EARNING),
    "category_performance": _sales(f"""
SELECT category, {REV}, {ORDERS}, {QTY},
  {_even(_even("avg(is_cancelled)", 2) + " * 100.0::DOUBLE", 1)} AS cancel_rate_pct,
  {_even("sum(revenue)::DOUBLE / count(revenue)::DOUBLE", 2)} AS avg_row_revenue
FROM sales WHERE category IS NOT NULL GROUP BY category"""),
    "category_size_heatmap": _sales(f"""
SELECT c.category, d.size, CAST(coalesce(sum(qty), 0) AS BIGINT) AS qty
FROM (SELECT DISTINCT category FROM sales WHERE category IS NOT NULL AND size IS NOT NULL) c
CROSS JOIN (SELECT DISTINCT size FROM sales WHERE category IS NOT NULL AND size IN ({_SIZE_LIST})) d
LEFT JOIN sales s ON s.category = c.category AND s.size = d.size GROUP BY 1, 2"""),
    "top30_sku": _sales(f"""
SELECT sku, style, category, {REV}, {QTY}, {ORDERS} FROM earning
WHERE sku IS NOT NULL AND style IS NOT NULL AND category IS NOT NULL
GROUP BY sku, style, category ORDER BY sum(revenue) DESC, sku, style, category LIMIT 30""", _EARNING),
    "dq_shape": _raw("""
SELECT (SELECT count(*) FROM raw) AS n_rows, CAST(16 AS BIGINT) AS n_cols,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw)) AS dup_rows,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT order_id FROM raw)) AS dup_order_ids"""),
    "dq_missing": _raw("SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing,
  {_even(f"(count(*) - count({c}))::DOUBLE / count(*)::DOUBLE * 100.0::DOUBLE", 2)} AS missing_pct, count({c}) AS present FROM raw"""
        for c, _ in _AUDITED) + ") WHERE missing > 0"),
    "dq_types": "WITH " + _RAW.strip().replace("SELECT", "SELECT struct_pack(a := l_orderkey IS NULL, k := coalesce(l_orderkey, 0), n := l_linenumber) AS place,", 1) + "\n" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, count({c}) AS non_null,
  coalesce((min(struct_pack(p := place, v := CAST({c} AS VARCHAR))) FILTER (WHERE {c} IS NOT NULL)).v, 'N/A') AS sample FROM raw""" for c, t in _AUDITED),
    "dq_inferred_types": _inferred_types(),
    "dq_unique": _raw(" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique FROM raw""" for c, _ in _AUDITED)),
    "dq_unique_estimates": _raw(" UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS n_unique, TRUE AS near FROM raw""" for c, _ in _AUDITED)),
    "dq_describe": f"""WITH {_RAW.strip()},{_numbers(False)}
SELECT n."column", count(x) AS cnt, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min,
  round(any_value(q1), 4) AS p25, round(any_value(q2), 4) AS p50, round(any_value(q3), 4) AS p75, max(x) AS max
FROM numbers n JOIN quartiles q ON n."column" = q."column" WHERE x IS NOT NULL GROUP BY n."column" """,
    "hist_amount": _histogram("amount", 80, "TRUE"),
    "hist_qty": _histogram("qty", 20, "qty > 0"),
    "hist_amount_round": _round_histogram("amount", 80, "TRUE"),
    "hist_qty_round": _round_histogram("qty", 20, "qty > 0"),
    "box_stats": f"""WITH {_RAW.strip()},{_numbers(True)}
SELECT "column", round(any_value(q1), 4) AS q1, round(any_value(q2), 4) AS median, round(any_value(q3), 4) AS q3,
  min(x) FILTER (WHERE inside) AS whisker_lo, max(x) FILTER (WHERE inside) AS whisker_hi,
  count(*) FILTER (WHERE NOT inside) AS outliers FROM fenced GROUP BY "column" """,
    "dq_iqr_outliers": f"""WITH {_RAW.strip()},{_numbers(False)}
SELECT "column", round(any_value(q3 - q1), 4) AS iqr, count(*) FILTER (WHERE NOT inside) AS n_outliers,
  round(count(*) FILTER (WHERE NOT inside)::DOUBLE / count(*) * 100, 4) AS outlier_pct FROM fenced GROUP BY "column" """,
    "dq_raw_states": _raw("SELECT DISTINCT ship_state AS state FROM raw WHERE ship_state IS NOT NULL"),
    "dq_status": _raw("SELECT status, count(*) AS cnt FROM raw WHERE status IS NOT NULL GROUP BY status"),
    "dq_zero_null": _raw("""
SELECT count(*) FILTER (WHERE amount IS NULL) AS null_amount, count(*) FILTER (WHERE amount = 0) AS zero_amount,
  count(*) FILTER (WHERE qty = 0) AS zero_qty FROM raw"""),
    "fc_daily": _sales("SELECT series, date, CAST(qty AS BIGINT) AS qty, CAST(rev AS DOUBLE) AS rev FROM days", _DAYS),
    "fc_features": _sales(f"""
SELECT series, date, qty, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, weekofyear(date) AS week_of_year,
  month(date) AS month, CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend,
  {", ".join(f"CAST(lag_{k} AS BIGINT) AS lag_{k}" for k in (1, 3, 7, 14))},
  {", ".join(f"round(rolling_{m}_{w}, 4) AS rolling_{m}_{w}" for m in ("mean", "std") for w in (3, 7, 14))}
FROM complete""", _DAYS, _SPLIT),
    "fc_split": _sales("""
SELECT w.series, count(c.pos) FILTER (WHERE c.pos <= c.cut) AS n_train, count(c.pos) FILTER (WHERE c.pos > c.cut) AS n_test,
  max(c.date) FILTER (WHERE c.pos <= c.cut) AS last_train_date, min(c.date) FILTER (WHERE c.pos > c.cut) AS first_test_date,
  CASE WHEN max(w.n_days) >= 16 THEN 'ok' ELSE 'insufficient_data' END AS status
FROM windowed w LEFT JOIN complete c ON w.series = c.series AND w.date = c.date GROUP BY w.series""", _DAYS, _SPLIT),
    "fc_metrics_naive": _sales("""
SELECT series, round(avg(abs(qty - lag_7)), 4) AS mae, round(sqrt(avg((qty - lag_7)::DOUBLE ^ 2)), 4) AS rmse,
  CASE WHEN count(*) >= 2 THEN round(1 - sum((qty - lag_7)::DOUBLE ^ 2) / nullif(sum((qty - mean)::DOUBLE ^ 2), 0), 4) END AS r2
FROM (SELECT *, avg(qty) OVER (PARTITION BY series) AS mean FROM complete WHERE pos > cut AND n_days >= 16) GROUP BY series""", _DAYS, _SPLIT),
    "ins_category_stats": _sales("SELECT * FROM stats", _EARNING, _CATEGORY_STATS),
    "ins_category_extremes": _sales("""
SELECT 'best' AS which, category, rev, cancel_rate_pct FROM (SELECT * FROM stats ORDER BY rev DESC, category LIMIT 1)
UNION ALL SELECT 'worst', category, rev, cancel_rate_pct FROM (SELECT * FROM stats ORDER BY rev, category LIMIT 1)
UNION ALL SELECT 'most_cancelled', category, rev, cancel_rate_pct
FROM (SELECT * FROM stats ORDER BY cancel_rate_pct DESC, category LIMIT 1)""", _EARNING, _CATEGORY_STATS),
    "ins_sku_extremes": _sales("SELECT which, sku, category, CAST(rev AS DOUBLE) AS rev FROM sku_ends", _EARNING, _SKUS),
    "ins_state_extremes": _sales("SELECT which, state, CAST(rev AS DOUBLE) AS rev, orders FROM state_ends", _EARNING, _STATES),
    "ins_trend": _sales("SELECT * FROM trend", _EARNING, _TREND),
    "ins_rates": _sales("SELECT * FROM rates", _RATES),
    "ins_weekday_extremes": _sales("SELECT which, day_of_week, CAST(rev AS DOUBLE) AS rev FROM weekday_ends", _EARNING, _WEEKDAYS),
    "ins_top3_state_share": _sales("SELECT * FROM state_share", _EARNING, _STATES),
    "ins_cards": _sales("""
SELECT 1::BIGINT AS card_id, 'success' AS severity, 'Leading category' AS title,
  top_cat || ' earns the most, INR ' || top_cat_m || 'M. Keep it well stocked and visible.' AS text FROM facts
UNION ALL SELECT 2, 'warn', 'Most cancelled category',
  bad_cat || ' loses ' || bad_cat_pct || ' of its lines to cancellations. Check sizing, quality and listings.' FROM facts
UNION ALL SELECT 3, 'success', 'Leading state', best_state || ' brings in INR ' || best_state_m || 'M over ' || best_state_orders
  || ' order lines. Regional offers and fast delivery pay off there.' FROM facts
UNION ALL SELECT 4, 'info', 'Revenue trend', 'Daily revenue is ' || direction || ': ' || CASE WHEN trend_pct >= 0 THEN '+' ELSE '' END
  || trend_text || ' from the earlier to the later half. '
  || CASE WHEN trend_pct > 0 THEN 'Build on it with seasonal offers.' ELSE 'Look into season, rivals and stock.' END FROM facts
UNION ALL SELECT 5, 'info', 'Best SKU', best_sku || ' (' || best_sku_cat || ') leads with INR ' || best_sku_rev || '. Never let it run out.' FROM facts
UNION ALL SELECT 6, 'danger', 'Weakest SKU', worst_sku || ' earned just INR ' || worst_sku_rev || '. Discount it, list it better or drop it.' FROM facts
UNION ALL SELECT 7, 'info', 'Best weekday: ' || best_day, best_day || ' earns the most and ' || worst_day
  || ' the least. Launch on the former, promote on the latter.' FROM facts
UNION ALL SELECT 8, CASE WHEN cancel > 15 THEN 'warn' ELSE 'success' END, 'Cancel rate: ' || cancel_text,
  CASE WHEN cancel > 15 THEN 'Too many lines are cancelled. Find the causes, worst categories first.'
       ELSE 'Cancellations are in the healthy range. Watch for jumps.' END FROM facts
UNION ALL SELECT 9, 'info', 'Platform fulfilment', platform_text || ' of lines are fulfilled by the platform. Consider moving more there.' FROM facts
UNION ALL SELECT 10, CASE WHEN b2b > 5 THEN 'success' ELSE 'info' END, 'B2B revenue: ' || b2b_text,
  CASE WHEN b2b > 5 THEN 'Business buyers matter. Look after the large accounts.' ELSE 'Business buyers are few. Bulk offers could win more.' END FROM facts
UNION ALL SELECT 11, 'info', 'Promotions: ' || promo_text,
  CASE WHEN promo > 50 THEN 'Most earning lines were promoted. Test how they sell without.'
       ELSE 'Promotions are used with measure. Try them on slow SKUs.' END FROM facts
UNION ALL SELECT 12, 'info', 'Regional concentration', 'The top three states bring in ' || share_text || ' of revenue; ' || worst_state
  || ' brings in the least. Spread campaigns to lower the risk.' FROM facts""", *_FACTS),
    "ins_recommendations": _sales("""
SELECT row_number() OVER (ORDER BY call, place) AS rec_id, CASE call WHEN 0 THEN 'act' WHEN 1 THEN 'watch' ELSE 'fine' END AS priority,
  area, action
FROM (SELECT *, CASE WHEN figure > bound THEN 0 WHEN figure > bound / 2 THEN 1 ELSE 2 END AS call FROM (
  SELECT 1 AS place, 'cancelled lines' AS area, cancel AS figure, 15.0::DOUBLE AS bound,
    cancel_text || ' of all lines are cancelled, ' || bad_cat_pct || ' of those in ' || bad_cat AS action FROM facts
  UNION ALL SELECT 2, 'promoted lines', promo, 50.0, promo_text || ' of earning lines sold on a promotion' FROM facts
  UNION ALL SELECT 3, 'reliance on states', top3, 50.0, share_text || ' of revenue depends on three states' FROM facts
  UNION ALL SELECT 4, 'revenue decline', -trend_pct, 10.0, 'daily revenue changed by ' || CASE WHEN trend_pct >= 0 THEN '+' ELSE '' END
    || trend_text || ' from one half of the days to the other' FROM facts
  UNION ALL SELECT 5, 'stock of the best SKU', share, 1.0, best_sku || ' alone earns ' || format('{:,.2f}%', round_even(share, 2))
    || ' of revenue; running out would cost that much' FROM facts, (SELECT * FROM spreads WHERE kind = 'sku')
  UNION ALL SELECT 6, 'SKU to clear', shortfall, 75.0, worst_sku || ' earns ' || format('{:,.1f}%', round_even(shortfall, 1))
    || ' less than the average SKU' FROM facts, (SELECT * FROM spreads WHERE kind = 'sku')
  UNION ALL SELECT 7, 'poorly served states', 100.0 * poor / n, 25.0, poor || ' of ' || n || ' states earn under half of the average, '
    || worst_state || ' the least' FROM facts, (SELECT * FROM spreads WHERE kind = 'state')
  UNION ALL SELECT 8, 'reliance on a weekday', lead_pct, 20.0, best_day || ' earns ' || format('{:,.1f}%', round_even(lead_pct, 1))
    || ' more than the average weekday' FROM facts, (SELECT * FROM spreads WHERE kind = 'weekday')
  UNION ALL SELECT 9, 'reliance on consumers', 100.0 - b2b, 95.0, 'business buyers account for ' || b2b_text || ' of revenue' FROM facts))""", *_FACTS, """
revenues AS (
  SELECT 'sku' AS kind, rev::DOUBLE AS rev FROM skus UNION ALL SELECT 'state', rev::DOUBLE FROM states UNION ALL SELECT 'weekday', rev::DOUBLE FROM weekdays),
averages AS (SELECT kind, sum(rev) AS total, count(*) AS n FROM revenues GROUP BY kind),
spreads AS (
  SELECT kind, any_value(n) AS n, count(*) FILTER (WHERE rev < total / n / 2) AS poor, round(max(rev) / any_value(total) * 100, 4) AS share,
    round(max(rev) * any_value(n) / any_value(total) * 100 - 100, 4) AS lead_pct, round(100 - min(rev) * any_value(n) / any_value(total) * 100, 4) AS shortfall
  FROM revenues JOIN averages USING (kind) GROUP BY kind)"""),
    "fc_forecast_naive": _sales(_NAIVE_FORECAST, _DAYS, _SPLIT),
    "fc_forecast_naive_7": _sales(_NAIVE_FORECAST.replace("range(1, 15)", "range(1, 8)"), _DAYS, _SPLIT),
    "fc_forecast_naive_30": _sales(_NAIVE_FORECAST.replace("range(1, 15)", "range(1, 31)"), _DAYS, _SPLIT),
    "fc_combined_naive": _sales(f"""
SELECT series, date, 'history' AS kind, CAST(qty AS DOUBLE) AS qty FROM complete WHERE n_days >= 16
UNION ALL SELECT series, date, 'forecast', forecast_qty FROM ({_NAIVE_FORECAST})""", _DAYS, _SPLIT),
}
