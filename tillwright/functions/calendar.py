"""Calendar rules as SQL."""

from __future__ import annotations

from tillwright.fixed_values import CENTURY_PIVOT_YEAR, REPORT_DATE_FORMAT


def report_date(column: str) -> str:
    """Two-digit-year text to DATE; unreadable text becomes null, years 69-99 are 19xx."""
    parsed = f"try_to_date({column}, '{REPORT_DATE_FORMAT}')"
    return f"CASE WHEN year({parsed}) >= {CENTURY_PIVOT_YEAR} THEN add_months({parsed}, -1200) ELSE {parsed} END"


def month_name(date: str) -> str:
    return f"date_format({date}, 'MMM yyyy')"


def weekday_name(date: str) -> str:
    return f"date_format({date}, 'EEEE')"


def year_week(date: str, iso_year: bool = False) -> str:
    """Calendar year + ISO week (so 2022-01-01 is 2022-W52); ``iso_year`` pairs the week with its own year."""
    year = f"extract(YEAROFWEEK FROM {date})" if iso_year else f"year({date})"
    return f"concat(lpad({year}, 4, '0'), '-W', lpad(weekofyear({date}), 2, '0'))"
