"""Results are only right when these match the source data's conventions."""

# Whole-value state spellings and what they stand for.
STATE_ALIASES = {
    "RJ": "RAJASTHAN",
    "PB": "PUNJAB",
    "NL": "NAGALAND",
    "AR": "ARUNACHAL PRADESH",
    "RAJSHTHAN": "RAJASTHAN",
    "RAJSTHAN": "RAJASTHAN",
    "ORISSA": "ODISHA",
    "PONDICHERRY": "PUDUCHERRY",
    "NEW DELHI": "DELHI",
    "PUNJAB/MOHALI/ZIRAKPUR": "PUNJAB",
    "APO": "UNKNOWN",
}

# Replacements for missing text.
UNKNOWN_PLACE = "UNKNOWN"
UNKNOWN_COURIER = "Unknown"
NO_PROMOTION = "None"
DEFAULT_CURRENCY = "INR"
FULFILLED_BY_PLATFORM = "Amazon FBA"
FULFILLED_BY_SELLER = "Easy Ship"

# Codes the flags are derived from.
PLATFORM_FULFILMENT = "Amazon"
CANCELLED_PREFIX = "Cancelled"
SHIPPED_PREFIX = "Shipped"

# Ordered domains.
SIZES = ("XS", "S", "M", "L", "XL", "XXL", "3XL", "4XL", "5XL", "6XL", "Free")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Report sizes and thresholds.
HEALTHY_CANCEL_PCT = 15
NOTABLE_B2B_PCT = 5
HEAVY_PROMOTION_PCT = 50
TREND_MIN_DAYS = 14
AMOUNT_BINS = 80
QTY_BINS = 20

# Limits of our own for the findings.
MAX_TOP_STATES_PCT = 50
MAX_DECLINE_PCT = 10
MAX_SKU_SHARE_PCT = 1
MAX_SKU_SHORTFALL_PCT = 75
MAX_POOR_STATES_PCT = 25
MAX_WEEKDAY_LEAD_PCT = 20

# Demand model features and split.
LAGS = (1, 3, 7, 14)
WINDOWS = (3, 7, 14)
TRAIN_SHARE = 0.8
MIN_MODEL_DAYS = 16
TOP_FEATURES = 12

# Text a CSV reader of the source data treats as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Date layout of the order report (two-digit years from 69 on mean 19xx).
REPORT_DATE_FORMAT = "M-d-yy"
CENTURY_PIVOT_YEAR = 2069
