"""Products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwright.fixed_values import SIZES
from tillwright.functions.numbers import half_even, ratio
from tillwright.operators.filters import EARNING
from tillwright.operators.rollups import (
    cancelled,
    completed_grid,
    lines,
    orders,
    qty,
    rev,
    rollup_by,
    table,
    top_k,
    total,
)


def best_styles(src, k: int = 15) -> DataFrame:
    keys = ["style", "category"]
    return table(top_k(rollup_by(src.totals(*keys, rows=EARNING), keys, rev(), qty(), orders()), "rev", k, keys))


def worst_styles(src, k: int = 15) -> DataFrame:
    keys = ["style", "category"]
    return table(top_k(rollup_by(src.totals(*keys, rows=EARNING), keys, rev(), qty()), "rev", k, keys, ascending=True))


def category_performance(src) -> DataFrame:
    """Totals per category, the cancel rate as a whole percentage and mean revenue per priced line.

    The rate is rounded to two decimals before it becomes a percentage, hence whole percents;
    ``cancel_rate_by_category`` has the finer figure.
    """
    totals = rollup_by(
        src.totals("category", "is_cancelled"),
        ["category"],
        rev(),
        orders(),
        qty(),
        cancelled(),
        lines(),
        total("priced"),
    )
    rate = half_even(half_even(ratio(F.col("cancelled"), F.col("rows")), 2) * 100.0, 1)
    return table(
        totals.orderBy(F.desc("rev"), "category").select(
            "category",
            "rev",
            "orders",
            "qty",
            rate.alias("cancel_rate_pct"),
            half_even(ratio(F.col("rev"), F.col("priced")), 2).alias("avg_row_revenue"),
        )
    )


def category_sizes(src) -> DataFrame:
    """Quantity per category and size that occurs, in size order."""
    grid = completed_grid(src.totals("category", "size"), "category", "size", SIZES, "qty", "qty")
    position = F.array_position(F.array(*[F.lit(s) for s in SIZES]), F.col("size"))
    return grid.orderBy("category", position)


def size_matrix(src) -> DataFrame:
    """``category_sizes`` as a matrix: a row per category, a column per size of the domain."""
    cells = rollup_by(src.totals("category", "size"), ["category", "size"], qty())
    return cells.groupBy("category").pivot("size", list(SIZES)).agg(F.sum("qty")).na.fill(0).orderBy("category")


def top_sku_table(src, k: int = 30) -> DataFrame:
    keys = ["sku", "style", "category"]
    return table(top_k(rollup_by(src.totals(*keys, rows=EARNING), keys, rev(), qty(), orders()), "rev", k, keys))
