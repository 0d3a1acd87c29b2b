"""Null-aware grouping, value counts, top-k, extremes and completed grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.functions.numbers import money_to_double


def total(column: str, name: str | None = None) -> Column:
    """Sum that is zero, not null, over no or only missing values."""
    return F.expr(f"coalesce(sum({column}), 0) AS {name or column}")


def rev() -> Column:
    return total("revenue", "rev")


def orders() -> Column:
    """Lines that carry an order id (not distinct orders)."""
    return total("orders")


def qty() -> Column:
    return total("qty")


def lines(name: str = "rows") -> Column:
    return total("lines", name)


def cancelled() -> Column:
    return total("is_cancelled * lines", "cancelled")


def rollup_by(df: DataFrame, keys: Sequence[str], *measures: Column) -> DataFrame:
    """Group by keys, leaving out rows where any key is missing."""
    return df.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(*measures)


def value_counts(df: DataFrame, column: str, label: Column | None = None, share: bool = True) -> DataFrame:
    """Lines per non-missing value, most frequent first, with the share of the counted total."""
    counts = rollup_by(df, [column], lines("cnt"))
    out = [(F.col(column) if label is None else label).alias("value"), F.col("cnt")]
    if share:
        grand = counts.agg(F.sum("cnt")).scalar()
        out.append((F.col("cnt").cast("double") / grand).alias("share"))
    return counts.select(*out).orderBy(F.desc("cnt"), F.asc("value"))


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str], ascending: bool = False) -> DataFrame:
    """First k rows by a measure; equal measures are taken in ascending key order."""
    first = F.asc(by) if ascending else F.desc(by)
    return df.orderBy(first, *[F.asc(t) for t in ties]).limit(k)


def best_and_worst(df: DataFrame, by: str, keys: Sequence[str]) -> DataFrame:
    """Both ends by a measure in one aggregate; ties go to the first key in ascending order."""
    columns = [*keys, *[c for c in df.columns if c not in keys]]

    def first(rank: Column) -> Column:
        return F.min(F.struct(rank.alias("rank_by"), *columns))

    ends = df.where(f"{by} IS NOT NULL").agg(first(-F.col(by)).alias("best"), first(F.col(by)).alias("worst"))
    rows = [F.struct(F.lit(end).alias("which"), *[F.col(end)[c].alias(c) for c in columns]) for end in ends.columns]
    return ends.where("best IS NOT NULL").select(F.inline(F.array(*rows)))


def domain_totals(df: DataFrame, key: str, domain: Sequence[str], value: str, out: str) -> DataFrame:
    """Total per value of a fixed domain, zero where absent; values outside it are left out."""
    sums = df.selectExpr(
        *[f"coalesce(sum({value}) FILTER (WHERE {key} = '{v}'), 0) AS v{i}" for i, v in enumerate(domain)]
    )
    rows = [
        F.struct(F.lit(v).alias(key), F.lit(i).cast("long").alias("ordinal"), F.col(f"v{i}").alias(out))
        for i, v in enumerate(domain)
    ]
    return sums.select(F.inline(F.array(*rows)))


def completed_grid(df: DataFrame, row: str, col: str, domain: Sequence[str], value: str, out: str) -> DataFrame:
    """Totals for every (row key, domain value that occurs), zero where the pair is absent.

    Pivoting on the fixed domain completes the grid without pairing up keys; ``present`` then keeps
    the domain values that occur in any row. The window holds one line per row key and domain value.
    """
    cells = rollup_by(df, [row, col], F.sum(value).alias("cell"), F.count(F.lit(1)).alias("hits"))
    wide = cells.groupBy(row).pivot(col, list(domain)).agg(F.sum("cell").alias("cell"), F.sum("hits").alias("hits"))
    pairs = [
        F.struct(F.lit(v).alias(col), F.col(f"`{v}_cell`").alias("cell"), F.col(f"`{v}_hits`").alias("hits"))
        for v in domain
    ]
    present = F.max("hits").over(Window.partitionBy(col))
    return (
        wide.select(row, F.inline(F.array(*pairs)))
        .withColumn("present", present)
        .where("present IS NOT NULL")
        .select(row, col, F.coalesce("cell", F.lit(0)).alias(out))
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table(df: DataFrame) -> DataFrame:
    """Report table: money leaves as DOUBLE."""
    return money_to_double(df)
