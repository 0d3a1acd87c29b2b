"""Data-quality audit of the raw lines. Filters never apply here."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.fixed_values import AMOUNT_BINS, QTY_BINS
from tillwright.functions.numbers import half_even, percent, ratio
from tillwright.operators.histograms import histogram, round_histogram
from tillwright.operators.rank_search import quantile_row
from tillwright.operators.rollups import union_all, value_counts
from tillwright.operators.type_lattice import inferred
from tillwright.sources.order_report import present

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _data_columns(part: DataFrame) -> list[str]:
    return [c for c in part.columns if c not in ("lines", "place")]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def shape(src) -> DataFrame:
    """Rows, columns, repeated rows and repeated order ids beyond the first of each.

    Rows are compared by 128-bit digests of all their columns, so the shuffle carries two numbers a row.
    Two different rows among 10^12 have equal digests with a probability of about 10^-15.
    """
    copies = src.row_digests().groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    rows = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("distinct_rows"))
    order_ids = src.order_ids().distinct().agg(F.count(F.lit(1))).scalar()
    return rows.select(
        "n_rows",
        F.lit(len(src.raw().columns)).cast("long").alias("n_cols"),
        (F.col("n_rows") - F.col("distinct_rows")).alias("dup_rows"),
        (F.col("n_rows") - order_ids).alias("dup_order_ids"),
    )


def _per_column(part: DataFrame, measures: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One pass over a group of raw columns, then one row per column."""
    columns = _data_columns(part)
    one = part.agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("rows"),
        *[rule(_quoted(c)).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, rule in measures.items()],
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.col("rows"), *[F.col(f"{name}_{i}").alias(name) for name in measures])
        for i, c in enumerate(columns)
    ]
    return one.select(F.inline(F.array(*rows)))


def _present(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c.isNotNull(), F.col("lines"))), F.lit(0))


def missing(src) -> DataFrame:
    """Columns with missing values: how many, percent of rows (two decimals), and how many present."""
    counted = union_all([_per_column(part, {"present": _present}) for part in src.raw_parts()])
    absent = F.col("rows") - F.col("present")
    return (
        counted.select(
            "column",
            absent.alias("missing"),
            half_even(percent(absent, F.col("rows")), 2).alias("missing_pct"),
            "present",
        )
        .where(F.col("missing") > 0)
        .orderBy(F.desc("missing_pct"), "column")
    )


def _first_present(c: Column) -> Column:
    first = F.min(F.when(c.isNotNull(), F.struct("place", c.cast("string").alias("value"))))
    return F.coalesce(first["value"], F.lit("N/A"))


def types(src) -> DataFrame:
    """Type, number of present values and the first of them, as text, per column.

    Of values in the same place the one that sorts first counts.
    """
    frames = []
    for part in src.raw_parts(placed=True):
        names = {f.name: f.dataType.simpleString() for f in part.schema.fields}
        name_of = F.create_map(*[F.lit(x) for c in _data_columns(part) for x in (c, names[c])])
        counted = _per_column(part, {"non_null": _present, "sample": _first_present})
        frames.append(counted.select("column", name_of[F.col("column")].alias("type"), "non_null", "sample"))
    return union_all(frames).orderBy("column")


def inferred_types(src) -> DataFrame:
    """What a reader without a schema would type the raw columns, were they a CSV; one pass per group of columns."""
    parts = []
    for part in src.raw_parts():
        texts = [present(_quoted(c).cast("string")).alias(c) for c in _data_columns(part)]
        parts.append(inferred(part.select(*texts)))
    return union_all(parts).orderBy("column")


def samples(ordered: DataFrame, order_column: str) -> DataFrame:
    """First present value per column in file order, as text, "N/A" if there is none.

    ``ordered`` is a raw frame with a sortable position column, see ``with_file_order``.
    """
    columns = [c for c in ordered.columns if c != order_column]

    def first_present(c: str) -> Column:
        placed = F.struct(F.col(order_column), _quoted(c).cast("string").alias("value"))
        return F.coalesce(F.min(F.when(_quoted(c).isNotNull(), placed))["value"], F.lit("N/A"))

    firsts = ordered.agg(*[first_present(c).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("sample")) for i, c in enumerate(columns)]
    return firsts.select(F.inline(F.array(*rows)))


def cardinality(src, approx: bool = False) -> DataFrame:
    """Distinct present values per column, most first; ``approx`` estimates them from sketches.

    Counting shuffles narrow (column, value) pairs, deduplicated on the map side first. One distinct
    count per column in a single aggregate would shuffle rows as wide as the table.
    """
    if approx:
        return estimated(sketches(src)).orderBy(F.desc("n_unique"), "column")
    frames = []
    for part in src.raw_parts():
        columns = _data_columns(part)
        # Columns go by their position, which is shorter than their name.
        texts = part.select(*[_quoted(c).cast("string").alias(str(i)) for i, c in enumerate(columns)])
        pairs = texts.unpivot([], [f"`{i}`" for i in range(len(columns))], "position", "value").distinct()
        names = F.array(*[F.lit(c) for c in columns])
        counts = pairs.groupBy("position").agg(F.count("value").alias("n_unique"))
        frames.append(counts.select(F.get(names, F.col("position").cast("int")).alias("column"), "n_unique"))
    return union_all(frames).orderBy(F.desc("n_unique"), "column")


# Buckets of a distinct-value sketch, as a power of two, and three times its relative standard error.
SKETCH_BITS = 14
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def sketches(src) -> DataFrame:
    """A distinct-value sketch per column, from one pass: columns column and sketch.

    A few kilobytes each, whatever the lines. Stored, they stand for the files read so far; ``merged``
    adds those of files that arrive later, which need not be read together.
    """
    return union_all([_per_column(part, {"sketch": lambda c: F.hll_sketch_agg(c.cast("string"), F.lit(SKETCH_BITS))}).select("column", "sketch") for part in src.raw_parts()])


def merged(*several: DataFrame) -> DataFrame:
    """The sketches of all lines, from the sketches of some and of others."""
    return union_all(list(several)).groupBy("column").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(of_columns: DataFrame) -> DataFrame:
    """Distinct values per column as sketches have them, within ``SKETCH_ERROR`` in 997 of 1000 cases."""
    return of_columns.select("column", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("n_unique"))


def estimates_checked(src) -> DataFrame:
    """Exact distinct values per column, and whether their estimate is as near as ``SKETCH_ERROR`` says."""
    guess = estimated(sketches(src)).withColumnRenamed("n_unique", "guess")
    near = F.abs(F.col("guess") - F.col("n_unique")) <= F.ceil(F.col("n_unique") * SKETCH_ERROR)
    return cardinality(src).join(guess, "column").select("column", "n_unique", near.alias("near")).orderBy("column")


# The audited numbers.
NUMBERS = ("qty", "amount")


def _numbers(src) -> DataFrame:
    """Quantity, quantity where something was sold, and amount."""
    qty, amount = (_quoted(src.raw_name(role)) for role in NUMBERS)
    return src.raw(*NUMBERS).select(qty.alias("qty"), F.when(qty > 0, qty).alias("sold"), amount.alias("amount"))


def quartiles(src, *numbers: str) -> DataFrame:
    """One row with the quartiles of quantity, sold quantity and amount, or some of these, all from one search.

    Reports find theirs as part of their own plans; those of one page may share such a row, kept by
    ``persist``, so that the search runs once.
    """
    return quantile_row(_numbers(src).select(*(numbers or ["*"])), QUARTILES)


def _with_quartiles(src, numbers: tuple[str, str], rules: Callable[[Column, str], dict[str, Column]], found: DataFrame | None) -> DataFrame:
    """Per number, aggregates that may use its value and its quartiles, then one row per number."""
    row = quartiles(src, *numbers) if found is None else found
    known = row.select(F.struct(*row.columns)).scalar()
    seen = _numbers(src).select(*[F.col(c).cast("double").alias(c) for c in numbers], known.alias("quartiles"))
    sums = [rule.alias(f"{name}_{c}") for c in numbers for name, rule in rules(F.col(c), c).items()]
    rows = [
        F.struct(F.lit(src.raw_name(role)).alias("column"), *[F.col(f"{name}_{c}").alias(name) for name in rules(F.col(c), c)])
        for role, c in zip(NUMBERS, numbers, strict=True)
    ]
    return seen.agg(*sums).select(F.inline(F.array(*rows))).orderBy("column")


def _quartile(number: str, name: str) -> Column:
    return F.col(f"quartiles.{number}.{name}")


def _one_of(value: Column) -> Column:
    """A value that is the same on all rows, as an aggregate."""
    return F.round(F.first(value), 4)


def describe(src, found: DataFrame | None = None) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of quantity and amount."""

    def rules(x: Column, number: str) -> dict[str, Column]:
        return {
            "cnt": F.count(x),
            "mean": F.round(F.avg(x), 4),
            "std": F.round(F.stddev_samp(x), 4),
            "min": F.min(x),
            **{name: _one_of(_quartile(number, name)) for name in QUARTILES},
            "max": F.max(x),
        }

    return _with_quartiles(src, NUMBERS, rules, found)


def _inside(x: Column, number: str) -> Column:
    """Whether a value is within 1.5 IQR of the quartiles."""
    low, high = _quartile(number, "p25"), _quartile(number, "p75")
    return x.between(low - 1.5 * (high - low), high + 1.5 * (high - low))


def box_stats(src, found: DataFrame | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme values within the fences) and outliers; quantity only where positive."""

    def rules(x: Column, number: str) -> dict[str, Column]:
        inside = _inside(x, number)
        return {
            **{name: _one_of(_quartile(number, p)) for name, p in (("q1", "p25"), ("median", "p50"), ("q3", "p75"))},
            "whisker_lo": F.min(F.when(inside, x)),
            "whisker_hi": F.max(F.when(inside, x)),
            "outliers": F.count_if(~inside),
        }

    return _with_quartiles(src, ("sold", "amount"), rules, found)


def iqr_outliers(src, found: DataFrame | None = None) -> DataFrame:
    """Rows strictly outside the 1.5 IQR fences, as a share of present values."""

    def rules(x: Column, number: str) -> dict[str, Column]:
        outside = F.count_if(~_inside(x, number))
        return {
            "iqr": _one_of(_quartile(number, "p75") - _quartile(number, "p25")),
            "n_outliers": outside,
            "outlier_pct": F.round(ratio(outside.cast("double") * 100, F.count(x)), 4),
        }

    return _with_quartiles(src, NUMBERS, rules, found)


def amount_histogram(src, bins: int = AMOUNT_BINS) -> DataFrame:
    return _rounded_edges(histogram(src.raw("amount"), src.raw_name("amount"), bins))


def qty_histogram(src, bins: int = QTY_BINS) -> DataFrame:
    qty = src.raw_name("qty")
    return _rounded_edges(histogram(src.raw("qty").where(_quoted(qty) > 0), qty, bins))


def amount_histogram_round(src, most: int = AMOUNT_BINS) -> DataFrame:
    """At most so many bins, with round edges."""
    return _rounded_edges(round_histogram(src.raw("amount"), src.raw_name("amount"), most))


def qty_histogram_round(src, most: int = QTY_BINS) -> DataFrame:
    qty = src.raw_name("qty")
    return _rounded_edges(round_histogram(src.raw("qty").where(_quoted(qty) > 0), qty, most))


def _rounded_edges(bins: DataFrame) -> DataFrame:
    return bins.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "cnt")


def raw_states(src) -> DataFrame:
    found = src.weighted_raw("state").select(_quoted(src.raw_name("state")).alias("state"))
    return found.where(F.col("state").isNotNull()).distinct().orderBy("state")


def status_counts(src) -> DataFrame:
    status = _quoted(src.raw_name("status")).alias("status")
    counts = value_counts(src.weighted_raw("status").select(status, "lines"), "status", share=False)
    return counts.withColumnRenamed("value", "status")


def zero_and_null(src) -> DataFrame:
    amount, qty = _quoted(src.raw_name("amount")), _quoted(src.raw_name("qty"))
    return src.raw("amount", "qty").agg(
        F.count_if(amount.isNull()).alias("null_amount"),
        F.count_if(amount == 0).alias("zero_amount"),
        F.count_if(qty == 0).alias("zero_qty"),
    )
