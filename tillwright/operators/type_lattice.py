"""Types of text columns, decided by all of their values in one pass.

A value belongs to one class of text, and a column's classes are or-ed together as bits. That is all an
aggregate has to keep, so it merges across files and tasks in any order, for all columns at once. The
column's type is read off its bits.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the classes a value can belong to.
MISSING, FLAG, WHOLE, NEGATIVE, UNSIGNED, HUGE, FRACTION, TEXT = (1 << i for i in range(8))

_WHOLE = r"^[ \t]*[+-]?[0-9]+[ \t]*\z"
_FRACTION = r"^[ \t]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t]*\z"
_INFINITE = r"(?i)^[+-]?inf(inity)?\z"
_FLAG = r"(?i)^(true|false)\z"
_BLANKS = " \t"


def _trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(_BLANKS))


def class_of(value: Column) -> Column:
    """The bits of one value; null is a missing one."""
    number = _trimmed(value).try_cast("decimal(38,0)")
    limit, twice = Decimal(2**63), Decimal(2**64)
    whole = (
        F.when((number >= 0) & (number < limit), WHOLE)
        .when((number < 0) & (number >= -limit), WHOLE | NEGATIVE)
        .when((number >= 0) & (number < twice), UNSIGNED)
        .otherwise(HUGE)
    )
    finite = F.abs(_trimmed(value).try_cast("double")) < float("inf")
    return (
        F.when(value.isNull(), MISSING)
        .when(value.rlike(_WHOLE), whole)
        .when(value.rlike(_FRACTION) & finite, FRACTION)
        .when(value.rlike(_FLAG), FLAG)
        .when(value.rlike(_INFINITE), FRACTION)
        .otherwise(TEXT)
    )


def type_of(classes: Column) -> Column:
    """The type of a column with these classes, as text; a column of no rows is text.

    Missing values turn whole numbers into floating ones; flags with missing values stay text. Whole
    numbers from 2^63 on need a column without negative or missing ones, and from 2^64 on none but
    fractions beside them hold them as numbers.
    """

    def has(bits: int) -> Column:
        return classes.bitwiseAND(F.lit(bits)) != 0

    return (
        F.when(classes == MISSING, "double")
        .when(classes == FLAG, "boolean")
        .when(classes.isNull() | has(TEXT | FLAG), "string")
        .when(has(FRACTION), "double")
        .when(has(HUGE), "string")
        .when(has(UNSIGNED), F.when(has(NEGATIVE | MISSING), "string").otherwise("decimal(20,0)"))
        .when(has(MISSING), "double")
        .otherwise("bigint")
    )


def inferred(texts: DataFrame) -> DataFrame:
    """Rows of column, type and number of present values for the columns of a text frame, from one aggregate."""
    names = texts.columns
    values = [F.col(f"`{name}`") for name in names]
    sums = [c.alias(f"{kind}{i}") for i, v in enumerate(values) for kind, c in (("c", F.bit_or(class_of(v))), ("n", F.count(v)))]
    rows = [F.struct(F.lit(name).alias("column"), type_of(F.col(f"c{i}")).alias("type"), F.col(f"n{i}").alias("present")) for i, name in enumerate(names)]
    return texts.agg(*sums).select(F.inline(F.array(*rows)))


def typed(value: Column, kind: str) -> Column:
    """A text column as the type inferred for it."""
    if kind == "string":
        return value
    return F.lower(value).try_cast(kind) if kind == "boolean" else _trimmed(value).try_cast(kind)
