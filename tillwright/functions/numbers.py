"""Rounding, ratios and money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def half_even(c: Column, digits: int) -> Column:
    """Round a double half-to-even after scaling, the way array libraries round."""
    scale = float(10**digits)
    return F.rint(c.cast("double") * scale) / scale


def ratio(part: Column, whole: Column) -> Column:
    """Double quotient, null when the denominator is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100.0


def money_to_double(df: DataFrame) -> DataFrame:
    """Sums stay DECIMAL until here, so they do not depend on the order of addition."""
    money = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({name: F.col(name).cast("double") for name in money})
