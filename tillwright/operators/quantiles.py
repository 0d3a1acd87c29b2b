"""Exact quantiles by successive refinement.

Sorting or counting all values in one task does not scale, and sketches are not exact. Here values
are turned into integers first. A pass divides the range still in question into at most 2^16 intervals and counts the
rows per interval; the running counts say which interval holds each wanted rank, and the next pass
looks only into those. Passes shuffle interval counts, never rows, and only the few intervals found
(at most two per quantile and column) come back to the driver. Two passes suffice for ranges up to
2^32, four for any 64-bit range.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwright.operators.rollups import union_all

INTERVALS_PER_PASS = 2**16


@dataclass
class _Search:
    """The search for some ranks of one column. Values are offsets from the smallest one."""

    column: str
    smallest: int
    # Interval width of every pass to come; each divides the one before.
    widths: list[int]
    # Wanted rank -> the interval it is in and its rank inside.
    places: dict[int, tuple[int, int]]
    # Width of the intervals in ``places``.
    width: int

    @classmethod
    def over(cls, column: str, bounds: Row, ranks: set[int]) -> _Search:
        span = bounds["max"] - bounds["min"] + 1
        passes = max(1, math.ceil(span.bit_length() / 16))
        base = 1
        while base**passes < span:
            base *= 2
        widths = [base**i for i in reversed(range(passes))]
        return cls(column, bounds["min"], widths, {rank: (0, rank) for rank in ranks}, base**passes)

    def located(self, values: DataFrame) -> DataFrame:
        """One pass: the intervals of the next width that hold a wanted rank, with the rows before them."""
        width, parts = self.widths[0], self.width // self.widths[0]
        offset = f"(`{self.column}` - {self.smallest})"
        outer = sorted({interval for interval, _ in self.places.values()})
        counts = (
            values.where(f"{offset} div {self.width} IN ({', '.join(map(str, outer))})")
            .groupBy(F.expr(f"{offset} div {width}").alias("inner"))
            .agg(F.count(F.lit(1)).alias("n"))
            .withColumn("outer", F.expr(f"inner div {parts}"))
        )
        running = Window.partitionBy("outer").orderBy("inner").rowsBetween(Window.unboundedPreceding, -1)
        wanted = " OR ".join(
            f"(outer = {interval} AND {rank} >= before AND {rank} < before + n)" for interval, rank in self.places.values()
        )
        placed = counts.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0)))
        return placed.where(wanted).select(F.lit(self.column).alias("column"), "outer", "inner", "before", "n")

    def narrow(self, found: list[Row]) -> None:
        for rank, (interval, inside) in self.places.items():
            (row,) = [r for r in found if r["outer"] == interval and r["before"] <= inside < r["before"] + r["n"]]
            self.places[rank] = (row["inner"], inside - row["before"])
        self.width = self.widths.pop(0)

    def value(self, rank: int) -> int:
        return self.smallest + self.places[rank][0]


@dataclass(frozen=True)
class _Units:
    """How a column's values become integers in the same order, and how those are read back.

    Decimals count their last place. Floating numbers use the integer that their bits spell, negative
    for negative ones; as these integers fill their range, either sign is searched by itself.
    """

    rule: str
    scale: int | None

    @classmethod
    def of(cls, column: str, kind: T.DataType) -> _Units:
        name = f"`{column}`"
        if isinstance(kind, T.DecimalType) and kind.precision <= 18:
            return cls(f"CAST({name} * {10**kind.scale} AS BIGINT)" if kind.scale else f"CAST({name} AS BIGINT)", kind.scale)
        if isinstance(kind, T.IntegralType):
            return cls(f"CAST({name} AS BIGINT)", 0)
        if not isinstance(kind, (T.FractionalType, T.DecimalType)):
            raise TypeError(f"{column} is not a number")
        # The exponent from a logarithm may be one off at powers of two, and is put right.
        size = f"abs(CAST({name} AS DOUBLE))"
        guess = f"greatest(floor(log2({size})), -1022)"
        exponent = f"({guess} + CASE WHEN {size} / power(2D, {guess}) >= 2 THEN 1 WHEN {size} / power(2D, {guess}) < 1 AND {guess} > -1022 THEN -1 ELSE 0 END)"
        normal = f"CAST({exponent} + 1023 AS BIGINT) * {1 << 52} + CAST(({size} / power(2D, {exponent}) - 1) * {1 << 52} AS BIGINT)"
        tiny = f"CAST({size} * power(2D, 1000) * power(2D, 74) AS BIGINT)"
        bits = (
            f"CASE WHEN {size} = 0 THEN 0L WHEN {size} = double('infinity') THEN {0x7FF << 52}L "
            f"WHEN {size} < {2.0**-1022!r}D THEN {tiny} WHEN isnan({size}) THEN NULL ELSE {normal} END"
        )
        return cls(f"CASE WHEN {name} < 0 THEN -({bits}) ELSE {bits} END", None)

    def value(self, unit: int) -> float:
        if self.scale is not None:
            return unit / 10**self.scale
        (size,) = struct.unpack("<d", struct.pack("<q", abs(unit)))
        return -size if unit < 0 else size


def exact_quantiles(df: DataFrame, columns: Iterable[str], probs: Mapping[str, float]) -> dict[str, dict[str, float | None]]:
    """Linearly interpolated quantiles of numbers of any type: column -> name in ``probs`` -> value.

    Nulls and NaN are no values; a column without values has no quantiles (None). Decimals of more than
    18 digits are taken as floating numbers.
    """
    columns = list(columns)
    units = {c: _Units.of(c, df.schema[c].dataType) for c in columns}
    # Below zero and from zero on are columns of their own, so that no difference overflows.
    halves = {c: (f"{c}<", f"{c}>") for c in columns}
    found = df.selectExpr(*[f"{unit.rule} AS `{c}`" for c, unit in units.items()])
    split = found.selectExpr(
        *[f"CASE WHEN `{c}` {sign} 0 THEN `{c}` END AS `{half}`" for c in columns for half, sign in zip(halves[c], ("<", ">="), strict=True)]
    )
    bounds = split.agg(
        *[F.struct(F.min(f"`{h}`").alias("min"), F.max(f"`{h}`").alias("max"), F.count(f"`{h}`").alias("rows")).alias(h) for h in split.columns]
    ).first()
    rows = {c: sum(bounds[h]["rows"] for h in halves[c]) for c in columns}
    positions = {c: {name: p * (rows[c] - 1) for name, p in probs.items()} for c in columns if rows[c]}

    def place(column: str, rank: int) -> tuple[str, int]:
        """The half that holds a rank, and the rank in it."""
        below, above = halves[column]
        return (below, rank) if rank < bounds[below]["rows"] else (above, rank - bounds[below]["rows"])

    ranks: dict[str, set[int]] = {}
    for c, wanted in positions.items():
        for at in wanted.values():
            for rank in (math.floor(at), math.ceil(at)):
                half, inside = place(c, rank)
                ranks.setdefault(half, set()).add(inside)
    searches = {half: _Search.over(half, bounds[half], inside) for half, inside in ranks.items()}
    while open_searches := [s for s in searches.values() if s.widths]:
        # All columns share a job per pass.
        passes = [s.located(split.select(F.col(f"`{s.column}`"))) for s in open_searches]
        located = union_all(passes).collect()
        for search in open_searches:
            search.narrow([row for row in located if row["column"] == search.column])

    def value(column: str, rank: int) -> float:
        half, inside = place(column, rank)
        return units[column].value(searches[half].value(inside))

    def interpolated(column: str, at: float) -> float:
        low, high = value(column, math.floor(at)), value(column, math.ceil(at))
        return low if low == high else low + (high - low) * (at - math.floor(at))

    return {c: {name: interpolated(c, positions[c][name]) if c in positions else None for name in probs} for c in columns}
