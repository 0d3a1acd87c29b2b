"""Exact quantiles as part of a plan: nothing runs until the plan does.

A first aggregate takes a rank sketch of each column, whose error is at most 1 / ``ACCURACY`` of the rows. The
sketched values two errors to either side of a quantile enclose it. A second aggregate counts what lies
below and sketches what lies inside; that gives a far narrower enclosure, the same way. A third counts the
values in there one by one, and the running count names the value of the wanted rank. Each step sees the
results of the one before as a scalar subquery. Of n rows, a quantile's last enclosure has under n / 800,000
besides repeated values, which are counted, not listed; columns of up to ``FEW`` rows aren't narrowed.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rank error of the sketches, rows that need no sketch, and steps in which an enclosure is sketched.
ACCURACY, FEW, STEPS = 10_000, 100_000, 1_000


class _Number:
    """How a column is searched: whole numbers of its last place as BIGINT, all else as DOUBLE. Rules are SQL."""

    def __init__(self, name: str, kind: T.DataType):
        column = f"`{name}`"
        if not isinstance(kind, T.NumericType):
            raise TypeError(f"{name} is not a number")
        self.whole = isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.precision <= 18)
        self.unit = 10**kind.scale if isinstance(kind, T.DecimalType) else 1
        self.rule = f"CAST({column} * {self.unit} AS BIGINT)" if self.whole else f"CASE WHEN NOT isnan({column}) THEN CAST({column} AS DOUBLE) END"

    def around(self, value: str, side: str) -> str:
        """A sketched value, moved outwards by what is lost to a sketch's floating numbers."""
        if not self.whole:
            return value
        wide = f"CAST({value} AS DECIMAL(38,0))"
        return f"CAST(least(greatest({wide} {side} (floor(abs({wide}) / {2**50}) + 1), -{2**63 - 1}), {2**63 - 1}) AS BIGINT)"

    def entry(self, tag: int, value: str) -> str:
        pair = (value, "CAST(NULL AS DOUBLE)") if self.whole else ("CAST(NULL AS BIGINT)", value)
        return f"named_struct('tag', {tag}, 'w', {pair[0]}, 'f', {pair[1]})"

    def back(self, value: str) -> str:
        return f"(CAST({value}.w AS DOUBLE) / {float(self.unit)!r}D)" if self.whole else f"{value}.f"


def _sketch(x: str, percents: Iterable[float]) -> str:
    listed = ", ".join(f"{min(max(p, 0.0), 1.0)!r}D" for p in percents)
    return f"percentile_approx({x}, array({listed}), {ACCURACY})"


def _struct(fields: Mapping[str, str]) -> str:
    return f"named_struct({', '.join(f"'{name}', {rule}" for name, rule in fields.items())})"


def quantile_row(df: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """One row with a struct per column of ``df``, which holds the linearly interpolated quantiles by name.

    Columns are numbers of any type; nulls and NaN are no values, and a column without values has null
    quantiles. Decimals of more than 18 digits are taken as floating numbers.
    """
    wanted = list(probs.values())
    kinds = [_Number(f.name, f.dataType) for f in df.schema.fields]
    numbers = df.selectExpr(*[f"{kind.rule} AS x{i}" for i, kind in enumerate(kinds)])
    tags = [(f"t{i}_{j}", i, j) for i in range(len(kinds)) for j in range(len(wanted))]

    # Enclosures by the sketch of everything.
    ends = [p + side * 2 / ACCURACY for p in wanted for side in (-1, 1)]
    first = numbers.selectExpr(
        *[_struct({"n": f"count(x{i})", "least": f"min(x{i})", "most": f"max(x{i})", "ends": _sketch(f"x{i}", ends)}) + f" AS s{i}" for i in range(len(kinds))]
    )

    def enclosed(i: int, j: int) -> str:
        few, place = f"s{i}.n <= {FEW}", f"({wanted[j]!r}D * (s{i}.n - 1))"
        return _struct({
            "low": f"CASE WHEN {few} THEN s{i}.least ELSE {kinds[i].around(f's{i}.ends[{2 * j}]', '-')} END",
            "high": f"CASE WHEN {few} THEN s{i}.most ELSE {kinds[i].around(f's{i}.ends[{2 * j + 1}]', '+')} END",
            "r0": f"floor({place})", "r1": f"ceil({place})", "part": f"{place} - floor({place})",
        })

    bounds = first.selectExpr(_struct({t: enclosed(i, j) for t, i, j in tags}) + " AS bounds").scalar()

    # What lies below and inside them, and narrower enclosures by a sketch of the inside.
    def counted(t: str, i: int) -> list[str]:
        within = f"x{i} BETWEEN bounds.{t}.low AND bounds.{t}.high"
        grid = _sketch(f"CASE WHEN {within} THEN x{i} END", [g / STEPS for g in range(STEPS + 1)])
        return [f"count_if(x{i} < bounds.{t}.low) AS below_{t}", f"count_if({within}) AS within_{t}", f"{grid} AS grid_{t}"]

    def narrowed(t: str, i: int) -> str:
        b, below, within = f"bounds.{t}", f"below_{t}", f"within_{t}"
        low_step = f"(CAST(floor(({b}.r0 - {below}) * {STEPS} / {within}) AS INT) - 1)"
        high_step = f"(CAST(ceil(({b}.r1 + 1 - {below}) * {STEPS} / {within}) AS INT) + 1)"
        low, high = (kinds[i].around(f"get(grid_{t}, {step})", side) for step, side in ((low_step, "-"), (high_step, "+")))
        return _struct({
            "outer": f"{b}.low", "below": below, "r0": f"{b}.r0", "r1": f"{b}.r1", "part": f"{b}.part",
            "low": f"CASE WHEN {within} > {FEW} AND {low_step} > 0 THEN greatest({b}.low, {low}) ELSE {b}.low END",
            "high": f"CASE WHEN {within} > {FEW} AND {high_step} < {STEPS} THEN least({b}.high, {high}) ELSE {b}.high END",
        })

    told = numbers.select("*", bounds.alias("bounds")).selectExpr("any_value(bounds) AS bounds", *[rule for t, i, _ in tags for rule in counted(t, i)])
    limits = told.selectExpr(_struct({t: narrowed(t, i) for t, i, _ in tags}) + " AS limits").scalar()

    # The values in those, counted; what is between both enclosures' lower ends is counted under no value.
    hits = [
        f"CASE WHEN x{i} BETWEEN limits.{t}.outer AND limits.{t}.high THEN {kinds[i].entry(tag, f'CASE WHEN x{i} >= limits.{t}.low THEN x{i} END')} END"
        for tag, (t, i, _) in enumerate(tags)
    ]
    found = numbers.select("*", limits.alias("limits")).selectExpr(f"inline(array_compact(array({', '.join(hits)})))")
    by_value = found.groupBy("tag", "w", "f").agg(F.count("*").alias("n"))
    lists = by_value.groupBy("tag").agg(F.expr("sort_array(collect_list(struct(struct(w, f) AS value, n))) AS found"))

    def of_tag(field: str) -> str:
        return f"CASE tag {' '.join(f'WHEN {tag} THEN limits.{t}.{field}' for tag, (t, _, _) in enumerate(tags))} END AS {field}"

    placed = lists.select("*", limits.alias("limits")).selectExpr("tag", "found", *map(of_tag, ("below", "r0", "r1", "part")))

    def here(rank: str, now: str) -> str:
        return f"CASE WHEN {rank} >= seen.place AND {rank} < seen.place + entry.n THEN entry.value ELSE seen.{now} END"

    nothing = "CAST(NULL AS STRUCT<w: BIGINT, f: DOUBLE>)"
    start = _struct({"place": "CAST(below AS BIGINT)", "low": nothing, "high": nothing})
    step = _struct({"place": "seen.place + entry.n", "low": here("r0", "low"), "high": here("r1", "high")})
    picked = placed.selectExpr("tag", "part", f"aggregate(found, {start}, (seen, entry) -> {step}) AS ends")

    def quantile(tag: int, i: int) -> str:
        low, high = kinds[i].back("ends.low"), kinds[i].back("ends.high")
        between = f"CASE WHEN {low} = {high} THEN {low} ELSE {low} + ({high} - {low}) * part END"
        missed = "CAST(raise_error('a rank lies outside of its enclosure') AS DOUBLE)"
        return f"max(CASE WHEN tag = {tag} THEN coalesce({between}, {missed}) END)"

    of_column = [{name: quantile(tag, i) for name, (tag, (_, of, _)) in zip(probs, ((n, t) for n, t in enumerate(tags) if t[1] == i), strict=True) if of == i} for i in range(len(kinds))]
    return picked.selectExpr(*[f"{_struct(fields)} AS `{c}`" for c, fields in zip(df.columns, of_column, strict=True)])
