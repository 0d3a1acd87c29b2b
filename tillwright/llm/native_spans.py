"""Regular-expression matches with their places, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"
#: Matches that are placed together.
CHUNK = 256


def spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, value), counted in code points.

    The matches and the texts between them come from two passes of the same pattern and are summed up
    side by side. ``guard`` is a cheap condition without which there is no match. Patterns must not
    match the empty string, and repeated groups need possessive quantifiers, since the engine would
    otherwise recurse once per repetition.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    steps = F.zip_with(between, found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(seen: Column, x: Column) -> Column:
        begin = seen["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["value"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["value"].isNull(), seen["out"]).otherwise(F.concat(seen["out"], span)).alias("out"))

    all_spans = F.aggregate(steps, start, step, lambda seen: seen["out"])
    return all_spans if guard is None else F.when(guard, all_spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def wanted_spans(text: Column, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    """The same for those matches whose value is wanted, in time linear in the text however many there are."""
    steps = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")),
    )
    nothing = F.array().cast(f"array<{SPAN}>")

    def step(seen: Column, x: Column) -> Column:
        begin = seen["at"] + x["gap"]
        end = begin + F.coalesce(F.length(x["value"]), F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value")))
        keep = x["value"].isNotNull() & wanted(x["value"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(seen["out"], span)).otherwise(seen["out"]).alias("out"))

    def chunk(seen: Column, some: Column) -> Column:
        start = F.struct(seen["at"].alias("at"), nothing.alias("out"))
        whole = F.aggregate(some, start, step)
        return _with(whole, lambda w: F.struct(w["at"].alias("at"), F.concat(seen["out"], F.array(w["out"])).alias("out")))

    def placed(all_steps: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_steps), F.lit(CHUNK))
        chunks = F.transform(starts, lambda at: F.slice(all_steps, at, F.lit(CHUNK)))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("out"))
        return F.aggregate(chunks, empty, chunk, lambda seen: F.flatten(seen["out"]))

    return _with(steps, placed)


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """What is made of a value that is used several times and computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
