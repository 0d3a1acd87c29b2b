"""Equal-width histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Exactly ``bins`` bins between the smallest and largest value, empty ones included."""
    values = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    bounds = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    width = (hi - lo) / float(bins)
    # With a single distinct value every row belongs to the first bin.
    position = F.coalesce(F.floor((F.col("x") - lo) / F.nullif(width, F.lit(0.0))), F.lit(0))
    filled = values.select(F.least(position, F.lit(bins - 1)).alias("bin"), F.lit(1).alias("n"))
    empty = df.sparkSession.range(bins).select(F.col("id").alias("bin"), F.lit(0).alias("n"))
    counts = filled.unionByName(empty).groupBy("bin").agg(F.sum("n").alias("cnt"))
    return counts.where(lo.isNotNull()).select(
        "bin", (lo + F.col("bin") * width).alias("lo"), (lo + (F.col("bin") + 1) * width).alias("hi"), "cnt"
    ).orderBy("bin")


def round_histogram(df: DataFrame, column: str, most: int) -> DataFrame:
    """At most ``most`` bins with round edges: multiples of 1, 2 or 5 times a power of ten.

    The step is the smallest such number with which the bins from the smallest to the largest value are
    few enough; a bin holds its lower edge. A single distinct value has the bin of step 1 around it.
    """
    if most < 3:
        raise ValueError("round edges need room for three bins")
    values = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    power = "floor(log10((hi - lo) / {}D)) + {}"
    steps = [f"{m}D * power(10D, {p})" for ahead in (0, 1) for m in (1, 2, 5) for p in [power.format(most, ahead)]]
    smaller = [f"{m}D / power(10D, -({p}))" for ahead in (0, 1) for m in (1, 2, 5) for p in [power.format(most, ahead)]]
    chosen = [f"CASE WHEN {power.format(most, i // 3)} < 0 THEN {low} ELSE {high} END" for i, (low, high) in enumerate(zip(smaller, steps, strict=True))]
    fits = f"filter(array({', '.join(chosen)}), s -> floor(hi / s) - floor(lo / s) < {most})[0]"
    edges = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).selectExpr("lo", "hi", f"CASE WHEN hi > lo THEN {fits} ELSE 1D END AS step")
    known = edges.selectExpr("struct(step, floor(lo / step) AS first, floor(hi / step) AS last) AS e").scalar()
    filled = values.select(F.floor(F.col("x") / known["step"]).alias("place"), F.lit(1).alias("n"))
    empty = df.sparkSession.range(most).select((F.col("id") + known["first"]).alias("place"), F.lit(0).alias("n"))
    counts = filled.unionByName(empty).groupBy("place").agg(F.sum("n").alias("cnt")).where(F.col("place") <= known["last"])
    lower, upper = F.col("place") * known["step"], (F.col("place") + 1) * known["step"]
    return counts.select((F.col("place") - known["first"]).alias("bin"), lower.alias("lo"), upper.alias("hi"), "cnt").orderBy("bin")
