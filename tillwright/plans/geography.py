"""Sales by state and city."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwright.fixed_values import UNKNOWN_PLACE
from tillwright.functions.numbers import ratio
from tillwright.operators.rollups import orders, qty, rev, rollup_by, table, top_k


def _states(src) -> DataFrame:
    known = src.totals("state").where(F.col("state") != UNKNOWN_PLACE)
    return rollup_by(known, ["state"], rev(), orders(), qty())


def state_summary(src) -> DataFrame:
    return table(_states(src).orderBy(F.desc("rev"), "state"))


def top_states(src, k: int = 20) -> DataFrame:
    return table(top_k(_states(src), "rev", k, ["state"]))


def state_shares(src, k: int = 10) -> DataFrame:
    """Revenue shares of the top states, among themselves and of all known states."""
    known = _states(src).select("state", "rev")
    everything = known.agg(F.sum("rev")).scalar()
    # The window runs over the k rows kept, no more.
    among = F.sum("rev").over(Window.partitionBy())
    return table(
        top_k(known, "rev", k, ["state"]).select(
            "state",
            "rev",
            F.round(ratio(F.col("rev"), among), 6).alias("share_of_top"),
            F.round(ratio(F.col("rev"), everything), 6).alias("share_of_all"),
        )
    )


def top_cities(src, k: int = 25) -> DataFrame:
    known = src.totals("city").where(F.col("city") != UNKNOWN_PLACE)
    return table(top_k(rollup_by(known, ["city"], rev(), orders()), "rev", k, ["city"]))
