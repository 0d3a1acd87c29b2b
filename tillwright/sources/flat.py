"""One wide table of clean sales lines, in memory or stored by month."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwright.operators.cleaning import MEASURES, clean, nan_to_null
from tillwright.operators.filters import EVERY, PARTITION_MONTH, FilterSpec, row_class
from tillwright.schema import PLACE, RAW_TYPES, SalesSchema
from tillwright.sources.order_report import straight_from_files, with_file_order


@dataclass(frozen=True)
class FlatSales:
    """Clean lines that already hold every role as a column."""

    clean_lines: DataFrame
    raw_lines: DataFrame | None = None
    schema: SalesSchema | None = None
    filters: FilterSpec = FilterSpec()
    order: str | None = None

    @classmethod
    def from_raw(cls, raw: DataFrame, schema: SalesSchema, order: str | None = None) -> FlatSales:
        """Clean some raw lines. ``order`` names the sortable column with their order, which is not data.

        A column called ``PLACE`` is that column if none is named, see ``with_file_order``. Frames
        straight from files need none. In others, what comes first is not known, and the value that
        sorts first stands for it.
        """
        source = cls.audited(raw, schema, order)
        return replace(source, clean_lines=clean(raw.drop(source.order) if source.order else raw, schema))

    @classmethod
    def audited(cls, raw: DataFrame, schema: SalesSchema, order: str | None = None) -> FlatSales:
        """Raw lines for the column-wise audits alone, which need no role."""
        return cls(raw, nan_to_null(raw), schema, order=order or (PLACE if PLACE in raw.columns else None))

    def where(self, spec: FilterSpec) -> FlatSales:
        return replace(self, filters=spec)

    def lines(self, *roles: str, rows: str = EVERY) -> DataFrame:
        """The asked-for roles plus the measures, one row per line; the scan reads nothing else."""
        df = self.filters.apply(self.clean_lines)
        wanted = row_class(rows)
        df = df if wanted is None else df.where(wanted)
        df = df.withColumn("order_key", F.col("order_id")) if "order_key" in roles else df
        return df.select(*dict.fromkeys([*roles, *[m for m in MEASURES if m in df.columns]]))

    def totals(self, *roles: str, rows: str = EVERY) -> DataFrame:
        """Like ``lines``, for plans that only add measures up; there is no join to sum before."""
        return self.lines(*roles, rows=rows)

    def raw(self, *roles: str) -> DataFrame:
        """Untouched lines (all columns, or the physical columns of some roles); filters do not apply."""
        return self.raw_lines.select(*[F.col(f"`{name}`") for name in self._raw_names(roles)])

    def _raw_names(self, roles: Sequence[str]) -> list[str]:
        if self.raw_lines is None or self.schema is None:
            raise ValueError("this table was opened without its raw lines")
        names = [c for c in self.raw_lines.columns if c != self.order]
        by_trimmed = {c.strip(): c for c in names}
        return [by_trimmed[self.schema.name(r)] for r in roles] if roles else names

    def weighted_raw(self, *roles: str, placed: bool = False) -> DataFrame:
        """``raw`` with the number of ``lines`` each row stands for.

        With ``placed``, ``place`` orders them: by the order column, else as the files hold them. Rows
        whose order isn't known share one place.
        """
        one = F.lit(1).cast("long").alias("lines")
        if not placed:
            return self.raw(*roles).select("*", one)
        names = [F.col(f"`{name}`") for name in self._raw_names(roles)]
        if self.order:
            return self.raw_lines.select(*names, one, F.col(f"`{self.order}`").alias("place"))
        if straight_from_files(self.raw_lines):
            return with_file_order(self.raw_lines, "place").select(*names, one, "place")
        return self.raw_lines.select(*names, one, F.lit(0).alias("place"))

    def raw_parts(self, placed: bool = False) -> list[DataFrame]:
        """The raw columns in groups to audit one by one, weighted."""
        return [self.weighted_raw(placed=placed)]

    def row_digests(self) -> DataFrame:
        """128 bits of each raw line's columns, as d1 and d2; nulls are told from their places."""
        raw = self.raw()
        floats = {f.name for f in raw.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
        values = [F.col(f"`{c}`") + 0.0 if c in floats else F.col(f"`{c}`") for c in raw.columns]  # zeros of either sign are equal
        parts = [part for value in values for part in (value.isNull(), value)]
        return raw.select(*[F.xxhash64(F.lit(n), *parts).alias(f"d{n}") for n in (1, 2)])

    def order_ids(self) -> DataFrame:
        """The order ids of all raw lines."""
        return self.raw("order_id")

    def raw_name(self, role: str) -> str:
        if self.schema is None:
            raise ValueError("this table was opened without its schema")
        return self.schema.name(role)


def summarised(lines: DataFrame, measures: Sequence[str], *role_sets: tuple[str, ...]) -> list[FlatSales]:
    """One source per set of roles, over lines summed by those roles, all from a single pass.

    Reports only add measures up, so they answer from the few summed rows as they would from the
    lines. The frame must carry ``kind``, which keeps the row classes apart. Lines are summed by all
    roles at once first, so that only those sums are repeated per set. Frames that read several of the
    sources as parts of one plan share that first sum's exchange: every source asks for all measures,
    so that it is the same for all.
    """
    keys = list(dict.fromkeys(["kind", *[role for roles in role_sets for role in roles]]))
    sums = [F.sum(m).alias(m) for m in measures]
    per_set = lines.groupBy(*keys).agg(*sums).groupingSets([["kind", *roles] for roles in role_sets], *keys)
    summed = per_set.agg(F.grouping_id().alias("left_out"), *sums)
    # True of every group. No optimizer knows, and so none leaves out the measures a source doesn't use.
    holds_lines = reduce(Column.__or__, [F.col(m).isNotNull() for m in measures])

    def only(roles: tuple[str, ...]) -> DataFrame:
        left_out = sum(2 ** (len(keys) - 1 - i) for i, key in enumerate(keys) if key not in ("kind", *roles))
        return summed.where((F.col("left_out") == left_out) & holds_lines).select("kind", *roles, *measures)

    return [FlatSales(only(roles)) for roles in role_sets]


def write_sales_table(lines: DataFrame, path: str, mode: str = "error", rebalance: bool = True) -> None:
    """Store clean lines as Parquet by month, so a date filter reads only its months.

    The rebalance hint sizes the output files at run time: a month holding most of the lines is
    split over several tasks, small months share one. It shuffles the lines once; leave it out where
    they already come in date order, so that a task writes to few months anyway.
    """
    by_month = lines.withColumn(PARTITION_MONTH, F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("undated")))
    if rebalance:
        by_month = by_month.hint("rebalance", PARTITION_MONTH)
    by_month.write.mode(mode).partitionBy(PARTITION_MONTH).parquet(path)


def read_sales_table(spark: SparkSession, path: str) -> FlatSales:
    stored = spark.read.option("basePath", path).parquet(path)
    missing = set(RAW_TYPES) - set(stored.columns)
    if missing:
        raise ValueError(f"not a clean sales table, lacks {sorted(missing)}: {path}")
    return FlatSales(stored)
