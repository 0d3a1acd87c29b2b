"""The order report CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.fixed_values import MISSING_TOKENS
from tillwright.operators.type_lattice import inferred, typed
from tillwright.schema import ORDER_REPORT, PLACE, RAW_TYPES, SalesSchema


def _typed(c: Column, to: str) -> Column:
    # Whole numbers may be written as 1.0, which a direct cast to INT refuses.
    return c.try_cast("decimal(18,2)").try_cast("int") if to == "int" else c.try_cast(to)


def present(text: Column) -> Column:
    """A field's text, or null for what means that it is missing."""
    return F.when(~text.isin(list(MISSING_TOKENS)), text)


def read_sales_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: SalesSchema = ORDER_REPORT,
    multi_line: bool = False,
    infer: bool = True,
) -> DataFrame:
    """Raw report: headers as in the file, missing-value tokens as null, numbers and flags typed.

    Every field is read as text, because a typed read would void unreadable numbers before the tokens
    are seen; dates stay text until cleaning. Columns that the schema doesn't know get the type that all
    of their values, in all files, allow; that takes a pass over those columns before the frame is
    returned. With ``infer`` off they stay text, and only the header line is read up front.
    ``multi_line`` accepts line breaks inside quotes, at the price of files that cannot be split.
    """
    reader = spark.read.options(header=True, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE")
    try:
        text = reader.csv(path if isinstance(path, str) else list(path))
    except AnalysisException as error:
        raise FileNotFoundError(f"sales report not found or not readable: {path}") from error
    roles = {physical: role for role, physical in schema.columns.items()}

    unknown = [name for name in text.columns if name.strip() not in roles]
    found = {}
    if infer and unknown:
        found = {r["column"]: r["type"] for r in inferred(text.select(*[present(F.col(f"`{name}`")).alias(name) for name in unknown])).collect()}

    def field(name: str) -> Column:
        kind = RAW_TYPES.get(roles.get(name.strip(), ""), "string")
        if name in found:
            return typed(present(F.col(f"`{name}`")), found[name]).alias(name)
        return (present(F.col(f"`{name}`")) if kind in ("string", "date") else _typed(present(F.col(f"`{name}`")), kind)).alias(name)

    return text.select(*[field(name) for name in text.columns])


def straight_from_files(frame: DataFrame) -> bool:
    """Whether nothing but column and row choices lies between a frame and its files."""
    node = frame._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    return node.nodeName() in ("LogicalRelation", "LogicalRelationWithTable") or str(node.nodeName()).startswith("Relation")


def with_file_order(file_frame: DataFrame, name: str = PLACE) -> DataFrame:
    """Add a sortable place (file, block, row) to a frame read directly from files.

    The place is taken at the scan and is a column like any other from then on: joins, caches and
    shuffles carry it, and it orders the rows as the files hold them, files by path. Of a frame that
    was joined, shuffled or cached before, the order in its files is lost.
    """
    if not straight_from_files(file_frame):
        raise ValueError("the order of these rows is not known: take it with with_file_order when they are read, or name a column that has it")
    place = F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return file_frame.select("*", place.alias(name))
