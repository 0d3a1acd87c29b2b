"""Helpers the corpus operators share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwright.session import settle

__all__ = [
    "drop_table",
    "fresh_name",
    "heavy_from",
    "held_out",
    "label_sample",
    "read_table",
    "settle",
    "shared_folder",
    "text_or_empty",
    "written",
]

FOLDS = 5


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the driver and all executors can read and write."""
    settle(spark.range(0))
    return spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """A frame as a Parquet table in the shared folder, and that table's path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of ``written`` that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def heavy_from(counts: DataFrame, weight: str, most: int) -> int:
    """The least power of two such that at most ``most`` rows weigh that much; 0 if all rows are few enough.

    Rows that weigh less are light: if there are any, each stands for under 2 / ``most`` of the total weight.
    """
    by_size = counts.groupBy(F.floor(F.log2(weight)).cast("int").alias("size")).agg(F.count("*").alias("n"))
    sizes, seen = sorted(((r["size"], r["n"]) for r in by_size.collect()), reverse=True), 0
    for size, n in sizes:
        seen += n
        if seen > most:
            return 2 ** (size + 1)
    return 0


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that no model may learn from; a null id is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def label_sample(labels: DataFrame, target: str, most: int) -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, drawn by hash: columns doc_id, label.

    An id with several labels takes their majority, ties count as 1; null ids and labels are left out.
    The sample has ``most`` rows of two numbers at most, so it may be broadcast.
    """
    rows = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label"))
        .where("doc_id is not null and label is not null")
        .where(~held_out(F.col("doc_id")))
    )
    by_id = rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    return by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
