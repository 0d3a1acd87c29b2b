"""Session settings and lineage cuts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", app: str = "tillwright", **conf: str) -> SparkSession:
    """Single-machine session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tillwright-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def share_code(spark: SparkSession) -> None:
    """Let Python workers that share this machine's folders import the package; others get it as py-files."""
    folder = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, folder])


def settle(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder, so lost executors cost no recomputation."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
