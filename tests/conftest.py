import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from tillwright.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture
def shuffle_joins(spark):
    """Joins as on big tables: nothing is small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(df):
    (row,) = df.collect()
    return row.asDict()


def lines_frame(spark, *records, **defaults):
    """Raw lines named by role, with plain values for everything a test does not care about."""
    base = {
        "order_id": "o1",
        "date": "04-30-22",
        "status": "Shipped",
        "fulfilment": "Amazon",
        "service_level": "Standard",
        "style": "st1",
        "sku": "sk1",
        "category": "Kurta",
        "size": "M",
        "courier_status": "Shipped",
        "qty": 1,
        "amount": "10.00",
        "city": "Pune",
        "state": "GOA",
        "promotion_ids": None,
        "b2b": False,
    }
    data = [tuple({**base, **defaults, **r}.values()) for r in records]
    kinds = {"qty": "int", "b2b": "boolean"}
    schema = ", ".join(f"{name} {kinds.get(name, 'string')}" for name in base)
    return spark.createDataFrame(data, schema).withColumn("amount", _amount())


def _amount():
    from pyspark.sql import functions as F

    return F.col("amount").cast("decimal(18,2)")


def sales(spark, *records, **defaults):
    from tillwright.schema import RAW_TYPES, SalesSchema
    from tillwright.sources import FlatSales

    return FlatSales.from_raw(lines_frame(spark, *records, **defaults), SalesSchema({r: r for r in RAW_TYPES}))
