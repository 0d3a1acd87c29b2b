"""Distinct values from sketches, stored and merged."""

import pytest
from conftest import SF_DIR

from tillwright.plans import quality
from tillwright.schema import SalesSchema
from tillwright.sources import FlatSales
from tillwright.sources.star import StarSales


def source(spark, numbers):
    frame = spark.createDataFrame([(i, f"v{i % 1000}", None) for i in numbers], "id long, few string, none string")
    return FlatSales.audited(frame, SalesSchema({}))


def test_stored_sketches_merge_as_files_arrive(spark, tmp_path):
    """Two overlapping loads, sketched apart and stored, against all lines sketched at once and counted."""
    for i, load in enumerate((range(0, 30_000), range(20_000, 60_000))):
        quality.sketches(source(spark, load)).write.parquet(f"{tmp_path}/{i}")
    stored = [spark.read.parquet(f"{tmp_path}/{i}") for i in range(2)]
    got = {r["column"]: r["n_unique"] for r in quality.estimated(quality.merged(*stored)).collect()}
    at_once = {r["column"]: r["n_unique"] for r in quality.cardinality(source(spark, range(60_000)), approx=True).collect()}
    for column, exact in {"id": 60_000, "few": 1000, "none": 0}.items():
        assert got[column] == pytest.approx(exact, rel=quality.SKETCH_ERROR)
        assert at_once[column] == pytest.approx(exact, rel=quality.SKETCH_ERROR)


def test_sketches_stay_small(spark):
    (row,) = quality.sketches(source(spark, range(50_000))).where("column = 'id'").collect()
    assert len(row["sketch"]) < 20_000


def test_estimates_are_near(spark):
    rows = quality.estimates_checked(StarSales(spark, SF_DIR)).collect()
    assert len(rows) == 16 and all(r["near"] for r in rows)
