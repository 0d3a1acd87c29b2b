"""Types of CSV columns no schema knows, against pandas; first samples in the order of the files."""

import csv
import random

import pandas as pd
import pytest
from conftest import rows, sales
from pyspark.sql import functions as F

from tillwright.operators import type_lattice
from tillwright.plans import quality
from tillwright.schema import ORDER_REPORT, SalesSchema
from tillwright.sources import FlatSales, read_sales_csv, with_file_order

NO_SCHEMA = SalesSchema({})
NAMES = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "uint64": "decimal(20,0)"}

COLUMNS = {
    "whole": ["1", "-2", "007", "+4"], "gaps": ["1", "", "3", "NA"], "blanks": [" 1", "2 ", "\t3", "4"], "decimals": ["1.5", "2", ".5", "1."],
    "powers": ["1e5", "2E-3", "1", "5e-400"], "endless": ["inf", "-Infinity", "1", "+INF"], "too_big": ["1e400", "1", "2", "3"],
    "edge": ["9223372036854775807", "-9223372036854775808", "0", "1"], "unsigned": ["9223372036854775808", "18446744073709551615", "0", "1"],
    "mixed_signs": ["9223372036854775808", "-1", "0", "1"], "unsigned_gap": ["9223372036854775808", "", "0", "1"],
    "beyond": ["18446744073709551616", "1", "2", "3"], "flags": ["True", "false", "tRUE", "FALSE"], "flag_gap": ["True", "", "False", "True"],
    "flag_or_one": ["True", "1", "0", "False"], "letters": ["T", "F", "T", "F"], "hex": ["0x10", "1", "2", "3"], "underscore": ["1_000", "1", "2", "3"],
    "thousands": ["1,000", "1", "2", "3"], "nothing": ["", "NaN", "null", "N/A"], "dash": ["-", "1", "2", "3"], "half": ["1e", "1", "2", "3"],
    "dot": [".", "1", "2", "3"], "wide": ["１", "1", "2", "3"], "suffix": ["1.5f", "1", "2", "3"], "dates": ["04-30-22", "05-01-22", "", "x"], "inf_blank": ["inf ", "1", "2", "3"],
}


def write(path, columns, part=slice(None)):
    with open(path, "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(columns)
        out.writerows(list(zip(*columns.values(), strict=True))[part])
    return str(path)


@pytest.fixture
def read(spark, tmp_path):
    def run(columns):
        path = write(tmp_path / "table.csv", {"i": range(len(next(iter(columns.values())))), **columns})
        return FlatSales.audited(read_sales_csv(spark, path, NO_SCHEMA), NO_SCHEMA), pd.read_csv(path, low_memory=False)

    return run


def agree(src, theirs):
    kinds = {r["column"]: (r["type"], r["non_null"]) for r in quality.types(src).collect()}
    assert kinds == {c: (NAMES[str(theirs[c].dtype)], int(theirs[c].notna().sum())) for c in theirs.columns}
    absent = {r["column"]: r["missing"] for r in quality.missing(src).collect()}
    assert absent == {c: n for c, n in theirs.isna().sum().items() if n}
    assert {r["column"]: r["n_unique"] for r in quality.cardinality(src).collect()} == theirs.nunique().to_dict()


def test_columns_without_a_schema(read):
    gap = {"unsigned_gap": COLUMNS["unsigned_gap"]}
    src, theirs = read({c: v for c, v in COLUMNS.items() if c not in gap})
    agree(src, theirs)
    first = {r["column"]: r["sample"] for r in quality.types(src).collect()}
    assert first["whole"] == "1" and first["gaps"] == "1.0" and first["nothing"] == "N/A" and first["flags"] == "true" and first["dates"] == "04-30-22"
    # Here pandas takes the missing value for a text; the type is the same.
    lone, other = read(gap)
    assert dict(lone.raw().dtypes)["unsigned_gap"] == NAMES[str(other["unsigned_gap"].dtype)] == "string"


@pytest.mark.parametrize("seed", range(3))
def test_random_columns(read, seed):
    rng = random.Random(seed)
    values = ["", "NA", "0", "1", "-3", "12345678901", "2.5", "-1e3", "True", "FALSE", "x", " 7", "9223372036854775808"]
    columns = {f"c{i}": rng.choices(rng.sample(values, 1 + i % 3), k=12) for i in range(12)}
    # Whether huge whole numbers beside fractions are text depends on their order there; here they are numbers.
    # Beside missing values, the missing ones count as texts there.
    columns = {c: v for c, v in columns.items() if not ("9223372036854775808" in v and {"2.5", "-1e3", "", "NA"} & set(v))}
    agree(*read(columns))


def test_one_odd_value_in_the_last_file_decides(spark, tmp_path):
    columns = {"a": ["1"] * 9 + ["x"], "b": ["1"] * 10, "c": ["True"] * 9 + [""]}
    paths = [write(tmp_path / f"part{i}.csv", columns, slice(i * 5, i * 5 + 5)) for i in range(2)]
    kinds = dict(read_sales_csv(spark, paths, NO_SCHEMA).dtypes)
    assert kinds == {"a": "string", "b": "bigint", "c": "string"}
    assert dict(read_sales_csv(spark, paths[:1], NO_SCHEMA).dtypes) == {"a": "bigint", "b": "bigint", "c": "boolean"}
    assert set(dict(read_sales_csv(spark, paths, NO_SCHEMA, infer=False).dtypes).values()) == {"string"}


def test_known_columns_keep_their_types(spark, tmp_path):
    path = write(tmp_path / "report.csv", {"Qty": ["1.0", "2"], "Style": ["7", "8"], "rank": ["7", "8"]})
    assert dict(read_sales_csv(spark, path, ORDER_REPORT).dtypes) == {"Qty": "int", "Style": "string", "rank": "bigint"}


def test_inference_is_one_aggregate(spark):
    texts = spark.createDataFrame([("1", "a"), (None, "b")], "x string, `y z` string")
    found = type_lattice.inferred(texts)
    assert sorted(map(tuple, found.collect())) == [("x", "double", 1), ("y z", "string", 2)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    empty = type_lattice.inferred(texts.limit(0))
    assert [r["type"] for r in empty.collect()] == ["string", "string"]


# -- the first sample ---------------------------------------------------------------------------


@pytest.fixture
def several(spark, tmp_path):
    """Three files; column b is missing in the first, and c holds its file's and line's numbers."""
    for f in range(3):
        write(tmp_path / f"f{f}.csv", {"b": ["" if f == 0 else f"{9 - f}-{i}" for i in range(40)], "c": [f"{f}x{i}" for i in range(40)]})
    return spark.read.option("header", True).csv(str(tmp_path))


def first(frame, **more):
    return {r["column"]: r["sample"] for r in quality.types(FlatSales.audited(frame, NO_SCHEMA, **more)).collect()}


def test_several_files(several):
    assert first(several) == {"b": "8-0", "c": "0x0"}


def test_order_survives_shuffle_cache_and_join(spark, several):
    placed = with_file_order(several)
    assert first(placed.repartition(7, "c").orderBy(F.desc("c"))) == {"b": "8-0", "c": "0x0"}
    cached = placed.repartition(3).cache()
    assert first(cached) == {"b": "8-0", "c": "0x0"}
    assert first(cached.where("c > '1'")) == {"b": "8-0", "c": "1x0"}
    more = spark.createDataFrame([("2x7", 5), ("1x9", 6)], "c string, n int")
    assert first(cached.join(more, "c")) == {"b": "8-9", "c": "1x9", "n": "6"}
    cached.unpersist()


def test_a_named_column_gives_the_order(spark):
    frame = spark.createDataFrame([(3, "a"), (1, None), (2, "b")], "t int, v string")
    src = FlatSales.audited(frame, NO_SCHEMA, order="t")
    assert rows(quality.types(src)) == [("v", "string", 2, "b")] and src.raw().columns == ["v"]


def test_unknown_order(spark, several):
    """No place can be taken after a shuffle or join; the value that sorts first is sampled, whatever the partitions."""
    for frame in (several.repartition(2), several.join(spark.range(1)), several.orderBy("c"), spark.createDataFrame([("b",), ("a",)], "v string")):
        with pytest.raises(ValueError, match="order of these rows is not known"):
            with_file_order(frame)
    for n in (1, 3, 8):
        assert first(several.repartition(n, "c")) == {"b": "7-0", "c": "0x0"}
    assert {r["column"]: r["sample"] for r in quality.types(sales(spark, {"qty": 2}, {"qty": 1})).collect()}["qty"] == "1"


def test_the_order_is_no_data(spark, several):
    placed = with_file_order(several)
    src = FlatSales.audited(placed, NO_SCHEMA)
    assert src.raw().columns == ["b", "c"] and {r["column"] for r in quality.cardinality(src).collect()} == {"b", "c"}
