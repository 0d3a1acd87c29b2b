"""Small tables with every odd row an operator must take."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names operators might use themselves."""

    def make(pairs, extra=("score", "fp", "stats", "label", "spans")):
        rows = [(i, t, None, "s", None if t is None else len(t), *(["x"] * len(extra))) for i, t in pairs]
        return spark.createDataFrame(rows, DOCUMENTS + "".join(f", {c} string" for c in extra))

    return make


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
