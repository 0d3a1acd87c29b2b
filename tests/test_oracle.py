"""Every report against its SQL oracle, with broadcast joins and with shuffled joins."""

import pytest
from conftest import SF_DIR

from check import oracle_connection, rows_of
from tillwright.catalog import MODELS, REPORTS
from tillwright.oracle import ORACLE
from tillwright.sources.star import StarSales


@pytest.fixture(scope="module")
def expected():
    con = oracle_connection(SF_DIR)
    answers = {}
    for name, sql in ORACLE.items():
        types = {r[0]: r[1] for r in con.execute("DESCRIBE " + sql).fetchall()}
        cursor = con.execute(sql)
        answers[name] = (types, rows_of([d[0] for d in cursor.description], cursor.fetchall()))
    return answers


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def test_every_report_has_an_oracle():
    assert set(ORACLE) == set(REPORTS)
    assert not set(MODELS) & set(REPORTS)


@pytest.mark.parametrize("name", REPORTS)
def test_matches_oracle(spark, expected, name):
    df = REPORTS[name](StarSales(spark, SF_DIR))
    types, want = expected[name]
    assert {column: SAME_TYPE[kind] for column, kind in df.dtypes} == types
    assert rows_of(df.columns, df.collect()) == want


@pytest.mark.parametrize("name", REPORTS)
def test_matches_oracle_when_every_join_shuffles(spark, shuffle_joins, expected, name):
    df = REPORTS[name](StarSales(spark, SF_DIR))
    assert rows_of(df.columns, df.collect()) == expected[name][1]
