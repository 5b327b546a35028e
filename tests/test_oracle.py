"""Every query on the reference's operators against its DuckDB oracle on the small tables
(the driver repeats this at sf0.01)."""

import os
import sys

import pytest

from conftest import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from estimark.plans.catalog import ORACLE, QUERIES  # noqa: E402
from oracle_check import compare, duck_con  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return duck_con(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    line = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert line.startswith("OK"), line


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["room_id", "task_id", "median"]
    assert df.count() > 0
