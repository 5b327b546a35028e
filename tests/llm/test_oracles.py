"""The training-data queries that SQL can express, against DuckDB on the small tables."""

import os
import sys

import pytest

from conftest import SF_SMALL
from estimark.llm.queries import ORACLE, QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

from oracle_check import compare, duck_con  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, name):
    line = compare(spark, duck_con(SF_SMALL), name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert line.startswith("OK"), line
