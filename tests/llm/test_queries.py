"""Queries with SQL against it."""

import pytest

from lexquarry.llm.queries import ORACLES, QUERIES

from ..conftest import SMALL
from ..oracle import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    same_rows(spark, SMALL, QUERIES[name], ORACLES[name])
