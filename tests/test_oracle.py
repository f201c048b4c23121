"""Every registered query against its SQL, exactly, at two sizes."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import differences


@pytest.mark.parametrize("size", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name, size):
    sf_dir = f"/root/testdata/sf{size}"
    assert differences(queries()[name](spark, sf_dir), oracle_sql()[name], sf_dir) == []


def test_every_query_has_sql():
    """All but corpus queries, some of which are beyond SQL and tested with their operators."""
    without = set(queries()) - set(oracle_sql())
    assert all(re.match(r"op\d+_|pipeline$", name) for name in without)
    assert set(oracle_sql()) <= set(queries())


def test_entry_gives_one_row(spark):
    assert entry(spark).count() == 1
