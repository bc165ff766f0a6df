"""Every registered query against its SQL on the small driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import connect, differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, SQL[name]) == []


def test_every_query_of_the_plans_has_sql():
    own = {name for name, run in QUERIES.items() if run.__module__.startswith("trialframe.plans")}
    assert own <= set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["project", "rank", "fingerprint"]
