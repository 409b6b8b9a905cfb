"""The registered queries against their SQL."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck
from loupe.llm import queries

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, queries.QUERIES[name], queries.SQL[name]) is None


def test_one_query_for_each_operator():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(queries.QUERIES) <= names


def test_licences_are_own_inherited_and_unknown(spark):
    found = queries.QUERIES["op6_licenses"](spark, FOLDER).groupBy("origin").count().collect()
    counts = {r["origin"]: r["count"] for r in found}
    assert counts["own"] > 30 and counts["inherited"] > 30 and counts[None] > 500
