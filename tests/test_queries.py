"""Every registered query against its SQL; those without SQL must give rows."""

import pytest

import __spark_entry__ as entry
from check_queries import compare, duck
from loupe import suite

#: the optional operators have tests of their own
QUERIES, SQL = suite.QUERIES, suite.SQL
#: plans over all analyses and cluster searches, run on the smallest tables
LONG = {"run_plan_all", "cluster_analysis"}


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, "/root/testdata/sf0.01", name, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - LONG))
def test_gives_rows(spark, con, name):
    assert compare(spark, con, "/root/testdata/sf0.01", name, QUERIES[name], None) is None


@pytest.mark.parametrize("name", sorted(LONG))
def test_gives_rows_on_small_tables(spark, con, name):
    assert compare(spark, con, "/root/testdata/sf0.001", name, QUERIES[name], None) is None


def test_leading_dates_decide_no_column(spark, tmp_path):
    from loupe.suite.profiling import DOC_COLUMNS

    spark.range(400).selectExpr("id AS doc_id", "repeat('word ', 30) || id AS text", "'en' AS lang", "'web' || id % 3 AS source", "id * 7 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(9).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(400).selectExpr("id AS c_custkey", "'name ' || id AS c_name").write.parquet(f"{tmp_path}/customer.parquet")
    rows = QUERIES["infer_semantic_types_leading"](spark, str(tmp_path)).collect()
    assert sorted((r["ordinal"], r["column"]) for r in rows) == sorted([*enumerate([*[c for c, _ in DOC_COLUMNS], "due"]), (0, "ref"), (1, "due")])
    assert [r["column"] for r in rows if r["semantic_type"] == "datetime"] == ["written"]


def test_sql_has_a_query_for_every_key():
    assert set(SQL) <= set(QUERIES)


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"rank", "label", "value", "cum_pct"} <= set(rows[0].asDict())
