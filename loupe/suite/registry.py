"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator's name."""

    def register(run):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digits(column: str | Column, places: int = 4) -> Column:
    """Round, so that sums in another order compare equal; -0.0 becomes 0.0."""
    name = column if isinstance(column, str) else None
    rounded = F.round(F.col(column) if name else column, places) + F.lit(0.0)
    return rounded.alias(name) if name else rounded


def rounded(df: DataFrame, places: int = 4, **per_column: int) -> DataFrame:
    """Round every double column of a result."""
    return df.select(
        *[
            digits(c, per_column.get(c, places)) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def line_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with values missing by rule: the given tables have no NULLs."""
    lines = table(spark, folder, "lineitem")
    return lines.withColumns(
        {
            "l_discount": F.when(F.col("l_linenumber") != 3, F.col("l_discount")),
            "l_tax": F.when(~F.col("l_linenumber").isin(3, 5), F.col("l_tax")),
            "l_returnflag": F.when(F.col("l_quantity") < 40, F.col("l_returnflag")),
        }
    )


#: the same table in SQL
LINE_GAPS = """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
         CASE WHEN l_linenumber <> 3 THEN l_discount END AS l_discount,
         CASE WHEN l_linenumber NOT IN (3, 5) THEN l_tax END AS l_tax,
         CASE WHEN l_quantity < 40 THEN l_returnflag END AS l_returnflag,
         l_linestatus, l_shipdate
  FROM lineitem"""


def R(expression: str, places: int = 4) -> str:
    """The SQL side of :func:`digits`."""
    return f"(round({expression}, {places}) + 0.0)"


def wide_sql(statement: str, rows: list[tuple[str, str]], names: tuple[str, str] = ("column", "value")) -> str:
    """SQL turning a one-row statement into (name, expression) rows."""
    picks = " UNION ALL ".join(f"SELECT '{n}' AS \"{names[0]}\", {e} AS {names[1]} FROM w" for n, e in rows)
    return f"WITH w AS ({statement}) {picks}"


def t_tails_sql(source: str) -> str:
    """SQL for two-sided p-values of Student's t: the columns of ``source``, which has t and dof, and p.

    The incomplete beta function as a continued fraction, evaluated forwards
    by recursion over one row a statistic.
    """
    return f"""
SELECT * EXCLUDE (x, flip, a, b, z, k, c, d, h, front),
  CASE WHEN t IS NULL THEN NULL WHEN flip THEN 1 - front * h / a ELSE front * h / a END AS p FROM (
  WITH RECURSIVE given AS (
    SELECT *, dof / (dof + t * t) AS x FROM ({source})
  ), sides AS (
    SELECT *, x >= (dof / 2 + 1) / (dof / 2 + 2.5) AS flip FROM given
  ), parts AS (
    SELECT *, CASE WHEN flip THEN 0.5 ELSE dof / 2 END AS a, CASE WHEN flip THEN dof / 2 ELSE 0.5 END AS b, CASE WHEN flip THEN 1 - x ELSE x END AS z FROM sides
  ), steps AS (
    SELECT *, 0 AS k, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * z / (a + 1)) AS d, 1 / (1 - (a + b) * z / (a + 1)) AS h FROM parts
    UNION ALL
    SELECT * EXCLUDE (even, odd, c1, d1) REPLACE (k + 1 AS k, 1 + odd / c1 AS c, 1 / (1 + odd * d1) AS d, h * d1 * c1 * (1 + odd / c1) / (1 + odd * d1) AS h) FROM (
      SELECT *, 1 + even / c AS c1, 1 / (1 + even * d) AS d1 FROM (
        SELECT *, (k + 1) * (b - k - 1) * z / ((a + 2 * k + 1) * (a + 2 * k + 2)) AS even,
          -(a + k + 1) * (a + b + k + 1) * z / ((a + 2 * k + 2) * (a + 2 * k + 3)) AS odd FROM steps WHERE k < 200))
  )
  SELECT *, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(z) + b * ln(1 - z)) AS front FROM steps WHERE k = 200)"""


def solved_sql(source: str, size: int) -> str:
    """CTEs ``g0``, ``g1``, ... that solve linear equations by Gauss-Jordan steps.

    ``source`` has rows (f, i, j, v): per f the matrix, and as column j = size
    the right side.  The last CTE's column j = size holds the solution.
    """
    steps = [f"g0 AS ({source})"]
    for k in range(size):
        steps.append(f"""g{k + 1} AS (
  SELECT a.f, a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v
  FROM g{k} a JOIN g{k} p ON p.f = a.f AND p.i = {k} AND p.j = {k} JOIN g{k} r ON r.f = a.f AND r.i = {k} AND r.j = a.j
  JOIN g{k} c ON c.f = a.f AND c.i = a.i AND c.j = {k})""")
    return ",\n".join(steps)
