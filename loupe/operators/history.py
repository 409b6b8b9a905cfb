"""Retention over event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loupe.frames import col, require
from loupe.ordered import Sort, first_rows, with_neighbour


def keep_latest_n(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], n: int = 50) -> DataFrame:
    """The last n rows of each key, however many rows a key has."""
    require(df, *keys, *order_by)
    return first_rows(df, keys, [col(c).desc() for c in order_by], n).drop("rank")


def latest(df: DataFrame, order_by: Sequence[str], n: int = 50) -> DataFrame:
    """The last n rows of the whole table."""
    require(df, *order_by)
    return df.orderBy(*[col(c).desc() for c in order_by]).limit(n)


def collapse_consecutive(df: DataFrame, keys: Sequence[str], value: str, order_by: Sort) -> DataFrame:
    """The last row of each run of equal values, per key, in the given order."""
    require(df, *keys, value)
    following = with_neighbour(df.withColumn("_value", col(value)), ["_value"], order_by, keys, ahead=True)
    ends = F.col("_neighbour").isNull() | ~F.col("_neighbour._value").eqNullSafe(F.col("_value"))
    return following.where(ends).drop("_neighbour", "_value")
