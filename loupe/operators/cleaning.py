"""Cleaning steps, alone or as an audited list."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from loupe.frames import col, is_numeric, known_value, number, require
from loupe.operators import prepare
from loupe.ordered import Sort, fill_in_order
from loupe.quantiles import column_quantiles
from loupe.session import durable

log = logging.getLogger(__name__)


def iqr_fences(df: DataFrame, column: str) -> tuple[float | None, float | None, float | None, float | None]:
    """First and third quartile, lower and upper 1.5-IQR fence."""
    q1, q3 = column_quantiles(df, [column], [0.25, 0.75])[column]
    if q1 is None:
        return None, None, None, None
    reach = 1.5 * (q3 - q1)
    return q1, q3, q1 - reach, q3 + reach


def most_frequent(df: DataFrame, column: str) -> Any:
    """The smallest of the most frequent values, or None."""
    require(df, column)
    known = df.select(known_value(df, column).alias("v")).where(F.col("v").isNotNull())
    top = known.groupBy("v").count().orderBy(F.desc("count"), F.asc("v")).first()
    return top["v"] if top else None


@dataclass(frozen=True)
class Change:
    """What a step does to a table of the same columns, its figures already read.

    A step that ``moves`` rows shuffles them or writes them itself.
    """

    apply: Callable[[DataFrame], DataFrame]
    moves: bool = False


UNCHANGED = Change(lambda table: table)


def fill_missing(
    df: DataFrame, column: str | Sequence[str], method: str = "median", value: Any = None,
    order_by: Sort = (), partition_by: Sequence[str] = (),
) -> DataFrame:
    """Fill NULLs by mean, median, mode, forward, backward or a custom value.

    A method that does not apply falls back to the median for numbers and the
    mode for anything else.  An unknown column leaves the table as it is.
    Several columns are filled alike; forward and backward they share one
    sorted run.
    """
    return _fill(df, column, method, value, order_by, partition_by).apply(df)


def _names(column: str | Sequence[str]) -> list[str]:
    return [column] if isinstance(column, str) else list(column)


def _fill(df: DataFrame, column: str | Sequence[str], method: str, value: Any, order_by: Sort, partition_by: Sequence[str]) -> Change:
    known = [c for c in _names(column) if c in df.columns]
    if len(known) < len(_names(column)):
        log.info("skipped: no column among %r", sorted(set(_names(column)) - set(known)))
    if not known:
        return UNCHANGED
    if method in ("forward", "backward"):
        return Change(lambda table: fill_in_order(table, known, order_by, partition_by, forward=method == "forward"), moves=True)
    changes = [_fill_one(df, c, method, value) for c in known]
    return Change(lambda table: reduce(lambda t, change: change.apply(t), changes, table))


def _fill_one(df: DataFrame, column: str, method: str, value: Any) -> Change:
    kind = df.schema[column].dataType
    numeric = is_numeric(kind)
    if method == "mean" and numeric:
        return _fill_number(column, df.agg(F.avg(number(column))).first()[0])
    if method == "custom" and value is not None:
        return _fill_value(column, value, kind)
    if method == "mode" or not numeric:
        return _fill_value(column, most_frequent(df, column), kind)
    return _fill_number(column, column_quantiles(df, [column], [0.5])[column][0])


def _fill_value(column: str, fill: Any, kind: T.DataType) -> Change:
    if fill is None:
        return UNCHANGED
    return Change(lambda table: table.withColumn(column, F.coalesce(known_value(table, column), F.lit(fill).cast(kind))))


def _fill_number(column: str, fill: float | None) -> Change:
    return UNCHANGED if fill is None else Change(lambda table: table.withColumn(column, F.coalesce(number(column), F.lit(float(fill)))))


def handle_outliers(df: DataFrame, column: str, method: str = "keep") -> DataFrame:
    """Clip values to the IQR fences (cap), drop rows outside (remove) or do nothing (keep).

    Removing also drops rows without a value.  Fewer than 5 values: no change.
    """
    return _limit(df, column, method).apply(df)


def _limit(df: DataFrame, column: str, method: str) -> Change:
    if column not in df.columns or method not in ("cap", "remove"):
        return UNCHANGED
    known = df.select(number(column).alias("v")).where(F.col("v").isNotNull())
    if len(known.take(5)) < 5:
        return UNCHANGED
    _, _, lower, upper = iqr_fences(df, column)
    if method == "remove":
        return Change(lambda table: table.where(col(column).between(F.lit(lower), F.lit(upper))))
    clipped = F.greatest(F.least(number(column), F.lit(upper)), F.lit(lower))
    return Change(lambda table: table.withColumn(column, F.when(number(column).isNotNull(), clipped)))


def drop_duplicates(
    df: DataFrame, keep: str = "first", subset: Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """One row per distinct row, or per distinct ``subset``.

    Copies of a whole row are equal, so first and last differ only with a
    subset; then ``order_by`` says which copy wins.  Copies are reduced before
    the shuffle, so a group of any size stays cheap.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    if subset is None:
        return df.dropDuplicates()
    require(df, *subset, *order_by)
    if not order_by:
        raise ValueError("a subset needs order_by to say which copy is kept")
    rest = [c for c in df.columns if c not in subset]
    row = F.struct(*[col(c) for c in rest], F.lit(1).alias("_one"))
    pick = F.min_by if keep == "first" else F.max_by
    place = F.struct(*[col(c) for c in order_by])
    kept = df.groupBy(*[col(c) for c in subset]).agg(pick(row, place).alias("_row"))
    return kept.select(
        *[col(c) if c in subset else F.col("_row")[c].alias(c) for c in df.columns]
    )


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct value besides NULL."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    fields = [f for f in fields if not isinstance(f.dataType, T.MapType)]
    if not fields:
        return []
    row = df.agg(
        *[
            F.coalesce(F.min(known_value(df, f.name)) == F.max(known_value(df, f.name)), F.lit(True)).alias(f"c{i}")
            for i, f in enumerate(fields)
        ]
    ).first()
    return [f.name for f, constant in zip(fields, row) if constant]


def drop_constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop constant columns among those listed; ``None`` looks at all."""
    return df.drop(*constant_columns(df, columns))


def drop_missing_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows with no value in any of the columns given."""
    require(df, *columns)
    return df.na.drop(subset=list(columns))


def _change(df: DataFrame, step: Mapping[str, Any]) -> Change:
    """The step with the figures it needs of the table."""
    kind = step.get("type", "")
    if kind == "drop_columns":
        return Change(lambda table: prepare.drop_columns(table, step.get("columns", [])))
    if kind == "fill_missing":
        return _fill(
            df, step.get("column", ""), step.get("method", "median"), step.get("fill_value"),
            step.get("order_by", ()), step.get("partition_by", ()),
        )
    if kind == "handle_outliers":
        return _limit(df, step.get("column", ""), step.get("method", "keep"))
    if kind == "drop_duplicates":
        return Change(lambda table: drop_duplicates(table, step.get("keep", "first"), step.get("subset"), step.get("order_by", ())), moves=True)
    if kind == "drop_constant_columns":
        constant = constant_columns(df, step.get("columns"))
        return Change(lambda table: table.drop(*constant))
    if kind == "drop_missing_rows":
        return Change(lambda table: drop_missing_rows(table, step["column"]))
    log.warning("skipped: unknown cleaning step %r", kind)
    return UNCHANGED


_AUDIT = (
    "step int, type string, column string, method string, rows_before long, rows_after long, "
    "rows_removed long, cols_before int, cols_after int, cells_filled long"
)


def apply_cleaning(df: DataFrame, steps: Sequence[Mapping[str, Any]]) -> tuple[DataFrame, DataFrame]:
    """Apply the steps in turn; returns the cleaned table and its audit.

    The audit has one row per step: rows and columns before and after, and the
    number of cells filled in the step's column.  The cleaned table is written
    once to the shared folder, and that run counts the rows and known cells of
    every state it passes through.  Such counts are exact only where a task
    hands in its result once, however often it is run again, which is in a
    job's last stage; so a table is also written before a step that moves rows.
    """
    if not steps:
        return df, df.sparkSession.createDataFrame([], _AUDIT)
    plain, counted, counts = df, *_counted(df, steps, 0)
    states, seen = [df], [counts]
    for place, step in enumerate(steps, start=1):
        change = _change(plain, step)
        if change.moves:
            plain = change.apply(durable(counted))
            counted = plain
        else:
            plain, counted = change.apply(plain), change.apply(counted)
        counted, counts = _counted(counted, steps, place)
        states.append(plain)
        seen.append(counts)
    cleaned = durable(counted)
    rows = [
        _audit_row(place, step, before, after, was.get, now.get)
        for place, (step, before, after, was, now) in enumerate(zip(steps, states, states[1:], seen, seen[1:]), start=1)
    ]
    return cleaned, df.sparkSession.createDataFrame(rows, _AUDIT)


def _counted(table: DataFrame, steps: Sequence[Mapping[str, Any]], place: int) -> tuple[DataFrame, Observation]:
    """The table after ``place`` steps, with its rows and the known cells that the steps on either side ask for."""
    observation = Observation()
    known = lambda step: sum((F.count(known_value(table, c)) for c in _names(step.get("column", "")) if c in table.columns), F.lit(0).cast("long"))
    metrics = [F.count(F.lit(1)).alias("rows")]
    if place:
        metrics.append(known(steps[place - 1]).alias("after"))
    if place < len(steps):
        metrics.append(known(steps[place]).alias("before"))
    return table.observe(observation, *metrics), observation


def _audit_row(place: int, step: Mapping[str, Any], before: DataFrame, after: DataFrame, was: Mapping, now: Mapping) -> tuple:
    kind = str(step.get("type", ""))
    # a table without partitions leaves no counts
    rows_before, rows_after = was.get("rows", 0), now.get("rows", 0)
    return (
        place, kind, ", ".join(_names(step.get("column", ""))), str(step.get("method", step.get("keep", ""))),
        rows_before, rows_after, rows_before - rows_after, len(before.columns), len(after.columns),
        now.get("after", 0) - was.get("before", 0) if kind == "fill_missing" else 0,
    )


def recommend_cleaning(columns: DataFrame, table: DataFrame) -> DataFrame:
    """Cleaning steps that fit a profile, as one row each.

    ``columns`` comes from ``profile_columns`` and ``table`` from
    ``profile_table``.  Missing numbers take the median and other columns the
    mode, outliers are kept, duplicate rows and constant columns dropped.
    """
    step = lambda kind, method: F.struct(F.lit(kind).alias("type"), method.alias("method"))
    per_column = columns.select(
        "column",
        F.explode(
            F.filter(
                F.array(
                    F.when(
                        F.col("missing_count") > 0,
                        step("fill_missing", F.when(F.col("semantic_type") == "numeric", F.lit("median")).otherwise(F.lit("mode"))),
                    ),
                    F.when(F.col("outlier_count") > 0, step("handle_outliers", F.lit("keep"))),
                    F.when(F.col("unique_count") <= 1, step("drop_constant_columns", F.lit("drop"))),
                ),
                lambda s: s.isNotNull(),
            )
        ).alias("s"),
    ).select("s.type", "column", "s.method")
    whole = table.where(F.col("duplicate_rows") > 0).select(
        F.lit("drop_duplicates").alias("type"), F.lit("").alias("column"), F.lit("first").alias("method")
    )
    return per_column.unionByName(whole)
