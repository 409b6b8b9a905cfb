"""Sanitising, derived columns, filters and lookups."""

from __future__ import annotations

import ast
import logging
import re
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loupe.frames import col, is_numeric, known_value, number, require
from loupe.functions.coerce import MISSING_TOKENS, to_moment, to_number
from loupe.ordered import with_running_sum
from loupe.quantiles import column_quantiles

log = logging.getLogger(__name__)

_FLOATS = (T.FloatType, T.DoubleType)


def sanitise(df: DataFrame) -> DataFrame:
    """Drop empty rows, then empty columns; trim names; null the missing-value tokens.

    Tokens are nulled last, so a column that holds nothing but tokens stays.
    """
    filled = df.na.drop("all")
    known = filled.agg(*[F.count(_not_nan(f)).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]).first()
    kept = [f for f, n in zip(df.schema.fields, known) if n > 0]
    names = [f.name.strip() for f in kept]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide once trimmed: {sorted(names)}")
    return filled.select(*[_without_tokens(f).alias(name) for f, name in zip(kept, names)])


def _not_nan(field: T.StructField) -> Column:
    column = col(field.name)
    if isinstance(field.dataType, _FLOATS):
        return F.nanvl(column, F.lit(None).cast(field.dataType))
    return column


def _without_tokens(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        column = col(field.name)
        return F.when(~column.isin(MISSING_TOKENS), column)
    return _not_nan(field)


def map_column(df: DataFrame, name: str, column: str) -> DataFrame:
    """Add ``name`` as a copy of ``column``; an unknown source is skipped."""
    name, column = name.strip(), column.strip()
    if column not in df.columns:
        log.info("skipped %r: no column %r", name, column)
        return df
    return df if name == column or not name else df.withColumn(name, col(column))


#: a name in quotes, a number, or a bare name
_OPERAND = re.compile(r"`([^`]+)`|(\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)|([^\W\d]\w*)")
_ARITHMETIC = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: F.try_divide,
    ast.Mod: lambda a, b: F.try_mod(F.try_mod(a, b) + b, b),  # with the divisor's sign
}


def _arithmetic(df: DataFrame, formula: str) -> Column:
    """The formula in doubles, which no value makes fail; a zero divisor gives NULL."""
    operands: list[Column] = []

    def named(found: re.Match) -> str:
        quoted_name, literal, bare = found.groups()
        operands.append(F.lit(float(literal)) if literal else col(quoted_name or bare).cast("double"))
        return f"x{len(operands) - 1}"

    def built(node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            return operands[int(node.id[1:])]
        if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
            return _ARITHMETIC[type(node.op)](built(node.left), built(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return built(node.operand) if isinstance(node.op, ast.UAdd) else -built(node.operand)
        raise SyntaxError("only + - * / % and brackets over columns and numbers")

    return built(ast.parse(_OPERAND.sub(named, formula).strip(), mode="eval").body)


def compute_column(df: DataFrame, name: str, formula: str) -> DataFrame:
    """Add an arithmetic expression over columns, in doubles; a faulty formula is logged and skipped."""
    try:
        added = df.withColumn(name, _arithmetic(df, formula))
        added.schema  # unknown columns show here
        return added
    except (AnalysisException, SyntaxError) as problem:
        log.warning("skipped %r = %r: %s", name, formula, problem)
        return df


def apply_mappings(df: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Apply ``{name, type: direct|computed, column|formula}`` in turn."""
    for m in mappings:
        name = str(m.get("name", "")).strip()
        if not name:
            continue
        if m.get("type", "direct") == "computed":
            df = compute_column(df, name, str(m.get("formula", "")).strip())
        else:
            df = map_column(df, name, str(m.get("column", "")))
    return df


def coerce_numeric(df: DataFrame, *columns: str) -> DataFrame:
    """Read columns as numbers; what cannot be read becomes NULL."""
    require(df, *columns)
    return df.withColumns({c: to_number(col(c), df.schema[c].dataType) for c in columns})


def coerce_datetime(df: DataFrame, column: str, formats: Sequence[str] | None = None) -> DataFrame:
    """Read a column as timestamps and drop the rows that cannot be read."""
    require(df, column)
    moment = to_moment(col(column), df.schema[column].dataType, formats)
    return df.withColumn(column, moment).where(col(column).isNotNull())


_COMPARE = {
    "gt": lambda c, t: c > t,
    "lt": lambda c, t: c < t,
    "eq": lambda c, t: c == t,
    "gte": lambda c, t: c >= t,
    "lte": lambda c, t: c <= t,
}


def comparison(df: DataFrame, column: str, operator: str, threshold: float) -> Column:
    """The condition ``column <operator> threshold``; unknown values are false."""
    require(df, column)
    if operator not in _COMPARE:
        raise ValueError(f"unknown operator {operator!r}; use one of {sorted(_COMPARE)}")
    kind = df.schema[column].dataType
    if not is_numeric(kind):
        return F.coalesce(_COMPARE[operator](to_number(col(column)), F.lit(float(threshold))), F.lit(False))
    # A bare comparison is pushed down to the scan; NaN would pass "greater".
    test = _COMPARE[operator](col(column), F.lit(float(threshold)))
    return test & ~F.isnan(col(column)) if isinstance(kind, _FLOATS) else test


def filter_compare(df: DataFrame, column: str, operator: str, threshold: float) -> DataFrame:
    return df.where(comparison(df, column, operator, threshold))


def data_lookup(
    df: DataFrame, column: str, value: str, limit: int | None = None, order_by: Sequence[str] = (),
    literal: bool = False, columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows whose column equals a number or contains a pattern, ignoring case.

    A value that reads as a number is compared exactly with numeric columns.
    Otherwise it is a regular expression, or plain text with ``literal``.
    All matches are returned, or the first ``limit`` in ``order_by``, with all
    columns or the given ones.
    """
    require(df, column, *order_by, *(columns or ()))
    if limit is not None and not order_by:
        raise ValueError("a limit needs order_by: without an order the rows would be arbitrary")
    matched = df.where(_matches(df, column, value, literal))
    if order_by:
        matched = matched.orderBy(*[col(c) for c in order_by])
    if limit is not None:
        matched = matched.limit(limit)
    return matched.select(*[col(c) for c in columns or df.columns])


def _matches(df: DataFrame, column: str, value: str, literal: bool) -> Column:
    try:
        sought = float(value)
    except ValueError:
        sought = None
    if sought is not None and is_numeric(df.schema[column].dataType):
        return col(column) == F.lit(sought)
    text = col(column).cast("string")
    if literal:
        return F.contains(F.lower(text), F.lower(F.lit(str(value))))
    return text.rlike("(?i)" + str(value))


def lookup_stats(df: DataFrame, column: str, value: str, literal: bool = False) -> DataFrame:
    """One row (matched, total): the rows that :func:`data_lookup` finds without a limit, and all rows."""
    require(df, column)
    return df.agg(F.count_if(_matches(df, column, value, literal)).alias("matched"), F.count("*").alias("total"))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the columns that exist."""
    return df.drop(*[c for c in columns if c in df.columns])


# Everyday words with a fixed meaning.


def high_value(df: DataFrame, column: str, quantile: float = 0.8) -> DataFrame:
    """Rows at or above the 80th percentile."""
    bound = column_quantiles(df, [column], [quantile])[column][0]
    # NaN sorts above every number but is none
    return df.where((col(column) >= F.lit(bound)) & number(column).isNotNull())


def low_value(df: DataFrame, column: str, quantile: float = 0.2) -> DataFrame:
    """Rows at or below the 20th percentile."""
    bound = column_quantiles(df, [column], [quantile])[column][0]
    return df.where(col(column) <= F.lit(bound))


def recent(df: DataFrame, date_col: str, days: int = 30, months: int = 3) -> DataFrame:
    """The last 30 days, or the last 3 months where the data spans several years."""
    require(df, date_col)
    moment = to_moment(col(date_col), df.schema[date_col].dataType)
    first, last = F.min("m"), F.max("m")
    start = df.select(moment.alias("m")).agg(
        F.when(F.year(first) == F.year(last), last - F.make_interval(days=F.lit(days)))
        .otherwise(last - F.make_interval(months=F.lit(months)))
        .alias("start")
    ).first()["start"]
    return df.where(moment >= F.lit(start))


def beyond_sigma(df: DataFrame, column: str, k: float = 2.0) -> DataFrame:
    """Rows more than k standard deviations from the mean."""
    require(df, column)
    v = number(column)
    mean, std = df.agg(F.avg(v), F.stddev(v)).first()
    if mean is None or std is None:
        return df.where(F.lit(False))
    return df.where((col(column) < F.lit(mean - k * std)) | ((col(column) > F.lit(mean + k * std)) & ~F.isnan(v)))


def majority_share(df: DataFrame, label: str, metric: str, share: float = 80.0) -> DataFrame:
    """The fewest largest labels that together reach the share of the total."""
    require(df, label, metric)
    totals = df.groupBy(known_value(df, label).alias(label)).agg(F.sum(number(metric)).alias("value")).where(
        F.col("value").isNotNull() & col(label).isNotNull()
    )
    ranked = with_running_sum(totals, "value", [F.col("value").desc(), col(label).asc()])
    grand = totals.agg(F.sum("value").alias("total"))
    return (
        ranked.crossJoin(F.broadcast(grand))
        .where((F.col("_running") - F.col("value")) * 100 < F.col("total") * share)
        .select(
            (F.col("_position") + 1).alias("rank"),
            col(label),
            "value",
            (F.col("_running") / F.col("total") * 100).alias("cum_pct"),
        )
    )
