"""Semantic types, column and table profiles, and the quality issues found in them.

Everything about distinct values (counts, most frequent values, text lengths,
parse rates) comes from one shuffle of (column, value, count).
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F, types as T

from loupe.frames import attach_row, col, is_numeric, number, numeric_columns, quoted, require
from loupe.functions.coerce import to_moment
from loupe.moments import gaps_together, pairwise_correlations
from loupe.ordered import Sort, sort_columns
from loupe.quantiles import column_quantiles

#: column names that mark an identifier (fixed pattern)
IDENTIFIER_NAME = re.compile(r"(^|_)(id|no|编号|序号|code|编码|key)$")
#: texts read as a boolean, alone or as a pair (fixed values)
BOOLEAN_TEXT = ["True", "False", "true", "false"]
BOOLEAN_PAIRS = [["是", "否"], ["yes", "no"], ["y", "n"], ["true", "false"], ["t", "f"], ["1", "0"]]

#: shares of a column's values that read as dates from which it is dates, or text that was perhaps meant as dates
DATES, PERHAPS_DATES = 0.8, 0.5


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if is_numeric(data_type):
        return "number"
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "text"
    return "other"


def _known(field: T.StructField) -> Column:
    """The column with NaN as NULL and -0.0 as 0.0."""
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        kind = field.dataType.simpleString()
        return F.expr(f"nanvl({quoted(field.name)}, CAST(NULL AS {kind})) + CAST(0 AS {kind})")
    return col(field.name)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value as text, n) for the known values of the columns.

    Columns of one type are counted together as they are; only distinct values
    are written as text.  Over a columnar file each of these passes reads its
    own columns, so that all of them read the file once.
    """
    families: dict[str, list[T.StructField]] = {}
    for f in df.schema.fields:
        if columns is None or f.name in columns:
            kind = "bigint" if isinstance(f.dataType, T.IntegralType) else f.dataType.simpleString()
            families.setdefault(kind, []).append(f)
    parts = []
    for kind, fields in families.items():
        values = df.select(*[_known(f).cast(kind).alias(f.name) for f in fields])
        long = values.unpivot([], [col(f.name) for f in fields], "column", "value")
        counted = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
        parts.append(counted.select("column", F.col("value").cast("string").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def top_values(counts: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent values of each column; ties go to the smaller value.

    Every task passes on no more than ``n`` rows per column.
    """
    order = W.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _columns_table(df: DataFrame) -> DataFrame:
    """One row per column with what the schema alone says."""
    rows = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("spark_type"),
            F.lit(_kind(f.dataType)).alias("kind"),
            F.lit(isinstance(f.dataType, T.IntegralType)).alias("integral"),
            F.lit(bool(IDENTIFIER_NAME.search(f.name.lower().strip()))).alias("named_id"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def _reads_as_date(value: Column) -> Column:
    # every layout starts with a digit
    return value.rlike("^ *[0-9]") & to_moment(value).isNotNull()


def _facts(df: DataFrame, with_tops: bool = False) -> DataFrame:
    """One row per column: counts, lengths, parse rates and, if asked, top values."""
    text_columns = [f.name for f in df.schema.fields if _kind(f.dataType) == "text"]
    number_columns = numeric_columns(df)
    counts = value_counts(df)
    value, n = F.col("value"), F.col("n")
    is_text, is_number = F.col("column").isin(text_columns), F.col("column").isin(number_columns)
    aggregates = [
        F.sum("n").alias("non_null"),
        F.count("*").alias("unique_count"),
        F.sum(
            F.when(is_number & value.rlike(r"^[01](\.0+)?$"), 0)
            .when(is_text & value.isin(BOOLEAN_TEXT), 0)
            .otherwise(1)
        ).alias("not_boolean"),
        (F.sum(F.length("value") * n) / F.sum("n")).alias("avg_length"),
    ]
    aggregates.append((F.sum(F.when(is_text & _reads_as_date(value), n).otherwise(0)) / F.sum("n")).alias("date_share"))
    facts = counts.groupBy("column").agg(*aggregates)
    if with_tops:
        tops = top_values(counts).groupBy("column").agg(
            F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("tops")
        )
        facts = facts.join(tops, "column", "left")
    return _columns_table(df).join(facts, "column", "left").withColumns(
        {
            "non_null": F.coalesce("non_null", F.lit(0).cast("long")),
            "unique_count": F.coalesce("unique_count", F.lit(0).cast("long")),
        }
    )


def _semantic(identifier_integral_only: bool) -> Column:
    """The first rule that holds names the type."""
    unique, known = F.col("unique_count"), F.col("non_null")
    ratio = unique / known
    kind = F.col("kind")
    near_unique = (ratio > 0.9) & (unique > 50)
    if identifier_integral_only:
        near_unique &= F.col("integral")
    return (
        F.when(known == 0, "unknown")
        .when((kind == "boolean") | ((unique <= 2) & (F.col("not_boolean") == 0)), "boolean")
        .when(F.col("named_id"), "identifier")
        .when((kind == "number") & near_unique, "identifier")
        .when(kind == "number", "numeric")
        .when(kind == "datetime", "datetime")
        .when((kind == "text") & (F.col("date_share") >= DATES) & (known >= 3), "datetime")
        .when((kind == "text") & (unique > 50) & (ratio >= 0.2) & (F.col("avg_length") > 80), "text")
        .when((kind == "text") & ((unique <= 50) | (ratio < 0.2)), "categorical")
        .when(kind == "text", "text")
        .otherwise("unknown")
    )


def infer_semantic_types(df: DataFrame, identifier_integral_only: bool = False) -> DataFrame:
    """(ordinal, column, spark_type, semantic_type), one row per column.

    Text counts as dates when 80 % of all its values read as dates.
    """
    return _facts(df).select("ordinal", "column", "spark_type", _semantic(identifier_integral_only).alias("semantic_type"))


def semantic_types(df: DataFrame, identifier_integral_only: bool = False) -> dict[str, str]:
    """Column name to semantic type, in column order."""
    rows = infer_semantic_types(df, identifier_integral_only).orderBy("ordinal").collect()
    return {r.column: r.semantic_type for r in rows}


def type_counts(types: DataFrame) -> DataFrame:
    """Number of columns per semantic type; a model needs two numeric ones."""
    return types.groupBy("semantic_type").agg(F.count("*").alias("columns"))


def _numeric_summary(df: DataFrame, fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(column, min, max, mean, std, outlier_count) of numeric columns, in one pass."""
    names = numeric_columns(df)
    aggregates, rows = [], []
    for i, name in enumerate(names):
        v = number(name)
        low, high = (fences or {}).get(name, (None, None))
        outside = F.count_if((v < low) | (v > high)) if low is not None else F.lit(None).cast("long")
        aggregates += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.avg(v).alias(f"c{i}"), F.stddev(v).alias(f"d{i}"), outside.alias(f"e{i}")]
        rows.append(
            F.struct(
                F.lit(name).alias("column"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"),
                F.col(f"c{i}").alias("mean"), F.col(f"d{i}").alias("std"), F.col(f"e{i}").alias("outlier_count"),
            )
        )
    if not names:
        return df.sparkSession.createDataFrame(
            [], "column string, min double, max double, mean double, std double, outlier_count long"
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _missing(df: DataFrame) -> list[Column]:
    """Columns missing_count and missing_rate, given rows and non_null."""
    missing = F.col("rows") - F.col("non_null")
    return [missing.alias("missing_count"), F.try_divide(missing.cast("double"), F.col("rows")).alias("missing_rate")]


def _top_map(wanted: Column) -> Column:
    return F.when(
        wanted, F.map_from_entries(F.transform("tops", lambda t: F.struct(t["value"], t["n"])))
    ).alias("top_values")


def describe_schema(df: DataFrame, identifier_integral_only: bool = False) -> DataFrame:
    """One row per column: type, missing and unique values, and its statistics.

    Numbers get min, max, mean and std; categories, booleans and identifiers
    their five most frequent values.
    """
    rows = df.agg(F.count("*").alias("rows"))
    facts = attach_row(_facts(df, with_tops=True), rows)
    typed = facts.withColumn("semantic_type", _semantic(identifier_integral_only))
    joined = typed.join(_numeric_summary(df), "column", "left")
    is_number = F.col("semantic_type") == "numeric"
    return joined.select(
        "ordinal", "column", "spark_type", "semantic_type", *_missing(df), "unique_count",
        *[F.when(is_number, F.col(c)).alias(c) for c in ("min", "max", "mean", "std")],
        _top_map(F.col("semantic_type").isin("categorical", "boolean", "identifier")),
    )


def sample_rows(df: DataFrame, order_by: Sort, n: int = 3) -> DataFrame:
    """The first rows in the given order."""
    return df.orderBy(*sort_columns(order_by)).limit(n)


def profile_columns(df: DataFrame, identifier_integral_only: bool = False) -> DataFrame:
    """``describe_schema`` with quartiles and the number of IQR outliers.

    The semantic types (one row per column) are read first, so that quartiles
    are computed for numeric columns only.
    """
    facts = _facts(df, with_tops=True).withColumn("semantic_type", _semantic(identifier_integral_only))
    known: list[Row] = facts.collect()
    numeric = [r.column for r in known if r.semantic_type == "numeric" and r.non_null >= 5]
    quartiles = column_quantiles(df, numeric, [0.25, 0.5, 0.75])
    fences = {c: (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)) for c, (q1, _, q3) in quartiles.items()}
    spark = df.sparkSession
    described = spark.createDataFrame(
        [
            (r.ordinal, r.column, r.spark_type, r.semantic_type, r.non_null, r.unique_count,
             [(t.rank, t.value, t.n) for t in r.tops or []],
             *(quartiles.get(r.column) or (None, None, None)))
            for r in known
        ],
        "ordinal int, column string, spark_type string, semantic_type string, non_null long, unique_count long, "
        "tops array<struct<rank:int,value:string,n:long>>, q25 double, median double, q75 double",
    )
    rows = df.agg(F.count("*").alias("rows"))
    summary = _numeric_summary(df.select(*[col(c) for c in numeric]), fences)
    joined = attach_row(described, rows).join(summary, "column", "left")
    shown = F.col("semantic_type").isin("categorical", "text", "boolean", "identifier")
    return joined.select(
        "ordinal", "column", "spark_type", "semantic_type", "rows", *_missing(df), "unique_count",
        "min", "q25", "median", "q75", "max", "mean", "std", "outlier_count", _top_map(shown),
    )


def repeated_groups(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Distinct values of the subset that occur more than once, with ``copies``.

    Rows are first counted by a 64-bit hash, which shuffles 16 bytes per row at
    most; only rows whose hash repeats are then grouped by their real values.
    """
    names = list(subset) if subset is not None else df.columns
    require(df, *names)
    hashed = df.select(*[col(c) for c in names], F.xxhash64(*[col(c) for c in names]).alias("_hash"))
    suspects = hashed.groupBy("_hash").count().where(F.col("count") > 1).select("_hash")
    return (
        hashed.join(suspects, "_hash", "left_semi")
        .groupBy(*[col(c) for c in names])
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


def profile_table(df: DataFrame) -> DataFrame:
    """One row: rows, columns, share of known cells, rows beyond the first copy."""
    known = sum((F.count(_known(f)) for f in df.schema.fields), F.lit(0))
    size = df.agg(F.count("*").alias("rows"), known.alias("known"))
    copies = repeated_groups(df).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_rows"))
    return attach_row(size, copies).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.try_divide(F.col("known").cast("double"), F.col("rows") * len(df.columns)).alias("completeness"),
        "duplicate_rows",
    )


# Quality issues, read off a column profile.


def high_missing(profile: DataFrame, rate: float = 0.3) -> DataFrame:
    return profile.where(F.col("missing_rate") > rate).select("column", (F.col("missing_rate") * 100).alias("pct"))


def constant_columns(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("unique_count") <= 1).select("column")


def low_variance(profile: DataFrame) -> DataFrame:
    """Near-constant columns of tables with more than 100 rows."""
    ratio = F.col("unique_count") / F.col("rows")
    return profile.where((F.col("rows") > 100) & (F.col("unique_count") > 1) & (ratio < 0.001)).select(
        "column", (ratio * 100).alias("pct")
    )


def potential_outliers(profile: DataFrame) -> DataFrame:
    known = F.col("rows") - F.col("missing_count")
    return profile.where(F.col("outlier_count") > 0).select(
        "column", F.col("outlier_count").alias("count"), (F.col("outlier_count") / known * 100).alias("pct")
    )


def suggest_types(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Columns whose type should perhaps change: (column, current, suggested).

    Text of which half the values, and at least 5, read as dates suggests
    datetime, text with the two values of a yes/no pair boolean, and numbers
    with 2 to 5 distinct values categorical.
    """
    unique, kind = F.col("unique_count"), F.col("semantic_type")
    suggest = lambda rows, to: rows.select("column", kind.alias("current"), F.lit(to).alias("suggested"))
    categorical = suggest(profile.where((kind == "numeric") & unique.between(2, 5)), "categorical")
    lowered = F.transform(F.map_keys("top_values"), F.lower)
    pair = F.lit(False)
    for words in BOOLEAN_PAIRS:
        pair |= F.size(F.array_except(lowered, F.array(*[F.lit(w) for w in words]))) == 0
    boolean = suggest(
        profile.where((F.col("spark_type") == "string") & unique.between(2, 4) & (kind != "boolean") & pair), "boolean"
    )
    found = categorical.unionByName(boolean)
    texts = [f.name for f in df.schema.fields if _kind(f.dataType) == "text"]
    if texts:
        value, n = F.col("value"), F.col("n")
        dates = F.sum(F.when(_reads_as_date(value), n).otherwise(0))
        dated = value_counts(df, texts).groupBy("column").agg(dates.alias("dates"), F.sum("n").alias("known"))
        dated = dated.where((F.col("dates") >= 5) & (F.col("dates") >= PERHAPS_DATES * F.col("known")))
        candidates = profile.where((kind == "text") & (unique > 3)).join(F.broadcast(dated), "column", "left_semi")  # a row a column
        found = found.unionByName(suggest(candidates, "datetime"))
    return found


def is_missing(df: DataFrame, name: str) -> Column:
    return _known(df.schema[name]).isNull()


def missing_patterns(df: DataFrame, first: int | None = None) -> DataFrame:
    """Column pairs where one is mostly missing when the other is.

    Looks at columns missing in some but less than 95 % of at least 20 rows;
    ``first`` sets only so many of them against all later ones.
    """
    counted = df.agg(F.count("*"), *[F.count_if(is_missing(df, c)) for c in df.columns]).first()
    rows, missing = counted[0], dict(zip(df.columns, counted[1:]))
    partly = [c for c in df.columns if 0 < missing[c] < 0.95 * rows] if rows >= 20 else []
    together = gaps_together(df.select(*[is_missing(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(partly)])) if partly else None
    pairs = [
        (a, b, int(together[i, j]), *(float(together[i, j]) / missing[x] for x in (b, a)))
        for i, a in enumerate(partly[:first]) for j, b in enumerate(partly) if j > i
    ]
    rates = df.sparkSession.createDataFrame(
        pairs, "column_a string, column_b string, joint_missing long, a_when_b_missing_rate double, b_when_a_missing_rate double"
    )
    return rates.where(
        (F.col("joint_missing") > 0) & ((F.col("a_when_b_missing_rate") > 0.8) | (F.col("b_when_a_missing_rate") > 0.8))
    )


def pairwise_correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_a, column_b, r) over the rows where both columns are known; one pass over the data for all pairs."""
    names = list(columns) if columns is not None else numeric_columns(df)
    matrix = pairwise_correlations(df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(names)]))
    rows = [
        (names[a], names[b], None if np.isnan(matrix[a, b]) else float(matrix[a, b]))
        for a, b in combinations(range(len(names)), 2)
    ]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, r double")


def duplicate_columns(df: DataFrame, columns: Sequence[str] | None = None, above: float = 0.999) -> DataFrame:
    """Numeric column pairs that say the same: |r| > 0.999."""
    return pairwise_correlation(df, columns).where(F.abs("r") > above).select(
        "column_a", "column_b", F.abs("r").alias("correlation")
    )
