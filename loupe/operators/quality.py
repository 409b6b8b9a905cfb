"""Missing values and duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from loupe.frames import attach_row, require, share
from loupe.operators.profiling import is_missing, repeated_groups


def _counts(df: DataFrame, columns: Sequence[str] | None):
    names = list(columns) if columns is not None else df.columns
    require(df, *names)
    wide = df.agg(F.count("*").alias("rows"), *[F.count_if(is_missing(df, c)).alias(f"c{i}") for i, c in enumerate(names)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("missing_count")) for i, c in enumerate(names)]
    return wide.select("rows", F.inline(F.array(*rows)))


def profile_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_rate, missing_count) of the columns with gaps, worst first."""
    counts = _counts(df, columns).where(F.col("missing_count") > 0)
    return counts.select(
        "column", (F.col("missing_count") / F.col("rows")).alias("missing_rate"), "missing_count"
    ).orderBy(F.desc("missing_rate"), "column")


def missing_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: cells, missing cells and their share, columns with and without gaps."""
    totals = _counts(df, columns).agg(
        F.sum("rows").alias("total_cells"), F.sum("missing_count").alias("missing_cells"),
        F.count_if(F.col("missing_count") > 0).alias("columns_with_missing"),
        F.count_if(F.col("missing_count") == 0).alias("columns_no_missing"),
    )
    return totals.withColumn("missing_pct", share(F.col("missing_cells"), F.col("total_cells")))


def profile_duplicates(df: DataFrame, subset: Sequence[str] | None = None, repeated: DataFrame | None = None) -> DataFrame:
    """One row: rows, and the rows that have a copy among them.

    ``repeated`` gives the repeated groups if they are known.
    """
    rows = df.agg(F.count("*").alias("total_rows"))
    copies = (repeated_groups(df, subset) if repeated is None else repeated).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("duplicate_rows"))
    return attach_row(rows, copies).withColumn(
        "duplicate_pct", F.coalesce(share(F.col("duplicate_rows"), F.col("total_rows")), F.lit(0.0))
    )


def duplicate_sample(
    df: DataFrame, subset: Sequence[str] | None = None, limit: int = 20, repeated: DataFrame | None = None
) -> DataFrame:
    """The values that are repeated most often, with ``copies``."""
    names = list(subset) if subset is not None else df.columns
    return (repeated_groups(df, subset) if repeated is None else repeated).orderBy(F.desc("copies"), *names).limit(limit)
