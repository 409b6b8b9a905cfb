"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col(quoted(name))


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; the table has {sorted(df.columns)}")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def pick_numeric(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    """The given columns, or every numeric one."""
    if columns is None:
        return numeric_columns(df)
    require(df, *columns)
    return list(columns)


def number(name: str) -> Column:
    """Column as double, with NaN read as NULL."""
    return F.expr(f"nanvl(CAST({quoted(name)} AS DOUBLE), CAST(NULL AS DOUBLE))")


def known_value(df: DataFrame, name: str) -> Column:
    """The column in its own type, with NaN read as NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.nanvl(col(name), F.lit(None).cast(kind))
    return col(name)


def single(df: DataFrame, name: str, alias: str = "v") -> DataFrame:
    """The non-null numbers of one column."""
    require(df, name)
    return df.select(number(name).alias(alias)).where(F.col(alias).isNotNull())


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate, which has exactly one row."""
    return df.crossJoin(F.broadcast(row))


def rows_from(one_row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row wide aggregate into one output row per struct."""
    return one_row.select(F.inline(F.array(*structs)))


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part / whole * scale; NULL where the whole is zero."""
    return F.try_divide(part.cast("double") * F.lit(scale), whole.cast("double"))


def spread(df: DataFrame) -> DataFrame:
    """Use every core for data that is read many times.

    Only inputs with fewer partitions than cores, so a handful of small files,
    are shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
