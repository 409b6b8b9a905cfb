"""Tolerant conversions: what cannot be read becomes NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F, types as T

#: text that stands for a missing value (fixed values)
MISSING_TOKENS = ["NaN", "nan", "N/A", "NA", "null", "NULL", "None"]

#: date and timestamp layouts, tried in turn on text of their shape (fixed values)
DATE_FORMATS = {
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]": r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{6})?",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]": r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{6})?(Z|[+-]\d{2}:\d{2})?",
    "yyyy-MM-dd HH:mm": r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}",
    "yyyy-MM-dd": r"\d{4}-\d{2}-\d{2}",
    "yyyy/M/d H:mm:ss": r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}",
    "yyyy/M/d H:mm": r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}",
    "yyyy/M/d": r"\d{4}/\d{1,2}/\d{1,2}",
    "M/d/yyyy H:mm:ss": r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}",
    "M/d/yyyy H:mm": r"\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}",
    "M/d/yyyy": r"\d{1,2}/\d{1,2}/\d{4}",
    "yyyyMMdd": r"\d{8}",
}


def to_number(column: Column, data_type: T.DataType | None = None) -> Column:
    """Column as double; unreadable text and NaN become NULL."""
    cast = column.cast("double") if isinstance(data_type, T.NumericType) else column.cast("string").try_cast("double")
    return F.nanvl(cast, F.lit(None).cast("double"))


def to_moment(column: Column, data_type: T.DataType | None = None, formats: Sequence[str] | None = None) -> Column:
    """Column as timestamp; unreadable text becomes NULL.

    A known layout is tried only where the text has its shape: a failed parse
    costs far more than a regular expression.
    """
    if isinstance(data_type, (T.TimestampType, T.DateType, T.TimestampNTZType)):
        return column.cast("timestamp")
    text = F.trim(column.cast("string"))
    tries = []
    for layout in formats or DATE_FORMATS:
        moment = F.try_to_timestamp(text, F.lit(layout))
        shape = DATE_FORMATS.get(layout)
        tries.append(F.when(text.rlike(f"^{shape}$"), moment) if shape else moment)
    return F.coalesce(*tries)
