"""What the operators share: row identity and text as they mean it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loupe.frames import col

#: characters between words, as a Java and RE2 class
WORD = r"[^\x20\x09-\x0D]+"


#: what JSON needs to tell all values apart
EXACT_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def row_parts(df: DataFrame) -> list[Column]:
    """For each column whether it is NULL, and its value; hashes skip NULLs, within nested values too."""
    parts = []
    for f in df.schema.fields:
        value = col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            value = F.to_json(F.struct(value.alias("v")), EXACT_JSON)
        parts += [col(f.name).isNull(), value]
    return parts


def row_hash(df: DataFrame) -> Column:
    """64 bits of the whole row, to order by; rows repeated whole share it."""
    return F.xxhash64(*row_parts(df))


def row_key(df: DataFrame) -> Column:
    """128 bits of the whole row as text, to tell rows apart; rows repeated whole share it."""
    return F.concat(F.hex(F.xxhash64(*row_parts(df))), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *row_parts(df))))


def text_of(name: str = "text") -> Column:
    """The text, with NULL read as empty."""
    return F.coalesce(col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    return F.regexp_count(text_of(name), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
