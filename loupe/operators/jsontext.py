"""JSON objects out of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from loupe.frames import col, require

#: a string literal in either kind of quotes, or a comma that nothing but a closing bracket follows
_LITERAL_OR_COMMA = r"""("[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')|,(?=\s*[}\]])"""
#: what Spark's JSON reader forgives: quotes of the other kind, or none around names
_LENIENT = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowBackslashEscapingAnyCharacter": "true"}


def _object_in(text: Column) -> Column:
    """The text between the outermost braces, or all of it without a pair; commas too many are left out.

    Commas inside string literals are text.
    """
    opened, reversed_ = F.instr(text, "{"), F.reverse(text)
    closed = F.length(text) - F.instr(reversed_, "}") + 1
    inner = F.when((opened > 0) & (F.instr(reversed_, "}") > 0) & (closed > opened), F.substr(text, opened, closed - opened + 1)).otherwise(text)
    return F.regexp_replace(inner, _LITERAL_OR_COMMA, "$1")


def _only_value(listed: Column, text: Column) -> Column:
    """The list, if it was read as one object or array alone.

    The reader stops behind the first value, so texts are read as the only
    element of a list.
    """
    alone = F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(alone & text.rlike(r"^\s*[{\[]"), listed)


def salvage_json(df: DataFrame, text: str, schema: T.StructType | str, out: str = "json") -> DataFrame:
    """Add ``<out>`` (the parsed object), ``<out>_text`` and ``<out>_status``.

    The status is clean for text that is JSON; repaired if its outermost
    braces hold JSON once commas too many are gone; requoted if they do for a
    reader that forgives single quotes and names without any; else failed,
    with NULL.  A later reading is only tried where the earlier ones fail.
    """
    require(df, text)
    listed = lambda name: F.concat(F.lit("["), F.col(name), F.lit("]"))
    clean, repaired, requoted = F.col("_clean").isNotNull(), F.col("_repaired").isNotNull(), F.col("_requoted").isNotNull()
    read = (
        df.withColumn("_text", F.trim(col(text), F.lit(" \t\r\n")))
        .withColumn("_clean", F.try_parse_json(listed("_text")))
        .withColumn("_clean", _only_value(F.col("_clean"), F.col("_text")))
        .withColumn("_inner", F.when(~clean, _object_in(F.col("_text"))))
        .withColumn("_repaired", F.try_parse_json(listed("_inner")))
        .withColumn("_repaired", _only_value(F.col("_repaired"), F.col("_inner")))
        .withColumn("_requoted", F.when(~clean & ~repaired, F.from_json(listed("_inner"), "variant", _LENIENT)))
        .withColumn("_requoted", _only_value(F.col("_requoted"), F.col("_inner")))
    )
    status = F.when(clean, "clean").when(repaired, "repaired").when(requoted, "requoted").otherwise("failed")
    chosen = F.when(clean, F.col("_text")).when(repaired, F.col("_inner")).when(
        requoted, F.to_json(F.try_variant_get("_requoted", "$[0]", "variant"))
    )
    return (
        read.withColumn(f"{out}_status", status).withColumn(f"{out}_text", chosen)
        .withColumn(out, F.from_json(f"{out}_text", schema))
        .drop("_text", "_clean", "_inner", "_repaired", "_requoted")
    )
