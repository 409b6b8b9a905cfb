"""CSV files of mixed encodings."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loupe.frames import col, is_numeric
from loupe.session import durable, shared_folder

#: encodings in the order they are tried (fixed values); latin1 reads anything
ENCODINGS = ["utf-8", "gbk", "gb18030", "latin1"]
_SPARK_NAME = {"utf-8": "UTF-8", "latin1": "ISO-8859-1"}


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, line, first): the text source keeps the bytes of a line as they are."""
    read = spark.read.text(list(paths))
    return read.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("value").alias("line"),
        (F.col("_metadata.file_block_start") == 0).alias("at_start"),
    )


def _decodes(encoding: str):
    @F.pandas_udf("boolean")
    def strict(lines: pd.Series) -> pd.Series:
        def reads(raw: bytes) -> bool:
            try:
                raw.decode(encoding)
                return True
            except UnicodeDecodeError:
                return False

        return lines.map(reads)

    return strict


def detect_encoding(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, encoding, header): the first encoding that decodes every line of a file.

    UTF-8 is checked by Spark; only files that are not UTF-8 go on to Python,
    line by line, so no file is held whole in one place.
    """
    lines = _lines(spark, paths)
    files = lines.withColumn("place", F.monotonically_increasing_id()).groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("line")).alias("utf8"),
        F.min_by(F.col("line").cast("binary"), F.when(F.col("at_start"), F.col("place"))).alias("header"),
    )
    others = files.where(~F.col("utf8")).select(F.col("file").alias("_other"))
    raw = F.col("line").cast("binary")
    suspects = lines.join(others, F.col("file") == F.col("_other"), "left_semi")
    tried = suspects.where(~F.col("line").rlike(r"\A[\x00-\x7f]*\z") | ~F.is_valid_utf8("line")).groupBy("file").agg(
        *[F.bool_and(_decodes(e)(raw)).alias(e) for e in ("gbk", "gb18030")]
    )
    return files.join(tried, "file", "left").select(
        "file",
        F.when(F.col("utf8"), "utf-8").when(F.col("gbk"), "gbk").when(F.col("gb18030"), "gb18030").otherwise("latin1").alias("encoding"),
        "header",
    )


def _transcoded(spark: SparkSession, paths: Sequence[str], encoding: str) -> str:
    """Write the data lines as UTF-8 to the shared folder; Spark's reader has no GBK.

    A task reads the lines of a file in order, so the first one of a file's
    start is its header, and only that is left out.
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None
        for batch in batches:
            previous = batch["file"].shift(1)
            if len(batch):
                previous.iloc[0] = before
                before = batch["file"].iloc[-1]
            data = batch.loc[~(batch["at_start"] & (batch["file"] != previous)), "raw"]
            yield pd.DataFrame({"value": data.map(lambda raw: bytes(raw).decode(encoding))}, dtype=object)

    folder = f"{shared_folder(spark).rstrip('/')}/loupe-csv-{uuid.uuid4().hex}"
    lines = _lines(spark, paths).select("file", "at_start", F.col("line").cast("binary").alias("raw"))
    lines.mapInPandas(decode, "value string").write.text(folder)
    return folder


def _read_with_header(spark: SparkSession, files: Sequence[str], infer: bool, options: dict) -> DataFrame:
    """Spark's reader, which leaves data lines that equal the header out of its inference: their columns are text."""
    found = spark.read.csv(files, header=True, inferSchema=infer, **options)
    typed = [f for f in found.schema.fields if not isinstance(f.dataType, T.StringType)]
    if not typed:
        return found
    text = spark.read.csv(files, header=True, inferSchema=False, **options)
    repeated = text.where(reduce(Column.__and__, [col(c) == F.lit(c) for c in text.columns])).limit(1).count()
    if not repeated:
        return found
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f in typed else f for f in found.schema.fields])
    return spark.read.csv(files, header=True, schema=schema, **options)


def read_csv(spark: SparkSession, *paths: str, infer_schema: bool = True, **options) -> DataFrame:
    """Read CSV files with a header line, whatever mix of encodings they are in.

    Files are grouped by encoding and header; groups are joined by column name,
    with NULL for columns a file lacks.  Further options go to Spark's reader.
    """
    found = durable(detect_encoding(spark, *paths))
    kinds = found.select("encoding", "header").distinct().collect()  # one row per encoding and header
    if not kinds:
        raise ValueError(f"no lines in {paths}")
    groups: dict[tuple[str, bytes], list[str]] = {}
    if len(kinds) == 1:
        groups[kinds[0].encoding, bytes(kinds[0].header or b"")] = list(paths)
    else:
        # Spark's reader takes the files of a group by name
        for row in found.toLocalIterator():
            groups.setdefault((row.encoding, bytes(row.header or b"")), []).append(row.file)
    parts = []
    for (encoding, header), files in sorted(groups.items()):
        if encoding in _SPARK_NAME:
            part = _read_with_header(spark, sorted(files), infer_schema, {"encoding": _SPARK_NAME[encoding], **options})
        else:
            names = spark.read.csv(
                _transcoded_header(spark, header, encoding), header=True, **options
            ).columns
            part = spark.read.csv(
                _transcoded(spark, files, encoding), header=False, inferSchema=infer_schema, **options
            ).toDF(*names)
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), _aligned(parts))


def _aligned(parts: Sequence[DataFrame]) -> list[DataFrame]:
    """Give a column one type in all parts: double for mixed numbers, else string."""
    found: dict[str, set] = {}
    for part in parts:
        for f in part.schema.fields:
            found.setdefault(f.name, set()).add(f.dataType)
    wanted = {
        name: "double" if all(is_numeric(t) for t in types) else "string"
        for name, types in found.items() if len(types) > 1
    }
    return [p.withColumns({c: col(c).cast(wanted[c]) for c in p.columns if c in wanted}) for p in parts]


def _transcoded_header(spark: SparkSession, header: bytes, encoding: str) -> str:
    folder = f"{shared_folder(spark).rstrip('/')}/loupe-csv-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(header.decode(encoding)).alias("value")).write.text(folder)
    return folder
