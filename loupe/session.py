"""Session settings for tests and benchmarks, and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "12g", app: str = "loupe") -> SparkSession:
    """A local session; on a cluster, callers bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # recording the call site of every column expression costs more than small queries do
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: executors on
    other machines could not read it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    # local-cluster has executors of its own, like any cluster
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="loupe-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: paths that the open scopes delete, innermost last
_SCOPES: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Delete what :func:`durable` writes within, once the block ends.

    Results are lazy: collect or write them inside the block.
    """
    written: list[str] = []
    _SCOPES.append(written)
    try:
        yield
    finally:
        _SCOPES.remove(written)
        for path in written:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Row tags that depend on the physical partitioning (partition number, place
    in the partition) are only safe to use from several plans once written,
    and a written table also survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/loupe-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
