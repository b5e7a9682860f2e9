"""Writers that never replace anything."""

from __future__ import annotations

import posixpath
from collections.abc import Iterable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import folder_exists
from quire.sources.text_files import TextFiles


def _location(path: str) -> tuple[str, str, str]:
    parts = urlsplit(path)
    scheme = "" if parts.scheme == "file" else parts.scheme
    return scheme, parts.netloc, posixpath.normpath(parts.path)


def _overlap(a: str, b: str) -> bool:
    (sa, na, pa), (sb, nb, pb) = _location(a), _location(b)
    if (sa, na) != (sb, nb):
        return False
    return pa == pb or pa.startswith(pb.rstrip("/") + "/") or pb.startswith(pa.rstrip("/") + "/")


def _refuse_inputs(path: str, inputs: Iterable[str]) -> None:
    for source in inputs:
        if _overlap(path, source):
            raise ValueError(f"OUTPUT_IS_INPUT: {path} overlaps {source}")


def write_docs(
    df: DataFrame, path: str, inputs: Iterable[str] = (), partition_by: Iterable[str] = ()
) -> None:
    """Write to a new Parquet folder; an existing one or an input is refused.

    The commit protocol makes the result appear only when it is complete.
    """
    _refuse_inputs(path, inputs)
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_text(
    parts: DataFrame, path: str, inputs: Iterable[str] = (), key: str = "doc_id", packed: bool = False
) -> None:
    """Write exported text in UTF-8, one file for each document and part; an existing folder is refused.

    ``read_text`` reads it back. ``packed`` is for more documents than files are fit
    for: Parquet files of (key, part, text) hold many, and their Bloom filters find
    a document by key.
    """
    _refuse_inputs(path, inputs)
    rows = parts.select(key, "part", "text")
    if packed:
        rows.write.mode("errorifexists").option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
        return
    spark = parts.sparkSession
    if folder_exists(spark, path):
        raise ValueError(f"OUTPUT_EXISTS: {path}")
    spark.dataSource.register(TextFiles)
    named = rows.select(F.col(key).cast("string").alias("key"), F.col("part").cast("bigint").alias("part"), "text")
    named.write.format("text_files").mode("append").save(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(key, part, text) of every file that ``write_text`` made."""
    spark.dataSource.register(TextFiles)
    return spark.read.format("text_files").load(path)
