"""Continuous intake of files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.paths import basename, classify_file

CATALOG = "path string, name string, kind string, size bigint, arrived timestamp, uid string, batch bigint"


def arrivals(spark: SparkSession, path: str) -> DataFrame:
    """Stream of supported files, however old they are; the file source reports a path once."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFileAge", "36500d")
        .load(path)
        .select("path", "modificationTime", "length")
    )
    return files.withColumn("kind", classify_file("path")).filter(F.col("kind") != "unsupported")


def stream_intake(
    spark: SparkSession,
    path: str,
    target: str,
    checkpoint: str,
    available_now: bool = True,
) -> StreamingQuery:
    """Append new files to the catalogue table at ``target``.

    Unlike the batch intake, a path is taken once, within a batch by its newest
    entry and across batches by the catalogue; a late file with an old time is
    taken like any other. A batch that is repeated after a failure replaces its
    own rows and nothing else.
    """
    spark.createDataFrame([], CATALOG).write.mode("ignore").partitionBy("batch").parquet(target)

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        known = session.read.schema(CATALOG).parquet(target).filter(F.col("batch") != batch_id)
        newest = batch.groupBy("path").agg(F.max_by(F.struct("modificationTime", "length", "kind"), "modificationTime").alias("f"))
        once = newest.select("path", "f.*")
        fresh = once.join(known.select("path"), "path", "left_anti").select(
            "path",
            basename("path").alias("name"),
            "kind",
            F.col("length").alias("size"),
            F.col("modificationTime").alias("arrived"),
            F.concat_ws("#", F.lit(str(batch_id)), F.col("path")).alias("uid"),
            F.lit(batch_id).cast("bigint").alias("batch"),
        )
        (
            fresh.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(target)
        )

    writer = arrivals(spark, path).writeStream.foreachBatch(append).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
