"""Session settings every job of this library relies on."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a join on the document must not decide where its page blocks are worked on
    "spark.sql.requireAllClusterKeysForDistribution": "true",
    # page trees and outlines recurse over whole corpora, as deep as they go
    "spark.sql.cteRecursionRowLimit": "-1",
    "spark.sql.cteRecursionLevelLimit": "-1",
    # state of a stream lives on disk, not in executor memory
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    # a cut or broken byte string becomes U+FFFD instead of stopping the job
    "spark.sql.legacy.codingErrorAction": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options on a session that someone else created."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def small_batches(spark: SparkSession) -> None:
    """At most 256 rows in a batch for Python tasks over texts, or about 8 MB where Spark can cut by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def local_session(cpus: int | str = "*", name: str = "quire", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    parts = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", parts)
        .config("spark.checkpoint.dir", f"/tmp/quire-{os.getpid()}/checkpoints")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; the warehouse, which is shared too, only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_quire").rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; two runs never write to the same one."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def folder_exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
