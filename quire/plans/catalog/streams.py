"""Streaming queries and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans.registry import query
from quire.plans.roles import table
from quire.session import shared_folder
from quire.streaming.intake import stream_intake
from quire.streaming.jobs import job_status

STATES = {"signup": "preparing", "view": "running", "click": "running", "purchase": "completed", "error": "failed"}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _job_events(events: DataFrame) -> DataFrame:
    state = None
    for kind, name in STATES.items():
        hit = F.col("event_type") == kind
        state = F.when(hit, name) if state is None else state.when(hit, name)
    return events.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), state.alias("state"),
        F.col("event_type").alias("step"), F.col("value").alias("percent"),
    )


STATUS_SQL = """
    WITH e AS (
        SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'preparing' WHEN 'purchase' THEN 'completed'
                   WHEN 'error' THEN 'failed' ELSE 'running' END AS state, event_type AS step, value AS percent
        FROM events),
    r AS (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY CASE WHEN state IN ('completed', 'failed') THEN 0 ELSE 1 END,
                   CASE WHEN state IN ('completed', 'failed') THEN seq ELSE -seq END) AS n
        FROM e)
    SELECT job_id, seq, state, step, percent FROM r WHERE n = 1
"""


@query("job_status", STATUS_SQL)
def _job_status(spark, sf_dir):
    return job_status(_job_events(table(spark, sf_dir, "events")))


def _run_to_table(stream: DataFrame, key: str, root: str) -> DataFrame:
    """Run a stream of updates over what is there; the newest batch of each key stands."""
    spark = stream.sparkSession
    out = f"{root}/out"

    def save(batch: DataFrame, batch_id: int) -> None:
        # a repeated batch replaces its own rows
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.outputMode("update").foreachBatch(save)
    writer.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", out).parquet(out)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*stream.columns), "batch").alias("__r"))
    return last.select("__r.*")


@query("job_status_stream", STATUS_SQL)
def _job_status_stream(spark, sf_dir):
    return _run_to_table(job_status(_job_events(_events(spark, sf_dir))), "job_id", shared_folder(spark, "stream"))


@query(
    "stream_intake",
    "SELECT source AS folder, 'office' AS kind, sum(2 * strlen(text) + 1)::BIGINT AS size FROM documents GROUP BY source",
)
def _stream_intake(spark, sf_dir):
    """Whole texts written out as files of each source, half of the sources after the first run, taken in and summed."""
    root = shared_folder(spark, "intake")
    docs = table(spark, sf_dir, "documents").select("source", F.hex("text").alias("text"))
    early = F.pmod(F.crc32("source"), F.lit(2)) == 0
    for part in (docs.filter(early), docs.filter(~early)):
        part.write.mode("append").partitionBy("source").csv(f"{root}/in")
        stream_intake(spark, f"{root}/in", f"{root}/catalog", f"{root}/state").awaitTermination()
    taken = spark.read.parquet(f"{root}/catalog")
    return taken.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("folder"), "kind").agg(F.sum("size").alias("size"))
