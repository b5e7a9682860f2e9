"""Current status of jobs from their event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = ["completed", "failed", "cancelled"]
DETAILS = ["state", "step", "percent", "message"]


def job_status(events: DataFrame, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """One row per job: its first final event, or else its latest event.

    The same two aggregates serve a table and a stream (output mode "update" or
    "complete"). Both are combined before the shuffle, so a job that sends most
    events costs one row per task; in a stream the state is two events per job.
    """
    present = [c for c in DETAILS if c in events.columns]
    event = F.struct(seq, *present)
    is_final = F.col("state").isin(FINAL)
    folded = events.groupBy(job).agg(
        F.min_by(event, F.when(is_final, F.col(seq))).alias("__final"),
        F.max_by(event, seq).alias("__latest"),
    )
    return folded.select(
        job, F.coalesce("__final", "__latest").alias("__e")
    ).select(job, "__e.*")
