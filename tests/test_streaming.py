"""Streams against their batch twins, with restarts."""

import os
import time

from pyspark.sql import functions as F

from quire.streaming.intake import stream_intake
from quire.streaming.jobs import job_status

EVENTS = [
    ("j1", 1, "preparing", "a", None), ("j2", 2, "running", "b", 5.0), ("j1", 3, "running", "c", 50.0), ("j1", 4, "completed", "d", None),
    ("j1", 5, "running", "late", 60.0), ("j2", 6, "running", "e", 80.0), ("j3", 7, "cancelled", "f", None), ("j3", 8, "failed", "g", None),
]
EVENT_SCHEMA = "job_id string, seq long, state string, step string, percent double"
STATUS = {"j1": (4, "completed", "d", None), "j2": (6, "running", "e", 80.0), "j3": (7, "cancelled", "f", None)}


def run(stream, mode, out, checkpoint):
    def save(batch, _):
        batch.write.mode("append").parquet(out)

    q = stream.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint)
    q.trigger(availableNow=True).start().awaitTermination()


def test_job_status_batch(spark):
    got = {r["job_id"]: tuple(r)[1:] for r in job_status(spark.createDataFrame(EVENTS, EVENT_SCHEMA)).collect()}
    assert got == STATUS


def test_job_status_stream_restarts(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for half in (EVENTS[:4], EVENTS[4:]):
        spark.createDataFrame(half, EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(src)
        run(job_status(spark.readStream.schema(EVENT_SCHEMA).parquet(src)), "update", out, state)
    written = spark.read.parquet(out)
    final = written.groupBy("job_id").agg(F.max("seq").alias("seq")).join(written, ["job_id", "seq"]).distinct()
    assert {r["job_id"]: (r["seq"], r["state"], r["step"], r["percent"]) for r in final.collect()} == STATUS


def test_stream_intake_restarts(spark, tmp_path):
    src, target, state = (tmp_path / n for n in ("in", "catalog", "state"))
    src.mkdir()
    for name in ("a.pdf", "b.PNG", "c.zip"):
        (src / name).write_bytes(b"x")

    def take():
        stream_intake(spark, str(src), str(target), str(state)).awaitTermination()
        return sorted((r["name"], r["kind"], r["size"]) for r in spark.read.parquet(str(target)).collect())

    assert take() == [("a.pdf", "pdf", 1), ("b.PNG", "image", 1)]
    (src / "d.docx").write_bytes(b"xyz")
    assert take() == [("a.pdf", "pdf", 1), ("b.PNG", "image", 1), ("d.docx", "office", 3)]
    assert len({r["uid"] for r in spark.read.parquet(str(target)).collect()}) == 3


def test_stream_intake_takes_late_files(spark, tmp_path):
    src, target, state = (tmp_path / n for n in ("in", "catalog", "state"))
    src.mkdir()
    (src / "new.pdf").write_bytes(b"x")
    stream_intake(spark, str(src), str(target), str(state)).awaitTermination()
    old = time.time() - 30 * 86400
    for name in ("old.pdf", "newer.pdf"):
        (src / name).write_bytes(b"x")
    os.utime(src / "old.pdf", (old, old))
    stream_intake(spark, str(src), str(target), str(state)).awaitTermination()
    assert {r["name"] for r in spark.read.parquet(str(target)).collect()} == {"new.pdf", "old.pdf", "newer.pdf"}
