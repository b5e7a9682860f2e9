"""Physical plans: no nested loops, no single task over pages, pruned scans."""

import re

import pytest

from quire.plans import registry

DATA = "/root/testdata/sf0.001"
registry.load()

# queries that run a job while they are built
EAGER = {"write_docs", "write_text", "scan_files_listed", "job_status_stream", "stream_intake"}
# a one-row report ends in one task
SINGLE = {"intake_report"}
# edges of the instructions of a document, not its pages; names that one task may hold
WINDOWED = {"rotate": "instructions of a document"}


def plan_of(spark, name):
    return registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - EAGER))
def test_plan(spark, name):
    plan = plan_of(spark, name)
    assert "BroadcastNestedLoopJoin" not in plan
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan
    if name not in SINGLE:
        assert "SinglePartition" not in plan


def test_no_window_over_a_whole_document(spark):
    """Row-level windows run per block; only block summaries are windowed per document."""
    seen = set()
    for name in sorted(set(registry.QUERIES) - EAGER - set(WINDOWED)):
        for keys, order in re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]$", plan_of(spark, name), re.M):
            seen.add(name)
            assert "__block" in keys or "__block" in order, (name, keys, order)
    assert {"format_ranges", "group_runs", "combine", "name_outputs"} <= seen
    assert not seen & {"outline", "search_snippets", "search_corpus", "search_table", "intake"}




def test_snippets_are_cut_down_before_the_shuffle(spark):
    """What lies below an exchange is a snippet or a count, never the text."""
    for name in ("search_snippets", "search_corpus"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            lines = plan_of(spark, name).split("\n")
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for exchange, below in zip(lines, lines[1:]):
            if "Exchange" in exchange:
                produced = below.split("AS ")[1:] if "Project" in below else [below]
                assert not any(re.search(r"^text#|, text#\d+\]", p) for p in produced), (name, below)


def test_scans_read_only_what_they_need(spark):
    for name, columns in {
        "job_status": {"event_id", "user_id", "event_type", "value"},
        "recent_jobs": {"event_id", "ts", "user_id", "event_type"},
        "size_estimate": {"lang", "n_chars"},
        "bounds": {"event_id", "user_id", "value"},
    }.items():
        schema = re.search(r"ReadSchema: struct<(.*?)>", plan_of(spark, name)).group(1)
        assert {c.split(":")[0] for c in schema.split(",")} == columns


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from quire.plans.roles import table

    late = table(spark, DATA, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    assert "EqualTo(o_orderstatus,F)" in late._jdf.queryExecution().executedPlan().toString()


def test_splitting_needs_no_shuffle_after_the_pages(spark):
    from pyspark.sql import functions as F

    from quire.operators.assemble import split_every

    pages = spark.range(10).select(F.lit(1).alias("doc_id"), (F.col("id") + 1).alias("pos"))
    assert "Exchange" not in split_every(pages, 3, F.lit("s"))._jdf.queryExecution().executedPlan().toString()
