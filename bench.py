"""Time the registered queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES
a comma list instead of the headline ones ("all" for every query), BENCH_RUNS
the measured runs after one warm-up. Each query is planned and run in full into
Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from quire.plans import registry
from quire.session import local_session

HEADLINE = [
    # text and search
    "split_pages", "cap_text", "export_text", "search", "search_snippets", "search_corpus", "fold_text",
    # page lists
    "parse_range", "expand_spec", "format_ranges", "delete_pages", "extract_pages",
    # assembly
    "combine", "bates", "merge_docs", "assemble", "group_runs", "rotate", "split_ranges", "remap", "sheet_plan_booklet",
    # geometry
    "resolve_inherited", "map_bbox", "tile_plan",
    # quality
    "luma_stats", "pixel_diff", "compare_docs", "pick_quality",
    # sources and streams
    "intake", "image_budget", "name_outputs", "outline", "job_status",
]


def shuffle_bytes(spark) -> dict[int, int]:
    """Bytes written to shuffles so far, per stage."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    registry.load()
    names = list(registry.QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench", memory=os.environ.get("BENCH_MEMORY", "16g"))
    times: dict[str, float] = {}
    shuffled: dict[str, float] = {}
    for name in names:
        measured = []
        before = set()
        for turn in range(runs + 1):
            if turn == runs:
                before = set(shuffle_bytes(spark))
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
        written = sum(v for k, v in shuffle_bytes(spark).items() if k not in before)
        shuffled[name] = round(written / 2**20, 2)
        times[name] = round(statistics.median(measured[1:] or measured), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "shuffle_mib": shuffled,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": int(cpus),
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
