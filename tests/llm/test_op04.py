from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import op04_mix as M


def shared(sizes, weights, share, most):
    """Targets by resharing the excess round after round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 5}, {"a": 1, "b": 1000, "c": 3, "d": 50}, {"x": 7}, {"a": 0, "b": 10, "é": 10}])
@pytest.mark.parametrize("share", [0.3, 1.5, 2.0])
def test_targets(spark, sizes, share):
    totals = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in M.targets(totals, [3, 1, 2], share, 2.0).collect()}
    assert got == pytest.approx(shared(sizes, [3, 1, 2], share, 2.0))


@pytest.mark.parametrize("digits", [1, 2])
def test_copies_and_layout(spark, digits):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = M.plan_copies(documents, digits=digits).collect()
    again = M.plan_copies(documents.repartition(5), digits=3 - digits).collect()
    key = lambda r: (r["doc_id"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        target[r["source"]] = r["target"]
    assert abs(sum(taken.values()) / sum(target.values()) - 1) < 0.02
    assert all(abs(taken[s] / target[s] - 1) < 0.2 for s in target)


def test_edges(docs, rows_of):
    rows = [(1, None, None, "a"), (2, "", None, "a"), (None, "x y z", None, None), (3, "x y", None, "b"), (3, "x y", None, "b"), (4, "w " * 9000, None, "b")]
    planned = M.plan_copies(docs(rows).withColumnRenamed("lang", "copies"))
    found = rows_of(planned)
    assert found[1]["size"] == found[2]["size"] == 0 and found[None]["size"] == 3 and found[4]["size"] == 9000
    assert found[1]["target"] == 0 and len(found[3]) == 2 and max(r["copies"] for r in planned.collect()) <= 2
    mixed = M.mix(docs(rows).withColumn("copies", F.lit("own")))
    assert mixed.columns == [*docs(rows).columns, "copies"] and set(r["copies"] for r in mixed.collect()) <= {"own"}
    assert M.mix(docs([])).count() == 0


def test_a_source_of_copies_is_taken_near_its_target(docs):
    rows = [(k, "the same text of seven words here", None, "hot") for k in range(2000)] + [(k, f"w{k} x", None, "cold") for k in range(2000, 3000)]
    planned = M.plan_copies(docs(rows)).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.max("target").alias("t")).collect()
    assert all(abs(r["n"] - r["t"]) <= 8 for r in planned)
