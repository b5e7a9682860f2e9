"""Running sums over ranges of rows, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from quire.plans.scan import scan_lasts, scan_numbers, scan_sums


@pytest.fixture(params=["8 small ranges", "one range", "batches of three rows"])
def ranges(spark, request):
    """Ranges as they fall, merged into one, and with batches that end within keys."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(request.param == "one range").lower())
    if "three" in request.param:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def summed(rows):
    return sorted(((k, o, sum(v2 or 0 for k2, o2, v2 in rows if k2 == k and o2 < o)) for k, o, _ in rows), key=str)


@pytest.mark.parametrize("kind", ["one key has most rows", "hashed orders", "many keys"])
def test_against_python(spark, ranges, kind):
    rng = random.Random(kind)
    size = {"one key has most rows": lambda: 0 if rng.random() < 0.9 else rng.randrange(9), "hashed orders": lambda: rng.choice([None, 1, 2]), "many keys": lambda: rng.randrange(200)}[kind]
    orders = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(500)] if kind == "hashed orders" else rng.sample(range(3000), 500)
    rows = [(size(), o, rng.choice([None, 0, 1, 5, -2, 1 << 40])) for o in orders]
    frame = spark.createDataFrame(rows, "k bigint, o bigint, v bigint").repartition(4)
    got = scan_sums(frame, ["k"], "o", {"s": F.col("v"), "n": F.lit(1)})
    assert got.columns == ["k", "o", "v", "s", "n"]
    assert sorted(((r["k"], r["o"], r["s"]) for r in got.collect()), key=str) == summed(rows)
    assert sorted(((r["k"], r["o"], r["n"]) for r in got.collect()), key=str) == summed([(k, o, 1) for k, o, _ in rows])


def test_last_values_against_python(spark, ranges):
    rng = random.Random(4)
    rows = [(rng.choice([0, 0, 0, 0, 1, None]), o, rng.choice([None] * 40 + [7, -1, 1 << 40]), rng.choice([None, 3])) for o in rng.sample(range(3000), 600)]
    frame = spark.createDataFrame(rows, "k bigint, o bigint, v bigint, w bigint").repartition(4)
    got = scan_lasts(frame, ["k"], "o", {"a": F.col("v"), "w": F.col("w")})
    want, last = [], {}
    for k, o, v, w in sorted(rows, key=lambda r: r[1]):
        a, b = last.get(k, (None, None))
        last[k] = (a if v is None else v, b if w is None else w)
        want.append((k, o, *last[k]))
    assert sorted(((r["k"], r["o"], r["a"], r["w"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_keys_of_any_type_and_none(spark, ranges):
    rows = [(None, "x", None), (None, "x", 3), ("a", None, 1), ("a", None, 2), ("a", "x", 1), ("b", "x", 9)]
    frame = spark.createDataFrame(rows, "k string, l string, o bigint").withColumn("s", F.struct("k", "l")).withColumn("own", F.array("o"))
    for keys in (["k", "l"], ["s"]):
        got = scan_numbers(frame, keys, "o", "n").collect()
        assert {(r["k"], r["l"], r["o"]): r["n"] for r in got} == {
            (None, "x", None): 1, (None, "x", 3): 2, ("a", None, 1): 1, ("a", None, 2): 2, ("a", "x", 1): 1, ("b", "x", 9): 1}
    everything = scan_numbers(frame.filter("o is not null").withColumn("o", F.col("o") * 10 + F.length(F.concat("k", "l")).isNull().cast("int")).dropDuplicates(["o"]), [], "o", "n")
    assert [r["n"] for r in everything.orderBy("o").collect()] == list(range(1, everything.count() + 1))
    assert scan_numbers(frame.limit(0), ["k"], "o", "n").count() == 0


def test_the_input_is_read_once_and_rows_move_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    frame = spark.range(1000).selectExpr("id % 3 AS k", "hash(id) AS o").mapInArrow(count, "k bigint, o int")
    got = scan_numbers(frame, ["k"], "o", "n")
    assert got.count() == 1000 and got.agg(F.max("n")).first()[0] in (333, 334) and reads.value == 1000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")
