"""Block-wise plans against plain Python, with blocks of one or two rows."""

import random

import pytest
from pyspark.sql import functions as F

from quire.plans import blocks as B


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    out = []
    # key 0 holds most rows
    for key, size in ((0, 400), (1, 5), (2, 1), (3, 40)):
        for order in rng.sample(range(-50, 900), size):
            out.append((key, order, rng.randrange(4), rng.choice("ab")))
    return out


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "k bigint, o bigint, v bigint, p string")


@pytest.mark.parametrize("bits", [0, 1, 3, 16])
def test_prefix_sums(frame, data, bits):
    got = rows(B.prefix_sums(frame, ["k"], "o", {"s": F.col("v")}, bits), "k", "o", "s")
    want = sorted(
        (k, o, sum(v2 for k2, o2, v2, _ in data if k2 == k and o2 < o)) for k, o, _, _ in data
    )
    assert got == want


@pytest.mark.parametrize("bits", [1, 16])
def test_row_numbers_with_and_without_key(frame, data, bits):
    got = rows(B.row_numbers(frame, ["k"], "o", "n", bits), "k", "o", "n")
    want = sorted((k, o, 1 + sum(1 for k2, o2, *_ in data if k2 == k and o2 < o)) for k, o, *_ in data)
    assert got == want
    single = frame.filter("k = 3")
    got = rows(B.row_numbers(single, [], "o", "n", bits), "o", "n")
    assert got == [(o, i + 1) for i, o in enumerate(sorted(o for k, o, *_ in data if k == 3))]


@pytest.mark.parametrize("bits", [0, 1, 2, 16])
def test_run_numbers(frame, data, bits):
    got = rows(
        B.run_numbers(frame, ["k"], "o", ["p"], lambda a, b: a["p"] != b["p"], "run", bits), "k", "o", "run"
    )
    want = []
    for key in {k for k, *_ in data}:
        run, last = 0, None
        for _, o, _, p in sorted(r for r in data if r[0] == key):
            run += p != last
            last = p
            want.append((key, o, run))
    assert got == sorted(want)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("bits", [1, 10])
def test_range_join(spark, frame, data, how, bits):
    spans = [(0, -10, 30, "x"), (0, 20, 25, "y"), (0, 40, 10, "none"), (1, 0, 10**12, "z"), (9, 0, 5, "q")]
    df = spark.createDataFrame(spans, "k bigint, lo bigint, hi bigint, tag string")
    clipped = B.clip(df, frame, ["k"], "o", "hi")
    joined = B.range_join(frame, clipped, ["k"], "o", "lo", "hi", how, bits)
    hits = {(k, o): [t for k2, lo, hi, t in spans if k2 == k and lo <= o <= hi] for k, o, *_ in data}
    if how == "left_semi":
        assert rows(joined, "k", "o") == sorted(key for key, tags in hits.items() if tags)
    elif how == "left_anti":
        assert rows(joined, "k", "o") == sorted(key for key, tags in hits.items() if not tags)
    else:
        empty = [""] if how == "left" else []
        want = sorted((k, o, t) for (k, o), tags in hits.items() for t in tags or empty)
        assert rows(joined.fillna("", ["tag"]), "k", "o", "tag") == want


def test_number_units(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, None), (4, 1), (5, 9)], "k int, n int")
    for bits in (0, 1, 3, 16):
        got = rows(B.number_units(df, ["k"], "n", "u", bits), "k", "u")
        assert got == [(k, u) for k, n in ((1, 5), (4, 1), (5, 9)) for u in range(1, n + 1)]


def test_rows_without_key_or_order_stay(spark):
    rows = [(None, 3), (None, 1), ("a", None), ("a", 5), ("a", 200_000), ("b", 7)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = {(r["k"], r["o"]): r["n"] for r in B.row_numbers(df, ["k"], "o", "n").collect()}
    assert got == {(None, 1): 1, (None, 3): 2, ("a", None): 1, ("a", 5): 2, ("a", 200_000): 3, ("b", 7): 1}
    runs = B.run_numbers(df, ["k"], "o", ["o"], lambda a, b: ~F.coalesce(b["o"] == a["o"] + 2, F.lit(False)), "run")
    assert {(r["k"], r["o"]): r["run"] for r in runs.collect()} == {
        (None, 1): 1, (None, 3): 1, ("a", None): 1, ("a", 5): 2, ("a", 200_000): 3, ("b", 7): 1,
    }
