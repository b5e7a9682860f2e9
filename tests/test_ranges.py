"""Page-range grammars: values that must hold, and round trips."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import ranges as R


def strict(one, spec, count=None, **kw):
    got = one(R.parse_range(F.lit(spec), F.lit(count).cast("int"), **kw))
    return got["pages"], got["error"]


@pytest.mark.parametrize(
    "spec,count,ordered,pages,error",
    [
        ("1", None, False, [1], None),
        ("1,3,5-8", None, False, [1, 3, 5, 6, 7, 8], None),
        (" 1 , 3 - 4 ", None, False, [1, 3, 4], None),
        ("1 2", None, False, [12], None),
        ("3,1,3,2", None, False, [1, 2, 3], None),
        ("3,1,3,2", None, True, [3, 1, 3, 2], None),
        ("5-3", None, True, [5, 4, 3], None),
        ("5-3", None, False, [3, 4, 5], None),
        ("all", 3, False, [1, 2, 3], None),
        ("*", 2, False, [1, 2], None),
        ("all", None, False, None, "ALL_NEEDS_COUNT"),
        ("ALL", 0, False, None, "ALL_NEEDS_COUNT"),
        ("", 3, False, None, "EMPTY"),
        ("  ", 3, False, None, "EMPTY"),
        ("1,,2", None, False, None, "EMPTY_TOKEN"),
        ("0", None, False, None, "BAD_NUMBER"),
        ("-3", None, False, None, "BAD_RANGE"),
        ("1-2-3", None, False, None, "BAD_RANGE"),
        ("1-x", None, False, None, "BAD_NUMBER"),
        ("a", 2, False, None, "BAD_NUMBER"),
        ("1,9", 5, False, None, "OUT_OF_RANGE"),
        ("9,x", 5, False, None, "OUT_OF_RANGE"),
        ("x,9", 5, False, None, "BAD_NUMBER"),
        ("7", 0, False, [7], None),
        ("99999999999999999999999", 5, False, None, "OUT_OF_RANGE"),
        ("1-4000000000", None, False, None, "TOO_MANY_PAGES"),
        ("4000000000", None, False, None, "TOO_LARGE"),
        ("9999999999999999999", None, False, None, "TOO_LARGE"),
        ("007", None, False, [7], None),
    ],
)
def test_strict(one, spec, count, ordered, pages, error):
    assert strict(one, spec, count, preserve_order=ordered) == (pages, error)


def test_strict_without_all(one):
    assert strict(one, "all", 3, allow_all=False) == (None, "ALL_NOT_ALLOWED")


def test_strict_segments_do_not_expand(one):
    got = one(R.parse_range_segments(F.lit("1-4000000000")))
    assert [(s["lo"], s["hi"]) for s in got["segments"]] == [(1, 4000000000)]


@pytest.mark.parametrize(
    "spec,pages",
    [
        ("3,1,5-7,5", [1, 3, 5, 6, 7]),
        ("7-5", [5, 6, 7]),
        (" 2 ,, 0 ", [0, 2]),
        ("+4", [4]),
        ("abc", None),
        ("", None),
        (",", None),
        ("1-2-3", None),
        ("-5", None),
        ("5000000000", None),
    ],
)
def test_lenient(one, spec, pages):
    got = one(R.parse_range_lenient(F.lit(spec)))
    assert got["pages"] == pages
    assert got["error"] == (None if pages is not None else "INVALID_PAGES")


@pytest.mark.parametrize(
    "spec,n,pages,error",
    [
        ("1-z", 4, [1, 2, 3, 4], None),
        ("3,1,2", 3, [3, 1, 2], None),
        ("z-1", 3, [3, 2, 1], None),
        ("Z,2-Z", 3, [3, 2, 3], None),
        ("", 2, [1, 2], None),
        ("All", 0, [], None),
        ("z", 0, None, "OUT_OF_RANGE"),
        ("4", 3, None, "OUT_OF_RANGE"),
        ("0", 3, None, "OUT_OF_RANGE"),
        (",", 3, None, "INVALID_PAGES"),
        ("1-2-3", 3, None, "INVALID_PAGES"),
    ],
)
def test_ordered(one, spec, n, pages, error):
    got = one(R.expand_spec(F.lit(spec), F.lit(n)))
    assert (got["pages"], got["error"]) == (pages, error)


@pytest.mark.parametrize(
    "spec,n,full",
    [
        ("1-z", 5, True),
        ("1-5", 5, True),
        ("1,2,3,4,5", 5, True),
        ("1-2, 3-5", 5, True),
        ("1-4", 5, False),
        ("2-5", 5, False),
        ("3,2,1", 3, False),
        ("1,,2", 2, False),
        ("", 0, False),
        ("1-z", 0, True),
        ("1-x", 3, False),
    ],
)
def test_full_range(one, spec, n, full):
    assert one(R.is_full_range(F.lit(spec), F.lit(n))) is full


@pytest.mark.parametrize(
    "text,total,ranges,error",
    [
        ("1-5, 6-10,11", 11, [(1, 5), (6, 10), (11, 11)], None),
        ("1 - 2\n3", 5, [(1, 2), (3, 3)], None),
        ("2-4,2-4", 4, [(2, 4), (2, 4)], None),
        (" , \n", 4, None, "EMPTY"),
        ("5-2", 9, None, "BAD_RANGE"),
        ("0-2", 9, None, "BAD_RANGE"),
        ("1-2-3", 9, None, "BAD_TOKEN"),
        ("1-9", 8, None, "OUT_OF_RANGE"),
    ],
)
def test_split_ranges(one, text, total, ranges, error):
    got = one(R.parse_split_ranges(F.lit(text), F.lit(total)))
    pairs = None if got["ranges"] is None else [(r["start"], r["end"]) for r in got["ranges"]]
    assert (pairs, got["error"]) == (ranges, error)


@pytest.mark.parametrize(
    "pages,spec",
    [([1, 2, 3, 5, 7, 8], "1-3,5,7-8"), ([1, 3, 4, 6], "1,3-4,6"), ([2], "2"), ([3, 2, 1], "3,2,1"), ([], "")],
)
def test_format_page_list(one, pages, spec):
    assert one(R.format_page_list(F.array(*[F.lit(p) for p in pages]).cast("array<int>"))) == spec


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sets(st.integers(1, 60), min_size=1), min_size=1, max_size=30))
def test_format_then_parse_is_identity(spark, sets):
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "i int, pages array<int>")
    back = df.select("i", "pages", R.parse_range(R.format_page_list("pages")).alias("r"))
    for row in back.collect():
        assert row["r"]["pages"] == row["pages"] and row["r"]["error"] is None


def test_long_numbers_are_read_whole(one):
    zeros = "+" + "0" * 70 + "5"
    assert one(R.parse_range_lenient(F.lit(zeros)))["pages"] == [5]
    assert one(R.expand_spec(F.lit(zeros), F.lit(9)))["pages"] == [5]
    assert one(R.is_full_range(F.lit(f"1-{zeros}"), F.lit(5)))


def test_more_than_a_million_pages(one):
    found = one(R.parse_range(F.lit("1-1000001"), max_pages=None))
    assert found["error"] is None and len(found["pages"]) == 1_000_001
    assert one(R.parse_range(F.lit("1-1000001"), max_pages=1000))["error"] == "TOO_MANY_PAGES"


def test_pages_as_rows(spark):
    from quire.operators.select import listed_pages

    df = spark.createDataFrame([(1, "5-3,9"), (2, "1-300000"), (3, "x")], "doc_id int, spec string")
    df = df.withColumn("parsed", R.parse_range_segments("spec"))
    rows = listed_pages(df.select("doc_id", F.col("parsed.segments").alias("segments")))
    assert [r["page"] for r in rows.filter("doc_id = 1").orderBy("item").collect()] == [5, 4, 3, 9]
    assert rows.filter("doc_id = 2").agg(F.count("*"), F.max("page"), F.max("item")).first()[:] == (300000, 300000, 300000)


def _pages(segments):
    return sorted({p for lo, hi in segments for p in range(min(lo, hi), max(lo, hi) + 1)})


def test_merged_segments_are_sorted_disjoint_and_counted(spark):
    rng = random.Random(5)
    rows = [(k, [(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randrange(12))]) for k in range(200)]
    frame = spark.createDataFrame(rows + [(900, None)], "k int, s array<struct<lo:bigint,hi:bigint>>")
    got = {r["k"]: r["m"] for r in frame.select("k", R.merge_segments("s").alias("m")).collect()}
    assert got.pop(900) is None
    for k, segments in rows:
        merged = [(m["lo"], m["hi"]) for m in got[k]]
        assert _pages(merged) == _pages(segments)
        assert all(lo <= hi for lo, hi in merged) and all(a[1] + 1 < b[0] for a, b in zip(merged, merged[1:]))


def test_huge_specs_end_in_a_code_or_a_segment(one):
    everything = one(R.page_set(R.lenient_segments(F.lit("7,1-4000000000,5-2,4000000001"))))
    assert (everything["segments"], everything["n"], everything["error"]) == ([(1, 4000000001)], 4000000001, None)
    for spec in ("1-4000000000", "1-540000000", "1-70000000", "1-9,540000000-1"):
        assert one(R.parse_range(F.lit(spec)))["error"] == "TOO_MANY_PAGES"
        assert one(R.parse_range_lenient(F.lit(spec)))["error"] == "TOO_MANY_PAGES"
    assert one(R.expand_spec(F.lit("1-z"), F.lit(540000000)))["error"] == "TOO_MANY_PAGES"
    assert one(R.page_set(R.parse_range_segments(F.lit("3,x"))))["error"] == "BAD_NUMBER"
    # pages named many times over are one set
    many = ",".join(["1-1000000"] * 300)
    assert len(one(R.parse_range(F.lit(many)))["pages"]) == 1000000


def test_many_tokens(one):
    spec = ",".join(str(k) for k in range(20000, 0, -2))
    assert one(R.page_set(R.lenient_segments(F.lit(spec))))["n"] == 10000
