"""Ink statistics, diffs and choices."""

import statistics

import pytest
from pyspark.sql import functions as F

from quire.operators import quality as Q

PAGES = {
    "white": [255] * 10_000,
    "text": [0] * 200 + [255] * 9_800,
    "gray": [215] * 10_000,
    "black": [10] * 10_000,
    "specks": [0] * 50 + [255] * 9_950,
    "empty": [],
}


@pytest.fixture(scope="module")
def tiles(spark):
    rows = []
    for page, px in PAGES.items():
        cuts = [px[i : i + 4_000] for i in range(0, len(px), 4_000)] or [[]]
        rows += [(1, page, i, cut, bytearray(cut)) for i, cut in enumerate(cuts)]
    return spark.createDataFrame(rows, "doc_id int, page string, tile int, pixels array<int>, raw binary")


@pytest.mark.parametrize("column", ["pixels", "raw"])
def test_luma_stats(tiles, column):
    got = {r["page"]: (r["dark"], r["mean"], r["std"]) for r in Q.luma_stats(tiles, pixels=column).collect()}
    for page, px in PAGES.items():
        if px:
            want = (sum(p < 240 for p in px) / len(px), statistics.fmean(px), statistics.pstdev(px))
        else:
            want = (0, 255, 0)
        assert got[page] == pytest.approx(want)


@pytest.mark.parametrize(
    "sensitivity,blank",
    [
        ("strict", {"white", "gray", "empty"}),
        ("normal", {"white", "gray", "empty"}),
        ("aggressive", {"white", "gray", "empty", "specks"}),
        ("anything else", {"white", "gray", "empty"}),
    ],
)
def test_blank(tiles, sensitivity, blank):
    tested = Q.blank_pages(Q.luma_stats(tiles), sensitivity)
    assert {r["page"] for r in tested.collect() if r["blank"]} == blank


def test_drop_blank_keys_by_uid(spark):
    """The same file added twice keeps two decisions."""
    pages = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "a", 2), (2, "c", 1)], "doc_id int, uid string, page int")
    blanks = pages.filter("page = 1")
    spared = spark.createDataFrame([(1, "b", 1)], "doc_id int, uid string, page int")
    kept, errors = Q.drop_blank(pages, blanks, spared)
    assert sorted((r["uid"], r["page"]) for r in kept.collect()) == [("a", 2), ("b", 1)]
    assert [tuple(r) for r in errors.collect()] == [(2, "DELETE_ALL")]


def strips(spark, pages):
    rows = [
        (1, page, y, 0, len(lines[0]), len(lines), line) for page, lines in pages.items() for y, line in enumerate(lines)
    ]
    return spark.createDataFrame(rows, "doc_id int, page int, y int, chunk int, w int, h int, pixels array<int>")


def test_pixel_diff(spark):
    white, black, near = 0xFFFFFF, 0, 0xEBEBEB
    a = strips(spark, {1: [[white, near], [black, black]], 2: [[white] * 3]})
    b = strips(spark, {1: [[white, white, white]], 3: [[black, white]]})
    got = {r["page"]: (r["changed"], r["changed_percent"]) for r in Q.pixel_diff(a, b).collect()}
    # a gap of exactly 60 is no change; what lies outside a page is white
    assert got == {1: (2, pytest.approx(100 * 2 / 6)), 2: (0, 0), 3: (1, 50)}


def test_compare_docs(spark):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, None)], "doc_id int, page int, text string")
    b = spark.createDataFrame([(1, 1, "x"), (1, 2, "z"), (2, 1, "q")], "doc_id int, page int, text string")
    diff = spark.createDataFrame([(1, 1, 0.0), (1, 2, 12.5), (2, 1, 99.0)], "doc_id int, page int, changed_percent double")
    got = {(r["doc_id"], r["page"]): tuple(r)[2:] for r in Q.compare_docs(a, b, diff).collect()}
    assert got == {(1, 1): ("both", True, 0.0), (1, 2): ("both", False, 12.5), (1, 3): ("a", None, None), (2, 1): ("b", None, None)}
    report = {r["doc_id"]: tuple(r)[1:] for r in Q.page_count_report(a, b).collect()}
    assert report == {1: (3, 2, True), 2: (0, 1, True)}


def test_pick_quality(spark):
    variants = spark.createDataFrame(
        [(1, 1, q, q * 400) for q in (30, 40, 50, 75, 80)] + [(1, 2, 40, 99_000), (1, 2, 75, 100_000)] + [(2, 1, 75, 0)],
        "doc_id int, page int, quality int, bytes long",
    )
    targets = spark.createDataFrame([(1, 40_000), (2, 10)], "doc_id int, target_bytes long")
    got = {(r["doc_id"], r["page"]): (r["budget"], r["dpi"], r["quality"]) for r in Q.pick_quality(variants, targets, 75).collect()}
    # 20000 bytes a page: page 1 fits at 50, page 2 at nothing
    assert got == {(1, 1): (20_000, 150, 50), (1, 2): (20_000, 150, 40), (2, 1): (15_000, 150, 75)}


@pytest.mark.parametrize("budget,size,cap,dpi", [(90_000, 10_000, 300, 300), (20_000, 10_000, 300, 201), (1, 10_000, 300, 150), (1, 9, 40, 40), (5, 0, 200, 150)])
def test_fit_dpi(one, budget, size, cap, dpi):
    assert one(Q.fit_dpi(F.lit(budget), F.lit(size), cap)) == dpi


@pytest.mark.parametrize(
    "spec,n,size_in,size_out,target,chosen",
    [
        ("1-z", 3, 100, 100, None, "original"), ("1-3", 3, 100, 99, None, "rewrite"), ("2,1", 2, 100, 200, None, "rewrite"),
        ("1-z", 3, 0, 5, None, "rewrite"), ("1-z", 3, 100, 60, 60, "lossless"), ("1-z", 3, 100, 61, 60, "lossy"),
        ("1-z", 3, 100, 10, 49, "lossy"), ("1-z", 3, 100, 100, 200, "lossy"),
    ],
)
def test_pick_version(spark, spec, n, size_in, size_out, target, chosen):
    df = spark.createDataFrame([(spec, n, size_in, size_out, target)], "spec string, n int, in_bytes long, out_bytes long, target_bytes long")
    assert Q.pick_version(df).first()["chosen"] == chosen


def test_size_estimate(spark):
    df = spark.createDataFrame([("merge", 3), ("merge", 2), ("optimize", 3), ("crop", 3)], "tool string, size long")
    got = {r["tool"]: (r["bytes"], r["sufficient"]) for r in Q.size_estimate(df, free=F.lit(7)).collect()}
    assert got == {"merge": (8, False), "optimize": (8, False), "crop": (6, True)}


def test_validate_docs(spark):
    docs = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 1), (5, 1)], "doc_id int, version int")
    annots = spark.createDataFrame(
        [(1, 1, "rect", None, 0), (2, 1, "text", "long" * 9, 0), (4, 1, "ink", None, 10)]
        + [(5, i, "rect", None, 0) for i in range(4)]
        + [(4, 2, "text", "x" * 30, 0)],
        "doc_id int, ord int, kind string, content string, n_points int",
    )
    got = {r["doc_id"]: r["reason"] for r in Q.validate_docs(docs, annots, max_objects=3, max_chars=20, max_points=9).collect()}
    assert got == {1: None, 2: "BAD_EDIT", 3: "NO_EDITS", 4: "INK_TOO_LONG", 5: "TOO_MANY_OBJECTS"}
