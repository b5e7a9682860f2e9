"""Boxes, mappings, labels and inherited attributes."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.operators import geometry as G


def box(*v):
    return geo.box(*[F.lit(float(x)) for x in v])


def none():
    return F.lit(None).cast(G.BOX)


def made(v):
    return none() if v is None else box(*v)


@pytest.mark.parametrize(
    "media,crop,trim,visible,align",
    [
        ((0, 0, 612, 792), (72, 72, 540, 720), None, (72, 72, 540, 720), (72, 72, 540, 720)),
        ((0, 0, 612, 792), (72, 72, 540, 720), (0, 0, 612, 792), (72, 72, 540, 720), (0, 0, 612, 792)),
        ((0, 0, 612, 792), None, (-10, -10, 700, 700), (0, 0, 612, 792), (-10, -10, 700, 700)),
        ((612, 792, 0, 0), (611.5, 0, 900, 900), None, (0, 0, 612, 792), (611.5, 0, 900, 900)),
        ((0, 0, 100, 100), (-5, 50, 50, 900), None, (0, 50, 50, 100), (-5, 50, 50, 900)),
    ],
)
def test_boxes(one, media, crop, trim, visible, align):
    media, crop, trim = made(media), made(crop), made(trim)
    assert tuple(one(geo.visible_box(media, crop))) == visible
    assert tuple(one(geo.align_box(media, crop, trim))) == align


@pytest.mark.parametrize("rotate,size", [(0, (540, 720)), (90, (720, 540)), (180, (540, 720)), (-90, (720, 540)), (450, (720, 540))])
def test_displayed_size(one, rotate, size):
    assert tuple(one(geo.displayed_size(box(72, 72, 612, 792), F.lit(rotate)))) == size


@pytest.mark.parametrize("rotate", [0, 90, 180, 270])
def test_mapping_round_trip(one, rotate):
    page, r = box(10, 20, 310, 420), F.lit(rotate)
    there = geo.page_to_viewport(F.lit(33.0), F.lit(44.0), page, r, F.lit(700.0), F.lit(900.0))
    back = one(geo.viewport_to_page(there["x"], there["y"], page, r, F.lit(700.0), F.lit(900.0)))
    assert tuple(back) == pytest.approx((33, 44))
    rect = geo.rect(F.lit(30), F.lit(40), F.lit(50), F.lit(60))
    seen = geo.bbox_to_viewport(rect, page, r, F.lit(700.0), F.lit(900.0))
    assert tuple(one(geo.viewport_to_bbox(seen, page, r, F.lit(700.0), F.lit(900.0)))) == pytest.approx((30, 40, 50, 60))


@pytest.mark.parametrize(
    "rotate,want", [(0, (20, 20, 50, 60)), (90, (20, 230, 60, 50)), (180, (230, 320, 50, 60)), (270, (320, 20, 60, 50))]
)
def test_bbox_to_overlay(one, rotate, want):
    rect = geo.rect(F.lit(30), F.lit(40), F.lit(50), F.lit(60))
    assert tuple(one(geo.bbox_to_overlay(rect, box(10, 20, 310, 420), F.lit(rotate)))) == want


def test_small_things(one):
    dot = geo.rect(F.lit(5), F.lit(5), F.lit(0), F.lit(0))
    assert tuple(one(geo.bbox_to_overlay(dot, box(0, 0, 9, 9), F.lit(0)))) == (5, 5, 0.5, 0.5)
    assert tuple(one(geo.page_to_viewport(F.lit(1.0), F.lit(1.0), box(0, 0, 0, 9), F.lit(0), F.lit(5.0), F.lit(5.0)))) == (0, 0)
    assert tuple(one(geo.viewport_to_page(F.lit(1.0), F.lit(1.0), box(3, 4, 9, 9), F.lit(0), F.lit(0.0), F.lit(5.0)))) == (3, 4)
    assert tuple(one(geo.line_bounds(F.lit(9.0), F.lit(1.0), F.lit(4.0), F.lit(1.0)))) == (4, 1, 5, 1)
    assert tuple(one(geo.normalize_rect(geo.rect(F.lit(9), F.lit(9), F.lit(-4), F.lit(0.5))))) == (5, 9, 4, 1)
    points = F.array(geo.point(F.lit(3), F.lit(8)), geo.point(F.lit(1), F.lit(9)))
    assert tuple(one(geo.points_bounds(points))) == (1, 8, 2, 1)
    assert tuple(one(geo.points_bounds(F.array().cast("array<struct<x:double,y:double>>")))) == (0, 0, 1, 1)


@pytest.mark.parametrize(
    "total,tile,overlap,count", [(100, 100, 0, 1), (100.5, 100, 0, 1), (100.500001, 100, 0, 2), (300, 100, 0, 3), (300, 100, 25, 4)]
)
def test_tile_count(one, total, tile, overlap, count):
    assert one(geo.tile_count(F.lit(float(total)), F.lit(float(tile)), F.lit(float(overlap)))) == count


@pytest.mark.parametrize(
    "w,h,label", [(210, 297, "A4 (210 × 297 mm)"), (420, 297, "A3 (420 × 297 mm)"), (123.4, 456.6, "123 × 457 mm"), (215.9, 279.4, "216 × 279 mm")]
)
def test_paper_class(one, w, h, label):
    assert one(geo.paper_class(F.lit(w * geo.PT_PER_MM), F.lit(h * geo.PT_PER_MM))) == label


def test_fit_box(one):
    area = geo.rect(F.lit(10), F.lit(20), F.lit(100), F.lit(100))
    assert tuple(one(geo.fit_box(area, F.lit(50.0), F.lit(25.0)))) == (10, 45, 100, 50)
    assert tuple(one(geo.fit_box(area, F.lit(0.0), F.lit(0.0)))) == (10, 20, 100, 100)
    assert one(geo.scan_size(F.lit(300), F.lit(150))) == 144


def test_labels(one):
    label, w, h = F.lit("12345"), F.lit(600.0), F.lit(800.0)
    wide = 5 * 0.56 * 12
    assert tuple(one(G.number_place(label, w, h, "bottom-center")))[:2] == pytest.approx(((600 - wide) / 2, 28))
    assert tuple(one(G.number_place(label, w, h, "top-right")))[:2] == pytest.approx((600 - 40 - wide, 760))
    assert one(G.number_place(label, F.lit(30.0), h, "bottom-right"))["x"] == 8
    stamp = one(G.stamp_place(label, w, h, "bottom-left", 0.001))
    assert tuple(stamp)[:3] == pytest.approx((24, 32, 12))
    stamp = one(G.stamp_place(label, w, h, "center", 9))
    assert tuple(stamp)[:3] == pytest.approx((max((600 - 5 * 0.52 * 160) / 2, 24), 320, 160))
    mark = one(G.watermark_place(label, w, h, 7))
    size = 56 * 600 / 612
    assert mark["size"] == pytest.approx(size) and mark["opacity"] == 1
    assert mark["x"] == pytest.approx(300 - 5 * 0.5 * size / 2 * 0.5**0.5)


def tree(spark, rows):
    schema = f"doc_id int, node int, parent int, media {G.BOX}, crop {G.BOX}, trim {G.BOX}, rotate int, user_unit double"
    return spark.createDataFrame(rows, schema)


def test_inheritance(spark):
    a4, cut = (0.0, 0.0, 595.0, 842.0), (9.0, 8.0, 1.0, 2.0)
    nodes = tree(
        spark,
        [
            (1, 1, None, a4, None, (1.0, 1.0, 2.0, 2.0), -90, 2.0),
            (1, 2, 1, None, cut, None, None, 3.0),
            (1, 3, 2, None, None, None, None, None),
            (1, 4, 2, (10.0, 10.0, 0.0, 0.0), None, cut, 450, 2.0),
            (1, 5, 1, None, None, None, None, float("inf")),
            (2, 1, None, None, None, None, None, -1.0),
        ],
    )
    got = {(r["doc_id"], r["node"]): r for r in G.resolve_inherited(nodes).collect()}
    assert set(got) == {(1, 3), (1, 4), (1, 5), (2, 1)}
    third = got[1, 3]
    assert (tuple(third["media"]), tuple(third["crop"]), third["trim"], third["rotate"], third["user_unit"]) == (
        a4, (1, 2, 9, 8), None, 270, 1.0,
    )
    own = got[1, 4]
    assert (tuple(own["media"]), tuple(own["trim"]), own["rotate"], own["user_unit"]) == ((0, 0, 10, 10), (1, 2, 9, 8), 90, 2.0)
    assert got[1, 5]["crop"] is None and got[1, 5]["user_unit"] == 1
    assert tuple(got[2, 1]["media"]) == (0, 0, 612, 792) and got[2, 1]["rotate"] == 0


@pytest.mark.parametrize("depth,most,found", [(33, 33, True), (34, 33, False), (34, 34, True), (700, None, True)])
def test_inheritance_reaches_any_depth_or_a_stated_one(spark, depth, most, found):
    """With a limit of 33 a page and 32 nodes above it are looked at, no more."""
    rows = [(1, i, i + 1 if i < depth else None, None, None, None, 90 if i == depth else None, None) for i in range(1, depth + 1)]
    assert G.resolve_inherited(tree(spark, rows), max_up=most).first()["rotate"] == (90 if found else 0)


def test_cycles_and_missing_parents_are_reported(spark):
    none = (None,) * 5
    rows = [(1, 1, 2, *none), (1, 2, 3, *none), (1, 3, 4, *none), (1, 4, 2, *none), (2, 1, 2, *none), (2, 2, None, *none), (3, 1, 2, *none), (3, 2, 9, *none), (4, 5, 5, *none)]
    got = sorted(tuple(r) for r in G.tree_cycles(tree(spark, rows)).collect())
    assert got == [(1, 2, "CYCLE"), (1, 3, "CYCLE"), (1, 4, "CYCLE"), (3, 2, "NO_PARENT"), (4, 5, "CYCLE")]


def test_inheritance_against_walking(spark):
    """Random forests, one document with most nodes, long chains and cycles among them."""
    rng = random.Random(31)
    rows, by = [], {}
    for doc, size in ((1, 400), (2, 30), (3, 5), (4, 1)):
        for i in range(size):
            parent = i - 1 if rng.random() < 0.8 else rng.randrange(size + 2)
            parent = None if i == 0 or rng.random() < 0.02 else parent
            box_ = (0.0, 0.0, float(i + 1), 5.0) if rng.random() < 0.02 else None
            turn = 90 * rng.randrange(4) if rng.random() < 0.02 else None
            rows.append((doc, i, parent, box_, None, None, turn, None))
            by[doc, i] = (parent, box_, turn)
    parents = {(d, p) for (d, _), (p, *_) in by.items()}

    def walked(doc, node, place):
        seen = set()
        while node is not None and (doc, node) in by and node not in seen:
            if by[doc, node][place] is not None:
                return by[doc, node][place]
            seen.add(node)
            node = by[doc, node][0]

    got = {(r["doc_id"], r["node"]): (tuple(r["media"]), r["rotate"]) for r in G.resolve_inherited(tree(spark, rows)).collect()}
    assert got == {k: (walked(*k, 1) or (0, 0, 612, 792), walked(*k, 2) or 0) for k in by if k not in parents}


def test_inheritance_survives_a_cycle(spark):
    rows = [(1, 1, 2, None, None, None, None, None), (1, 2, 3, None, None, None, 90, None), (1, 3, 2, None, None, None, None, None)]
    got = G.resolve_inherited(tree(spark, rows)).collect()
    assert [(r["node"], r["rotate"]) for r in got] == [(1, 90)]


@pytest.mark.parametrize(
    "rotate,want", [(0, (10, 60, 80, 180)), (90, (10, 20, 70, 160)), (180, (20, 20, 90, 140)), (270, (30, 40, 90, 180))]
)
def test_crop(spark, rotate, want):
    # left 10, top 10, right 20, bottom 30 percent as seen
    df = spark.range(1).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page"), box(0, 0, 100, 200).alias("media"), none().alias("crop"),
        box(0, 0, 5, 5).alias("trim"), F.lit(rotate).alias("rotate"),
    )
    good, bad = G.crop(df, 10, 10, 20, 30)
    row = good.first()
    assert tuple(row["crop"]) == pytest.approx(want)
    assert tuple(row["media"]) == pytest.approx(want) and "trim" not in row.asDict()
    assert bad.count() == 0
    good, bad = G.crop(df, 50, 0, 49.5, 0)
    assert (good.count(), bad.count()) == ((0, 1) if rotate in (0, 180) else (1, 0))


def test_point_rows(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 5.0, 3.0), (2, 1.0, 1.0)], "id int, x double, y double")
    got = {r["id"]: tuple(r["rect"]) for r in G.bounds(df, ["id"]).collect()}
    assert got == {1: (2, 3, 3, 1), 2: (1, 1, 1, 1)}
