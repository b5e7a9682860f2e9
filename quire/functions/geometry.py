"""Page geometry in points. Boxes are struct<x0,y0,x1,y1>, rects struct<x,y,w,h>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import col, let

PT_PER_MM = 2.834645669

# ISO A sheets, short and long side in mm.
ISO_A = {
    "A0": (841, 1189),
    "A1": (594, 841),
    "A2": (420, 594),
    "A3": (297, 420),
    "A4": (210, 297),
    "A5": (148, 210),
}

# Poster papers, width and height in mm.
PAPERS = {"a4": (210.0, 297.0), "a3": (297.0, 420.0), "letter": (215.9, 279.4)}

PAGE_NUMBER_ANCHORS = [
    "bottom-center", "bottom-right", "bottom-left", "top-right", "top-center", "top-left",
]


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        x1.cast("double").alias("x1"),
        y1.cast("double").alias("y1"),
    )


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(
        x.cast("double").alias("x"),
        y.cast("double").alias("y"),
        w.cast("double").alias("w"),
        h.cast("double").alias("h"),
    )


def normalize_box(b: Column | str) -> Column:
    """Lower-left and upper-right corners in order; null stays null."""
    v = col(b)
    fixed = box(
        F.least(v["x0"], v["x1"]),
        F.least(v["y0"], v["y1"]),
        F.greatest(v["x0"], v["x1"]),
        F.greatest(v["y0"], v["y1"]),
    )
    return F.when(v.isNotNull(), fixed)


def visible_box(media: Column | str, crop: Column | str) -> Column:
    """Crop within media, or media when less than 1 pt would be left."""

    def meet(v: Column) -> Column:
        m, c = v["m"], v["c"]
        x0, y0 = F.greatest(c["x0"], m["x0"]), F.greatest(c["y0"], m["y0"])
        x1, y1 = F.least(c["x1"], m["x1"]), F.least(c["y1"], m["y1"])
        overlap = c.isNotNull() & (x1 - x0 > 1) & (y1 - y0 > 1)
        return F.when(overlap, box(x0, y0, x1, y1)).otherwise(m)

    # bound once: filters on what follows would otherwise repeat both boxes many times
    return let(F.struct(normalize_box(media).alias("m"), normalize_box(crop).alias("c")), meet)


def align_box(media: Column | str, crop: Column | str, trim: Column | str) -> Column:
    """The page's own trim box unclipped, else crop, else media."""
    return F.coalesce(normalize_box(trim), normalize_box(crop), normalize_box(media))


def turn(rotate: Column | str) -> Column:
    return F.pmod(col(rotate), F.lit(360))


def displayed_size(b: Column | str, rotate: Column | str) -> Column:
    """struct(w, h) of a box as shown; the sides swap at 90 and 270."""

    v = col(b)
    w, h = v["x1"] - v["x0"], v["y1"] - v["y0"]
    sideways = F.pmod(turn(rotate), F.lit(180)) == 90
    return F.struct(
        F.when(sideways, h).otherwise(w).alias("w"), F.when(sideways, w).otherwise(h).alias("h")
    )


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _by_turn(rotate: Column, zero: Column, quarter: Column, half: Column, three: Column) -> Column:
    r = turn(rotate)
    return F.when(r == 90, quarter).when(r == 180, half).when(r == 270, three).otherwise(zero)


def page_to_display(rx: Column, ry: Column, w: Column, h: Column, rotate: Column) -> Column:
    """Box-relative point to displayed space; pages turn clockwise."""
    return point(
        _by_turn(rotate, rx, ry, w - rx, h - ry), _by_turn(rotate, ry, w - rx, h - ry, rx)
    )


def display_to_page(dx: Column, dy: Column, w: Column, h: Column, rotate: Column) -> Column:
    """Inverse of ``page_to_display``."""
    return point(
        _by_turn(rotate, dx, w - dy, w - dx, dy), _by_turn(rotate, dy, dx, h - dy, h - dx)
    )


def page_to_viewport(
    x: Column, y: Column, page: Column, rotate: Column, css_w: Column, css_h: Column
) -> Column:
    """Absolute page point to pixels; the y axis flips. Empty sizes give 0,0."""
    shown = page_to_display(
        x - page["x0"],
        y - page["y0"],
        page["x1"] - page["x0"],
        page["y1"] - page["y0"],
        rotate,
    )

    def scaled(v: Column) -> Column:
        s, p = v["s"], v["p"]
        usable = (s["w"] > 0) & (s["h"] > 0) & (css_w > 0) & (css_h > 0)
        return F.when(
            usable, point(p["x"] / s["w"] * css_w, (s["h"] - p["y"]) / s["h"] * css_h)
        ).otherwise(point(F.lit(0), F.lit(0)))

    return let(F.struct(displayed_size(page, rotate).alias("s"), shown.alias("p")), scaled)


def viewport_to_page(
    px: Column, py: Column, page: Column, rotate: Column, css_w: Column, css_h: Column
) -> Column:
    """Pixels to an absolute page point. Empty sizes give the box origin."""

    def placed(v: Column) -> Column:
        s, b = v["s"], v["b"]
        usable = (s["w"] > 0) & (s["h"] > 0) & (css_w > 0) & (css_h > 0)
        dx = F.try_divide(v["px"], css_w) * s["w"]
        dy = s["h"] - F.try_divide(v["py"], css_h) * s["h"]
        p = display_to_page(dx, dy, b["x1"] - b["x0"], b["y1"] - b["y0"], rotate)
        return F.when(usable, point(b["x0"] + p["x"], b["y0"] + p["y"])).otherwise(
            point(b["x0"], b["y0"])
        )

    bound = F.struct(
        displayed_size(page, rotate).alias("s"), page.alias("b"), px.alias("px"), py.alias("py")
    )
    return let(bound, placed)


def spanned_rect(p: Column, q: Column, min_side: float = 0.0) -> Column:
    """Rect between two opposite corners, sides at least ``min_side``."""
    side = F.lit(float(min_side))
    return rect(
        F.least(p["x"], q["x"]),
        F.least(p["y"], q["y"]),
        F.greatest(F.abs(p["x"] - q["x"]), side),
        F.greatest(F.abs(p["y"] - q["y"]), side),
    )


def enclosing_rect(points: Column, min_side: float = 0.0) -> Column:
    """Smallest rect around an array of points, sides at least ``min_side``."""

    def build(p: Column) -> Column:
        xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        x, y = F.array_min(xs), F.array_min(ys)
        side = F.lit(float(min_side))
        return rect(
            x,
            y,
            F.greatest(F.array_max(xs) - x, side),
            F.greatest(F.array_max(ys) - y, side),
        )

    return let(points, build)


def bbox_to_overlay(r: Column, page: Column, rotate: Column) -> Column:
    """Rect in page space to displayed space, at least half a point a side.

    Quarter turns keep sides upright, so two opposite corners span the result.
    """
    w, h = page["x1"] - page["x0"], page["y1"] - page["y0"]
    x, y = r["x"] - page["x0"], r["y"] - page["y0"]
    return spanned_rect(
        page_to_display(x, y, w, h, rotate),
        page_to_display(x + r["w"], y + r["h"], w, h, rotate),
        0.5,
    )


def _mapped_rect(r: Column, to_point: Callable[[Column, Column], Column]) -> Column:
    """Rect between the mapped opposite corners of another one."""

    def ends(v: Column) -> Column:
        return F.struct(
            to_point(v["x"], v["y"]).alias("p"), to_point(v["x"] + v["w"], v["y"] + v["h"]).alias("q")
        )

    return let(let(r, ends), lambda e: spanned_rect(e["p"], e["q"]))


def bbox_to_viewport(
    r: Column, page: Column, rotate: Column, css_w: Column, css_h: Column
) -> Column:
    return _mapped_rect(r, lambda x, y: page_to_viewport(x, y, page, rotate, css_w, css_h))


def viewport_to_bbox(
    r: Column, page: Column, rotate: Column, css_w: Column, css_h: Column
) -> Column:
    return _mapped_rect(r, lambda x, y: viewport_to_page(x, y, page, rotate, css_w, css_h))


def normalize_rect(r: Column, min_side: float = 1.0) -> Column:
    """Positive sides of at least ``min_side``; negative sides flip the origin."""
    side = F.lit(float(min_side))
    return rect(
        F.least(r["x"], r["x"] + r["w"]),
        F.least(r["y"], r["y"] + r["h"]),
        F.greatest(F.abs(r["w"]), side),
        F.greatest(F.abs(r["h"]), side),
    )


def line_bounds(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return normalize_rect(
        rect(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))
    )


def points_bounds(points: Column | str) -> Column:
    """Box around an array of points; an empty array is 0,0,1,1."""
    p = col(points)
    unit = rect(F.lit(0), F.lit(0), F.lit(1), F.lit(1))
    return F.when(F.size(p) == 0, unit).otherwise(enclosing_rect(p, 1.0))


def paper_class(w_pt: Column | str, h_pt: Column | str) -> Column:
    """"A4 (210 × 297 mm)" within 6 mm of an ISO A sheet, else "w × h mm"."""
    w, h = col(w_pt) * (1 / PT_PER_MM), col(h_pt) * (1 / PT_PER_MM)
    lo, hi = F.least(w, h), F.greatest(w, h)
    # halves round up, as the printed labels do
    label = F.concat(
        F.floor(w + 0.5).cast("string"), F.lit(" × "), F.floor(h + 0.5).cast("string"), F.lit(" mm")
    )
    name = None
    for sheet, (a, b) in ISO_A.items():
        hit = (F.abs(lo - a) <= 6) & (F.abs(hi - b) <= 6)
        name = F.when(hit, sheet) if name is None else name.when(hit, sheet)
    return F.when(name.isNull(), label).otherwise(
        F.concat(name, F.lit(" ("), label, F.lit(")"))
    )


def fit_box(b: Column, iw: Column | str, ih: Column | str) -> Column:
    """Image of iw x ih centred in a rect at the largest size that fits."""
    w, h = F.greatest(col(iw), F.lit(1.0)), F.greatest(col(ih), F.lit(1.0))
    s = F.least(b["w"] / w, b["h"] / h)
    return rect(b["x"] + (b["w"] - w * s) / 2, b["y"] + (b["h"] - h * s) / 2, w * s, h * s)


def scan_size(pixels: Column | str, dpi: Column | str) -> Column:
    """Physical points of a scanned side."""
    return col(pixels) * 72.0 / col(dpi)


def tile_count(total: Column, tile: Column, overlap: Column) -> Column:
    """Tiles that span a length, with half a point of grace for one tile."""
    step = F.greatest(tile - overlap, F.lit(1.0))
    return F.when(total <= tile + 0.5, F.lit(1).cast("bigint")).otherwise(
        F.ceil((total - tile) / step) + 1
    )
