"""Geometry over page and annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import col, let
from quire.functions import geometry as geo
from quire.plans.climb import climb

DEFAULT_BOX = (0.0, 0.0, 612.0, 792.0)
LABEL_SIZE = 12.0
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def _inner(nodes: DataFrame) -> DataFrame:
    """The nodes that are somebody's parent, with their own boxes."""
    parents = (
        nodes.filter(F.col("parent").isNotNull()).select("doc_id", F.col("parent").alias("node")).distinct()
    )
    return nodes.select(
        "doc_id",
        "node",
        "parent",
        geo.normalize_box("media").alias("media"),
        geo.normalize_box("crop").alias("crop"),
        F.col("rotate").alias("rotate"),
    ).join(parents, ["doc_id", "node"], "left_semi")


def tree_cycles(nodes: DataFrame) -> DataFrame:
    """(doc_id, node, error): inner nodes whose way up never ends (CYCLE) or ends at a parent that is missing (NO_PARENT)."""
    walks = climb(_inner(nodes), {})
    return walks.filter(~F.col("rooted") | F.col("up").isNotNull()).select(
        "doc_id", "node", F.when(F.col("up").isNotNull(), "CYCLE").otherwise("NO_PARENT").alias("error")
    )


def resolve_inherited(nodes: DataFrame, pages: DataFrame | None = None, max_up: int | None = None) -> DataFrame:
    """Effective boxes of pages from a page tree.

    ``nodes`` is (doc_id, node, parent, media, crop, trim, rotate, user_unit);
    boxes are structs, null where absent or invalid. ``pages`` (doc_id, node)
    names the wanted nodes, by default those that are nobody's parent. The
    nearest node on the way up wins for media, crop and rotate, however far it is,
    or among ``max_up`` nodes with the page itself; trim and unit are the page's
    own. On a cycle every node is met once; ``tree_cycles`` reports those.

    Inner nodes find their values by pointer doubling, and pages then take the
    result of their parent with one join.
    """
    def nearest(own: Column, above: Column) -> Column:
        # ``l.steps`` nodes lie between a node and the one it points to
        return F.coalesce(own, F.when(above.isNotNull(), F.struct(above["v"].alias("v"), (above["at"] + F.col("l.steps")).alias("at"))))

    def placed(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("v"), F.lit(0).cast("bigint").alias("at")))

    names = ("media", "crop", "rotate")
    inner = _inner(nodes)
    walks = climb(inner, {n: (placed(n), nearest) for n in names}, F.col("media").isNotNull() & F.col("crop").isNotNull() & F.col("rotate").isNotNull())
    # the page is the first node, its parent the second
    near = {n: F.col(n) if max_up is None else F.when(F.col(n)["at"] + 2 <= max_up, F.col(n)) for n in names}
    known = walks.select("doc_id", F.col("node").alias("parent"), *[c["v"].alias(f"__{n}") for n, c in near.items()])
    if pages is None:
        wanted = nodes.join(inner.select("doc_id", "node"), ["doc_id", "node"], "left_anti")
    else:
        wanted = nodes.join(pages.select("doc_id", "node"), ["doc_id", "node"], "left_semi")
    unit = F.col("user_unit")
    unit_ok = (unit > 0) & (unit < float("inf")) & ~F.isnan(unit)
    default = geo.box(*[F.lit(v) for v in DEFAULT_BOX])
    return wanted.join(known, ["doc_id", "parent"], "left").select(
        "doc_id",
        "node",
        F.coalesce(geo.normalize_box("media"), F.col("__media"), default).alias("media"),
        F.coalesce(geo.normalize_box("crop"), F.col("__crop")).alias("crop"),
        geo.normalize_box("trim").alias("trim"),
        F.pmod(F.coalesce(F.col("rotate"), F.col("__rotate"), F.lit(0)), F.lit(360)).alias("rotate"),
        F.when(unit_ok, unit).otherwise(F.lit(1.0)).alias("user_unit"),
    )


def crop(
    pages: DataFrame, left: float, top: float, right: float, bottom: float
) -> tuple[DataFrame, DataFrame]:
    """Trim percents of the visible box as seen; pages left under 1 pt are refused.

    ``pages`` has media, crop and rotate. The crop box becomes the new window;
    media follows only when the window lies inside it; trim, bleed and art boxes
    are dropped.
    """
    r = geo.turn("rotate")

    def edge(zero: float, quarter: float, half: float, three: float) -> Column:
        return (
            F.when(r == 90, quarter).when(r == 180, half).when(r == 270, three).otherwise(zero)
        )

    def window(v: Column) -> Column:
        w, h = v["x1"] - v["x0"], v["y1"] - v["y0"]
        return geo.box(
            v["x0"] + w * edge(left, top, right, bottom) / 100.0,
            v["y0"] + h * edge(bottom, left, top, right) / 100.0,
            v["x1"] - w * edge(right, bottom, left, top) / 100.0,
            v["y1"] - h * edge(top, right, bottom, left) / 100.0,
        )

    rest = [c for c in pages.columns if c not in ("media", "crop", "trim", "bleed", "art")]
    cut = pages.withColumn("__w", let(geo.visible_box("media", "crop"), window))
    too_much = (F.col("__w.x1") - F.col("__w.x0") < 1.0) | (F.col("__w.y1") - F.col("__w.y0") < 1.0)
    media = geo.normalize_box("media")
    inside = (
        (F.col("__w.x0") >= media["x0"] - 0.01)
        & (F.col("__w.y0") >= media["y0"] - 0.01)
        & (F.col("__w.x1") <= media["x1"] + 0.01)
        & (F.col("__w.y1") <= media["y1"] + 0.01)
    )
    good = cut.filter(~too_much).select(
        *rest,
        F.when(inside, F.col("__w")).otherwise(media).alias("media"),
        F.col("__w").alias("crop"),
    )
    keys = [c for c in ("doc_id", "page") if c in pages.columns]
    return good, cut.filter(too_much).select(*keys, F.lit("CROP_TOO_MUCH").alias("error"))


def map_bbox(annots: DataFrame, pages: DataFrame, target: str = "overlay") -> DataFrame:
    """Annotation rects in the space of their page as displayed.

    ``annots`` is (doc_id, page, rect, ...), ``pages`` (doc_id, page, box, rotate)
    and, for target "viewport", css_w and css_h in pixels.
    """
    joined = annots.join(pages, ["doc_id", "page"])
    if target == "overlay":
        mapped = geo.bbox_to_overlay(F.col("rect"), F.col("box"), F.col("rotate"))
    elif target == "viewport":
        mapped = geo.bbox_to_viewport(
            F.col("rect"), F.col("box"), F.col("rotate"), F.col("css_w"), F.col("css_h")
        )
    else:
        raise ValueError(f"unknown target {target}")
    return joined.select(*annots.columns, mapped.alias("mapped"))


def bounds(points: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, rect) around point rows, sides at least 1."""
    edges = points.groupBy(*keys).agg(
        F.min(x).alias("__x0"), F.min(y).alias("__y0"), F.max(x).alias("__x1"), F.max(y).alias("__y1")
    )
    one = F.lit(1.0)
    return edges.select(
        *keys,
        geo.rect(
            F.col("__x0"),
            F.col("__y0"),
            F.greatest(F.col("__x1") - F.col("__x0"), one),
            F.greatest(F.col("__y1") - F.col("__y0"), one),
        ).alias("rect"),
    )


def number_place(label: Column | str, w: Column | str, h: Column | str, anchor: str) -> Column:
    """struct(x, y, size, opacity) of a page number at one of six anchors."""
    wide = F.length(col(label)) * 0.56 * LABEL_SIZE
    x = (
        col(w) - 40.0 - wide
        if anchor in ("bottom-right", "top-right")
        else F.lit(40.0)
        if anchor in ("bottom-left", "top-left")
        else (col(w) - wide) / 2.0
    )
    y = col(h) - 40.0 if anchor in ("top-right", "top-center", "top-left") else F.lit(28.0)
    return _place(F.greatest(x, F.lit(8.0)), y, F.lit(LABEL_SIZE), F.lit(1.0))


def stamp_place(
    label: Column | str, w: Column | str, h: Column | str, anchor: str, size_pct: float
) -> Column:
    """struct of a stamp at one of nine anchors, its size a share of the height."""
    size = col(h) * min(max(size_pct, 0.015), 0.2)
    wide = F.length(col(label)) * 0.52 * size
    mx, my = col(w) * 0.04, col(h) * 0.04
    if anchor.endswith("left"):
        x = mx
    elif anchor.endswith("right"):
        x = F.greatest(col(w) - wide - mx, mx)
    else:
        x = F.greatest((col(w) - wide) / 2.0, mx)
    if anchor.startswith("top"):
        y = col(h) - my - size
    elif anchor.startswith("bottom"):
        y = my
    else:
        y = (col(h) - size) / 2.0
    return _place(x, y, size, F.lit(1.0))


def watermark_place(
    label: Column | str, w: Column | str, h: Column | str, opacity: float
) -> Column:
    """struct of a watermark through the page centre at 45 degrees."""
    size = F.least(col(w), col(h)) / 612.0 * 56.0
    half = F.length(col(label)) * 0.5 * size / 2.0 * 0.5**0.5
    return _place(
        col(w) / 2.0 - half, col(h) / 2.0 - half, size, F.lit(min(max(opacity, 0.05), 1.0))
    )


def _place(x: Column, y: Column, size: Column, opacity: Column) -> Column:
    return F.struct(
        x.cast("double").alias("x"),
        y.cast("double").alias("y"),
        size.cast("double").alias("size"),
        opacity.cast("double").alias("opacity"),
    )


def place_label(
    labels: DataFrame,
    pages: DataFrame,
    kind: str,
    anchor: str = "bottom-center",
    size_pct: float = 0.05,
    opacity: float = 0.2,
) -> DataFrame:
    """Labels (doc_id, page, label) with their place on the displayed page.

    ``pages`` is (doc_id, page, w, h). A stamp's page number is clamped to the
    document, which then needs a column ``n`` on ``labels``.
    """
    if kind == "stamp":
        clamped = F.greatest(F.least(F.col("page"), F.greatest(F.col("n"), F.lit(1))), F.lit(1))
        labels = labels.withColumn("page", clamped)
        place = stamp_place("label", "w", "h", anchor, size_pct)
    elif kind == "watermark":
        place = watermark_place("label", "w", "h", opacity)
    elif kind == "number":
        place = number_place("label", "w", "h", anchor)
    else:
        raise ValueError(f"unknown label kind {kind}")
    return labels.join(pages.select("doc_id", "page", "w", "h"), ["doc_id", "page"]).select(
        *labels.columns, place.alias("place")
    )
