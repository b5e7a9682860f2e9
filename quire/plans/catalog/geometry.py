"""Geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.operators import geometry as G
from quire.plans.registry import query
from quire.plans.roles import PART_BOXES, part_boxes, rounded, table

CORNERS = ("x0", "y0", "x1", "y1")


def _flat(column, prefix, names):
    return [rounded(F.col(column)[n]).alias(f"{prefix}{n}") for n in names]


def _tree(spark, sf_dir):
    """region > nation > customer as a page tree, one document per region."""
    none_box = F.lit(None).cast(G.BOX)
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rk = F.col("r_regionkey").cast("bigint")
    top = region.select(
        rk.alias("doc_id"),
        rk.alias("node"),
        F.lit(None).cast("bigint").alias("parent"),
        geo.box(F.lit(0), F.lit(0), 500 + rk * 10, F.lit(700)).alias("media"),
        F.when(rk == 2, geo.box(F.lit(400), F.lit(500), F.lit(20), F.lit(30))).alias("crop"),
        geo.box(F.lit(1), F.lit(1), F.lit(9), F.lit(9)).alias("trim"),
        F.when(rk != 1, (rk * 90 - 90).cast("int")).alias("rotate"),
        F.lit(2.0).alias("user_unit"),
    )
    nk = F.col("n_nationkey").cast("bigint")
    middle = nation.select(
        F.col("n_regionkey").cast("bigint").alias("doc_id"),
        (nk + 100).alias("node"),
        F.col("n_regionkey").cast("bigint").alias("parent"),
        F.when(nk > 20, geo.box(F.lit(0), F.lit(0), F.lit(300), F.lit(300) + nk)).alias("media"),
        F.when(nk < 4, geo.box(F.lit(10), F.lit(10), F.lit(90), F.lit(95) + nk)).alias("crop"),
        none_box.alias("trim"),
        F.when(nk > 12, (nk * 90).cast("int")).alias("rotate"),
        F.lit(None).cast("double").alias("user_unit"),
    )
    seg, bal = F.col("c_mktsegment"), F.col("c_acctbal")
    bottom = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("n_regionkey").cast("bigint").alias("doc_id"),
        (F.col("c_custkey") + 1000).alias("node"),
        (F.col("c_nationkey") + 100).cast("bigint").alias("parent"),
        F.when(seg == "BUILDING", geo.box(bal, bal, F.lit(0), F.lit(0))).alias("media"),
        F.when(seg == "MACHINERY", geo.box(F.lit(5), F.lit(6), F.lit(70), F.lit(80))).alias("crop"),
        F.when(seg == "HOUSEHOLD", geo.box(F.lit(8), F.lit(8), bal, F.lit(2))).alias("trim"),
        F.when(seg == "FURNITURE", F.lit(-90)).alias("rotate"),
        F.when(seg == "AUTOMOBILE", bal).alias("user_unit"),
    )
    return top.unionByName(middle).unionByName(bottom)


@query(
    "resolve_inherited",
    """
    WITH c AS (
        SELECT n_regionkey::BIGINT AS doc_id, c_custkey + 1000 AS node, c_mktsegment AS seg, c_acctbal AS bal,
               c_nationkey AS nk, n_regionkey AS rk
        FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT doc_id, node,
           (CASE WHEN seg = 'BUILDING' THEN least(bal, 0) ELSE 0 END + 0.0)::DOUBLE AS mx0,
           (CASE WHEN seg = 'BUILDING' THEN greatest(bal, 0) WHEN nk > 20 THEN 300 ELSE 500 + rk * 10 END)::DOUBLE AS mx1,
           (CASE WHEN seg = 'BUILDING' THEN greatest(bal, 0) WHEN nk > 20 THEN 300 + nk ELSE 700 END)::DOUBLE AS my1,
           (CASE WHEN seg = 'MACHINERY' THEN 70 WHEN nk < 4 THEN 90 WHEN rk = 2 THEN 400 END)::DOUBLE AS cx1,
           (CASE WHEN seg = 'MACHINERY' THEN 80 WHEN nk < 4 THEN 95 + nk WHEN rk = 2 THEN 500 END)::DOUBLE AS cy1,
           (CASE WHEN seg = 'HOUSEHOLD' THEN greatest(8, bal) END)::DOUBLE AS tx1,
           (CASE WHEN seg = 'FURNITURE' THEN 270 WHEN nk > 12 THEN (nk * 90) % 360
                 WHEN rk <> 1 THEN (rk * 90 + 270) % 360 ELSE 0 END)::INTEGER AS rotate,
           (CASE WHEN seg = 'AUTOMOBILE' AND bal > 0 THEN bal ELSE 1 END)::DOUBLE AS user_unit
    FROM c
    """,
)
def _resolve_inherited(spark, sf_dir):
    nodes = _tree(spark, sf_dir)
    pages = G.resolve_inherited(nodes, nodes.filter(F.col("node") >= 1000))
    return pages.select(
        "doc_id", "node", rounded("media.x0").alias("mx0"), F.col("media.x1").alias("mx1"),
        F.col("media.y1").alias("my1"), F.col("crop.x1").alias("cx1"), F.col("crop.y1").alias("cy1"),
        F.col("trim.x1").alias("tx1"), "rotate", "user_unit",
    )


@query(
    "visible_box",
    f"""
    WITH {PART_BOXES}
    SELECT doc_id, page, round(vx0, 9) + 0.0 AS vx0, round(vy0, 9) + 0.0 AS vy0, round(vx1, 9) + 0.0 AS vx1,
           round(vy1, 9) + 0.0 AS vy1,
           round(CASE WHEN has_trim THEN -10 WHEN has_crop THEN cx0 ELSE mx0 END, 9)::DOUBLE + 0.0 AS ax0,
           round(CASE WHEN has_trim THEN -10 WHEN has_crop THEN cy0 ELSE my0 END, 9)::DOUBLE + 0.0 AS ay0,
           round(CASE WHEN has_trim THEN mx1 WHEN has_crop THEN cx1 ELSE mx1 END, 9)::DOUBLE + 0.0 AS ax1,
           round(CASE WHEN has_trim THEN my1 WHEN has_crop THEN cy1 ELSE my1 END, 9)::DOUBLE + 0.0 AS ay1
    FROM visible
    """,
)
def _visible_box(spark, sf_dir):
    pages = part_boxes(spark, sf_dir)
    boxes = pages.select(
        "doc_id", "page", geo.visible_box("media", "crop").alias("v"), geo.align_box("media", "crop", "trim").alias("a")
    )
    return boxes.select("doc_id", "page", *_flat("v", "v", CORNERS), *_flat("a", "a", CORNERS))


@query(
    "displayed_size",
    f"""
    WITH {PART_BOXES}
    SELECT doc_id, page,
           round(CASE WHEN rotate % 180 = 90 THEN vy1 - vy0 ELSE vx1 - vx0 END, 9) + 0.0 AS w,
           round(CASE WHEN rotate % 180 = 90 THEN vx1 - vx0 ELSE vy1 - vy0 END, 9) + 0.0 AS h
    FROM visible
    """,
)
def _displayed_size(spark, sf_dir):
    pages = part_boxes(spark, sf_dir).withColumn("v", geo.visible_box("media", "crop"))
    return pages.select("doc_id", "page", geo.displayed_size("v", "rotate").alias("s")).select(
        "doc_id", "page", *_flat("s", "", ("w", "h"))
    )


CROP_SQL = f"""
    {PART_BOXES},
    edges AS (
        SELECT *, CASE rotate WHEN 90 THEN 3 WHEN 180 THEN 30 WHEN 270 THEN 69 ELSE 10 END AS l,
               CASE rotate WHEN 90 THEN 30 WHEN 180 THEN 69 WHEN 270 THEN 10 ELSE 3 END AS t,
               CASE rotate WHEN 90 THEN 69 WHEN 180 THEN 10 WHEN 270 THEN 3 ELSE 30 END AS r,
               CASE rotate WHEN 90 THEN 10 WHEN 180 THEN 3 WHEN 270 THEN 30 ELSE 69 END AS b
        FROM visible),
    cut AS (
        SELECT *, vx0 + (vx1 - vx0) * l / 100 AS nx0, vy0 + (vy1 - vy0) * b / 100 AS ny0,
               vx1 - (vx1 - vx0) * r / 100 AS nx1, vy1 - (vy1 - vy0) * t / 100 AS ny1
        FROM edges),
    judged AS (SELECT *, nx1 - nx0 < 1 OR ny1 - ny0 < 1 AS bad FROM cut)
"""


def _crop(spark, sf_dir):
    return G.crop(part_boxes(spark, sf_dir), 10.0, 3.0, 30.0, 69.0)


@query(
    "crop",
    f"""
    WITH {CROP_SQL}
    SELECT doc_id, page, round(nx0, 9) + 0.0 AS cx0, round(ny0, 9) + 0.0 AS cy0, round(nx1, 9) + 0.0 AS cx1,
           round(ny1, 9) + 0.0 AS cy1, round(nx0, 9) + 0.0 AS mx0, round(ny1, 9) + 0.0 AS my1
    FROM judged WHERE NOT bad
    """,
)
def _crop_pages(spark, sf_dir):
    good, _ = _crop(spark, sf_dir)
    return good.select(
        "doc_id", "page", *_flat("crop", "c", CORNERS), rounded("media.x0").alias("mx0"), rounded("media.y1").alias("my1")
    )


@query(
    "crop_errors",
    f"""
    WITH {CROP_SQL.replace("69", "96.5")}
    SELECT doc_id, page, 'CROP_TOO_MUCH' AS error FROM judged WHERE bad
    """,
)
def _crop_errors(spark, sf_dir):
    return G.crop(part_boxes(spark, sf_dir), 10.0, 3.0, 30.0, 96.5)[1]


@query(
    "map_bbox",
    f"""
    WITH {PART_BOXES},
    a AS (
        SELECT l_partkey + 1 AS page, l_orderkey AS id, l_linenumber AS line, l_quantity AS x, l_tax * 1000 AS y,
               l_discount * 500 - 10 AS w, l_extendedprice / 1000 AS h
        FROM lineitem),
    j AS (
        SELECT p.doc_id, a.*, rotate, x - vx0 AS rx, y - vy0 AS ry, vx1 - vx0 AS bw, vy1 - vy0 AS bh
        FROM a JOIN visible p USING (page)),
    m AS (
        SELECT *, CASE rotate WHEN 90 THEN least(ry, ry + h) WHEN 180 THEN bw - greatest(rx, rx + w)
                   WHEN 270 THEN bh - greatest(ry, ry + h) ELSE least(rx, rx + w) END AS mx,
               CASE rotate WHEN 90 THEN bw - greatest(rx, rx + w) WHEN 180 THEN bh - greatest(ry, ry + h)
                   WHEN 270 THEN least(rx, rx + w) ELSE least(ry, ry + h) END AS my
        FROM j)
    SELECT doc_id, page, id, line, round(mx, 6) + 0.0 AS mx, round(my, 6) + 0.0 AS my,
           round(greatest(CASE WHEN rotate % 180 = 90 THEN abs(h) ELSE abs(w) END, 0.5), 6) + 0.0 AS mw,
           round(greatest(CASE WHEN rotate % 180 = 90 THEN abs(w) ELSE abs(h) END, 0.5), 6) + 0.0 AS mh
    FROM m
    """,
)
def _map_bbox(spark, sf_dir):
    pages = part_boxes(spark, sf_dir).select("doc_id", "page", geo.visible_box("media", "crop").alias("box"), "rotate")
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") + 1).alias("page"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        geo.rect(F.col("l_quantity"), F.col("l_tax") * 1000, F.col("l_discount") * 500 - 10, F.col("l_extendedprice") / 1000).alias("rect"),
    )
    # annotations know the document of their page
    owned = items.join(pages.select("doc_id", "page"), "page")
    mapped = G.map_bbox(owned, pages)
    return mapped.select(
        "doc_id", "page", "id", "line",
        *[rounded(f"mapped.{c}", 6).alias(f"m{c}") for c in ("x", "y", "w", "h")],
    )


@query(
    "map_viewport",
    f"""
    WITH {PART_BOXES},
    s AS (
        SELECT doc_id, page, rotate, vx1 - vx0 AS bw, vy1 - vy0 AS bh, page % 100 AS rx, (page % 37)::DOUBLE AS ry FROM visible),
    d AS (
        SELECT *, CASE WHEN rotate % 180 = 90 THEN bh ELSE bw END AS dw, CASE WHEN rotate % 180 = 90 THEN bw ELSE bh END AS dh,
               CASE rotate WHEN 90 THEN ry WHEN 180 THEN bw - rx WHEN 270 THEN bh - ry ELSE rx END AS dx,
               CASE rotate WHEN 90 THEN bw - rx WHEN 180 THEN bh - ry WHEN 270 THEN rx ELSE ry END AS dy
        FROM s)
    SELECT doc_id, page, round(dx / dw * 800, 9) + 0.0 AS px, round((dh - dy) / dh * 600, 9) + 0.0 AS py,
           rx::DOUBLE AS back_x, ry::DOUBLE AS back_y
    FROM d
    """,
)
def _map_viewport(spark, sf_dir):
    """Every point goes to pixels and back to where it was."""
    pages = part_boxes(spark, sf_dir).select("doc_id", "page", "rotate", geo.visible_box("media", "crop").alias("b"))
    x = F.col("b.x0") + F.pmod(F.col("page"), F.lit(100))
    y = F.col("b.y0") + F.pmod(F.col("page"), F.lit(37))
    css = (F.lit(800.0), F.lit(600.0))
    seen = pages.withColumn("p", geo.page_to_viewport(x, y, F.col("b"), F.col("rotate"), *css))
    back = geo.viewport_to_page(F.col("p.x"), F.col("p.y"), F.col("b"), F.col("rotate"), *css)
    return seen.withColumn("q", back).select(
        "doc_id", "page", rounded("p.x").alias("px"), rounded("p.y").alias("py"),
        rounded(F.col("q.x") - F.col("b.x0"), 6).alias("back_x"), rounded(F.col("q.y") - F.col("b.y0"), 6).alias("back_y"),
    )


@query(
    "bounds",
    """
    SELECT user_id, min(value) AS x, min(event_id)::DOUBLE AS y, round(greatest(max(value) - min(value), 1), 9) + 0.0 AS w,
           greatest(max(event_id) - min(event_id), 1)::DOUBLE AS h
    FROM events GROUP BY 1
    """,
)
def _bounds(spark, sf_dir):
    box = G.bounds(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id")
    return box.select("user_id", "rect.x", "rect.y", rounded("rect.w").alias("w"), "rect.h")


PAPER_CASE = " ".join(
    f"WHEN abs(least(w, h) - {a}) <= 6 AND abs(greatest(w, h) - {b}) <= 6 THEN '{n}'" for n, (a, b) in geo.ISO_A.items()
)


@query(
    "paper_class",
    f"""
    WITH mm AS (
        SELECT p_partkey, p_retailprice / 2.834645669::DOUBLE AS w, p_size * 24 / 2.834645669::DOUBLE AS h FROM part
        UNION ALL SELECT -1 - p_partkey, p_size * 24 / 2.834645669::DOUBLE, (p_size * 24 / 2.834645669::DOUBLE) * sqrt(2.0::DOUBLE) FROM part)
    SELECT p_partkey, CASE WHEN name IS NULL THEN label ELSE concat(name, ' (', label, ')') END AS paper
    FROM (SELECT p_partkey, CASE {PAPER_CASE} END AS name,
                 concat(floor(w + 0.5)::BIGINT, ' × ', floor(h + 0.5)::BIGINT, ' mm') AS label FROM mm)
    """,
)
def _paper_class(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    side = F.col("p_size") * 24.0
    plain = part.select("p_partkey", F.col("p_retailprice").alias("w"), side.alias("h"))
    iso = part.select((F.lit(-1) - F.col("p_partkey")).alias("p_partkey"), side.alias("w"), (side * F.sqrt(F.lit(2.0))).alias("h"))
    return plain.unionByName(iso).select("p_partkey", geo.paper_class("w", "h").alias("paper"))


@query(
    "fit_box",
    """
    SELECT p_partkey, round(10 + (300 - iw * s) / 2, 9) + 0.0 AS x, round(20 + (200 - ih * s) / 2, 9) + 0.0 AS y,
           round(iw * s, 9) + 0.0 AS w, round(ih * s, 9) + 0.0 AS h, round(p_retailprice * 72 / 150, 9) + 0.0 AS scan_pt
    FROM (SELECT *, least(300 / iw, 200 / ih) AS s
          FROM (SELECT p_partkey, p_retailprice, p_retailprice AS iw, greatest(p_size - 3, 1)::DOUBLE AS ih FROM part))
    """,
)
def _fit_box(spark, sf_dir):
    area = geo.rect(F.lit(10.0), F.lit(20.0), F.lit(300.0), F.lit(200.0))
    fitted = table(spark, sf_dir, "part").select(
        "p_partkey",
        geo.fit_box(area, F.col("p_retailprice"), (F.col("p_size") - 3).cast("double")).alias("r"),
        rounded(geo.scan_size("p_retailprice", F.lit(150.0))).alias("scan_pt"),
    )
    return fitted.select("p_partkey", *_flat("r", "", ("x", "y", "w", "h")), "scan_pt")


LABEL_SQL = f"""
    {PART_BOXES},
    p AS (
        SELECT doc_id, page, concat('NO-', page) AS label,
               CASE WHEN rotate % 180 = 90 THEN vy1 - vy0 ELSE vx1 - vx0 END AS w,
               CASE WHEN rotate % 180 = 90 THEN vx1 - vx0 ELSE vy1 - vy0 END AS h
        FROM visible)
"""


def _label_pages(spark, sf_dir):
    pages = part_boxes(spark, sf_dir).withColumn("v", geo.visible_box("media", "crop"))
    return pages.select("doc_id", "page", geo.displayed_size("v", "rotate").alias("s")).select("doc_id", "page", "s.w", "s.h")


def _labels(spark, sf_dir):
    return part_boxes(spark, sf_dir).select(
        "doc_id", "page", F.concat(F.lit("NO-"), F.col("page").cast("string")).alias("label")
    )


def _placed(df):
    return df.select(
        "doc_id", "page", "label", rounded("place.x").alias("x"), rounded("place.y").alias("y"),
        rounded("place.size").alias("size"), F.col("place.opacity").alias("opacity"),
    )


@query(
    "place_label_number",
    f"""
    WITH {LABEL_SQL}
    SELECT doc_id, page, label, round(greatest(w - 40 - length(label) * 0.56::DOUBLE * 12, 8), 9) + 0.0 AS x,
           round(h - 40, 9) + 0.0 AS y, 12.0::DOUBLE AS size, 1.0::DOUBLE AS opacity FROM p
    """,
)
def _number(spark, sf_dir):
    return _placed(G.place_label(_labels(spark, sf_dir), _label_pages(spark, sf_dir), "number", "top-right"))


@query(
    "place_label_stamp",
    f"""
    WITH {LABEL_SQL},
    q AS (SELECT *, h * 0.2::DOUBLE AS fs FROM p)
    SELECT doc_id, page, label, round(greatest((w - length(label) * 0.52::DOUBLE * fs) / 2, w * 0.04::DOUBLE), 9) + 0.0 AS x,
           round(h - h * 0.04::DOUBLE - fs, 9) + 0.0 AS y, round(fs, 9) + 0.0 AS size, 1.0::DOUBLE AS opacity FROM q
    """,
)
def _stamp(spark, sf_dir):
    labels = _labels(spark, sf_dir).withColumn("n", F.lit(1_000_000_000))
    placed = G.place_label(labels, _label_pages(spark, sf_dir), "stamp", "top-center", size_pct=0.5)
    return _placed(placed)


@query(
    "place_label_watermark",
    f"""
    WITH {LABEL_SQL},
    q AS (SELECT *, 56 * (least(w, h) / 612) AS fs FROM p)
    SELECT doc_id, page, label, round(w / 2 - length(label) * 0.5::DOUBLE * fs / 2 * sqrt(0.5::DOUBLE), 9) + 0.0 AS x,
           round(h / 2 - length(label) * 0.5::DOUBLE * fs / 2 * sqrt(0.5::DOUBLE), 9) + 0.0 AS y,
           round(fs, 9) + 0.0 AS size, 0.05::DOUBLE AS opacity FROM q
    """,
)
def _watermark(spark, sf_dir):
    return _placed(G.place_label(_labels(spark, sf_dir), _label_pages(spark, sf_dir), "watermark", opacity=0.01))
