"""Assembly queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.operators import assemble as A
from quire.operators.labels import bates, recent_jobs, z_order
from quire.plans.blocks import row_numbers
from quire.plans.registry import query
from quire.plans.roles import (
    ORDER_PAGES,
    PART_BOXES,
    by_segment,
    customer_counts,
    order_pages,
    part_boxes,
    rounded,
    table,
)


def nation_files(spark, sf_dir):
    """Customers as files of their nation; pages are their orders, and every seventh file was not counted."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return (
        table(spark, sf_dir, "customer")
        .join(counts, "c_custkey", "left")
        .select(
            F.col("c_nationkey").alias("doc_id"),
            F.col("c_custkey").alias("ord"),
            F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("uid"),
            F.when(F.pmod("c_custkey", F.lit(7)) != 0, F.col("n").cast("int")).alias("page_count"),
        )
    )


COMBINED = """
    counted AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 GROUP BY 1),
    unit AS (
        SELECT c_nationkey AS doc_id, c_custkey, concat('f', c_custkey) AS uid, unnest(range(1, n + 1)) AS page
        FROM customer JOIN counted ON o_custkey = c_custkey),
    combined AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c_custkey, page) AS pos, uid, page,
               concat(uid, '#', page) AS key
        FROM unit)
"""


@query("combine", f"WITH {COMBINED} SELECT doc_id, pos, uid, page, key FROM combined")
def _combine(spark, sf_dir):
    return A.combine(nation_files(spark, sf_dir))


@query(
    "bates",
    f"""
    WITH {COMBINED}
    SELECT doc_id, pos, key, concat('DOC-', CASE WHEN n < 0 THEN '-' ELSE '' END,
           lpad(abs(n)::VARCHAR, greatest(CASE WHEN n < 0 THEN 5 ELSE 6 END, length(abs(n)::VARCHAR))::INTEGER, '0'),
           ' – 02.07.2026') AS label
    FROM (SELECT *, pos - 21 AS n FROM combined)
    """,
)
def _bates(spark, sf_dir):
    pages = A.combine(nation_files(spark, sf_dir))
    day = F.to_date(F.lit("2026-07-02"))
    return bates(pages, start=-20, prefix="DOC-", pad=6, date=day).select("doc_id", "pos", "key", "label")


@query(
    "move_file",
    """
    WITH f AS (
        SELECT c_nationkey AS doc_id, c_custkey, c_mktsegment = 'BUILDING' AS active,
               row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord,
               count(*) OVER (PARTITION BY c_nationkey) AS n
        FROM customer),
    m AS (
        SELECT n_nationkey AS doc_id, n_nationkey::BIGINT AS src, (n_nationkey * 5 - 10)::BIGINT AS dst FROM nation)
    SELECT f.doc_id, f.c_custkey, f.active,
           CASE WHEN m.doc_id IS NULL OR src = dst OR src < 0 OR dst < 0 OR src >= n OR dst >= n THEN ord
                WHEN ord = src THEN dst
                WHEN src < dst AND ord > src AND ord <= dst THEN ord - 1
                WHEN src > dst AND ord >= dst AND ord < src THEN ord + 1 ELSE ord END AS ord
    FROM f LEFT JOIN m USING (doc_id)
    """,
)
def _move_file(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("doc_id"), "c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("active")
    )
    files = row_numbers(files, ["doc_id"], "c_custkey", "ord").withColumn("ord", F.col("ord") - 1)
    key = F.col("n_nationkey")
    moves = table(spark, sf_dir, "nation").select(
        key.alias("doc_id"), key.cast("bigint").alias("src"), (key * 5 - 10).cast("bigint").alias("dst")
    )
    return A.move_file(files, moves)


@query(
    "remove_files",
    """
    WITH f AS (
        SELECT c_nationkey AS doc_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord FROM customer),
    was AS (SELECT doc_id, ord AS was FROM f WHERE ord = doc_id * 3),
    stays AS (SELECT * FROM f WHERE c_custkey % 3 <> doc_id % 3 AND ord < 60 - doc_id),
    now AS (SELECT doc_id, coalesce(min(ord) FILTER (ord >= was), max(ord)) AS now FROM stays JOIN was USING (doc_id) GROUP BY 1)
    SELECT doc_id, c_custkey, coalesce(ord = now, false) AS active, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord
    FROM stays LEFT JOIN now USING (doc_id)
    """,
)
def _remove_files(spark, sf_dir):
    """A third of the customers of each nation goes, and all from some place on."""
    files = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), "c_custkey")
    files = row_numbers(files, ["doc_id"], "c_custkey", "ord").withColumn("ord", F.col("ord") - 1)
    files = files.withColumn("active", F.col("ord") == F.col("doc_id") * 3)
    gone = files.filter((F.col("c_custkey") % 3 == F.col("doc_id") % 3) | (F.col("ord") >= 60 - F.col("doc_id")))
    return A.remove_files(files, gone)


@query(
    "merge_docs",
    f"""
    WITH {ORDER_PAGES},
    m AS (
        SELECT c_nationkey AS target, c_custkey AS ord, c_custkey AS source FROM customer
        UNION ALL SELECT c_nationkey + 100, -c_custkey, c_custkey FROM customer)
    SELECT target, row_number() OVER (PARTITION BY target ORDER BY ord, page) AS pos, source, page, o_orderkey
    FROM m JOIN order_pages ON doc_id = source
    """,
)
def _merge_docs(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    forward = customer.select(
        F.col("c_nationkey").alias("target"), F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("source")
    )
    backward = customer.select(
        (F.col("c_nationkey") + 100).alias("target"), (-F.col("c_custkey")).alias("ord"), F.col("c_custkey").alias("source")
    )
    pages = order_pages(spark, sf_dir).select("doc_id", "page", "o_orderkey")
    merged, _ = A.merge_docs(pages, forward.unionByName(backward))
    return merged.select("target", "pos", "source", "page", "o_orderkey")


def _picks(spark, sf_dir):
    """Every order picks one page of the customer before it."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"),
        F.col("o_orderkey").alias("pos"),
        (F.col("o_custkey") + 1).alias("path"),
        (F.pmod(F.col("o_orderkey"), F.lit(12)) + 1).alias("page"),
    )


def _path_pages(spark, sf_dir):
    return order_pages(spark, sf_dir).select(F.col("doc_id").alias("path"), "page", "o_orderkey", "o_orderstatus")


PICKS = f"""
    {ORDER_PAGES},
    picks AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, o_custkey + 1 AS path, o_orderkey % 12 + 1 AS page FROM orders)
"""


@query(
    "assemble",
    f"""
    WITH {PICKS}
    SELECT k.doc_id, k.pos, k.path, k.page, p.o_orderkey, p.o_orderstatus
    FROM picks k JOIN order_pages p ON p.doc_id = k.path AND p.page = k.page
    """,
)
def _assemble(spark, sf_dir):
    return A.assemble(_path_pages(spark, sf_dir), _picks(spark, sf_dir))[0]


@query(
    "assemble_errors",
    f"""
    WITH {PICKS}
    SELECT k.doc_id, k.pos, k.path, k.page, 'PAGE_NOT_FOUND' AS error
    FROM picks k LEFT JOIN order_pages p ON p.doc_id = k.path AND p.page = k.page WHERE p.doc_id IS NULL
    """,
)
def _assemble_errors(spark, sf_dir):
    return A.assemble(_path_pages(spark, sf_dir), _picks(spark, sf_dir))[1]


@query(
    "group_runs",
    """
    WITH flagged AS (
        SELECT user_id AS doc_id, event_id, event_type AS path,
               CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)
                    THEN 1 ELSE 0 END AS f
        FROM events),
    numbered AS (
        SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no
        FROM flagged)
    SELECT doc_id, group_no, path, row_number() OVER (PARTITION BY doc_id, group_no ORDER BY event_id) AS item, event_id AS page
    FROM numbered
    """,
)
def _group_runs(spark, sf_dir):
    picks = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("path"),
        F.col("event_id").alias("page"),
    )
    return A.group_runs(picks)


ROTATIONS = {
    "AUTOMOBILE": [(90, "all"), (180, "1-3"), (90, "2")],
    "BUILDING": [(270, "")],
    "FURNITURE": [(45, "all"), (90, "x")],
    "HOUSEHOLD": [(90, "2,4-6"), (270, "5-900000000")],
    "MACHINERY": [(180, "ALL")],
}


@query(
    "rotate",
    f"""
    WITH {ORDER_PAGES},
    g(segment, angle, lo, hi) AS (
        VALUES ('AUTOMOBILE', 90, 1, 900000000), ('AUTOMOBILE', 180, 1, 3), ('AUTOMOBILE', 90, 2, 2),
               ('BUILDING', 270, 1, 900000000), ('HOUSEHOLD', 90, 2, 2), ('HOUSEHOLD', 90, 4, 6),
               ('HOUSEHOLD', 270, 5, 900000000), ('MACHINERY', 180, 1, 900000000))
    SELECT p.doc_id, p.page AS pos,
           ((p.o_orderkey % 4 * 90 + coalesce((
                SELECT sum(angle) FROM g WHERE g.segment = c.c_mktsegment AND p.page BETWEEN g.lo AND g.hi), 0)) % 360)::INTEGER
           AS rotate
    FROM order_pages p JOIN customer c ON c.c_custkey = p.doc_id
    """,
)
def _rotate(spark, sf_dir):
    pages = order_pages(spark, sf_dir).select(
        "doc_id", F.col("page").alias("pos"), (F.pmod(F.col("o_orderkey"), F.lit(4)) * 90).cast("int").alias("rotate")
    )
    return A.rotate(pages, by_segment(spark, sf_dir, ROTATIONS, ["angle", "spec"]))[0]


@query(
    "rotate_errors",
    """
    SELECT c_custkey AS doc_id, angle::BIGINT AS angle, spec, error FROM customer,
        (VALUES (45, 'all', 'INVALID_ANGLE'), (90, 'x', 'INVALID_PAGES')) AS e(angle, spec, error)
    WHERE c_mktsegment = 'FURNITURE'
    """,
)
def _rotate_errors(spark, sf_dir):
    pages = order_pages(spark, sf_dir).select("doc_id", F.col("page").alias("pos"), F.lit(0).alias("rotate"))
    return A.rotate(pages, by_segment(spark, sf_dir, ROTATIONS, ["angle", "spec"]))[1]


@query(
    "split_every",
    f"""
    WITH {ORDER_PAGES}
    SELECT doc_id, page AS pos, (page - 1) // 4 + 1 AS part,
           concat('cust', doc_id, '-part', lpad(((page - 1) // 4 + 1)::VARCHAR, 3, '0'), '.pdf') AS output
    FROM order_pages
    """,
)
def _split_every(spark, sf_dir):
    pages = order_pages(spark, sf_dir).select("doc_id", F.col("page").alias("pos"))
    return A.split_every(pages, 4, F.concat(F.lit("cust"), F.col("doc_id").cast("string")))


SPLITS = {
    "AUTOMOBILE": [(1, 1, 3), (2, 2, 5)],
    "BUILDING": [(1, 5, 2), (2, 0, 1)],
    "FURNITURE": [(1, 9, 40)],
    "HOUSEHOLD": [(1, 1, 1), (2, 1, 1)],
    "MACHINERY": [(1, 4000000000, 4)],
}
SPLIT_SQL = f"""
    {ORDER_PAGES},
    r(segment, range_no, a, b) AS (
        VALUES ('AUTOMOBILE', 1, 1, 3), ('AUTOMOBILE', 2, 2, 5), ('BUILDING', 1, 5, 2), ('BUILDING', 2, 0, 1),
               ('FURNITURE', 1, 9, 40), ('HOUSEHOLD', 1, 1, 1), ('HOUSEHOLD', 2, 1, 1), ('MACHINERY', 1, 4000000000, 4)),
    sized AS (
        SELECT c_custkey AS doc_id, range_no::BIGINT AS range_no, greatest(least(a, b), 1) AS lo,
               least(greatest(a, b), coalesce(n, 0)) AS hi, coalesce(n, 0) AS n
        FROM customer JOIN r ON segment = c_mktsegment
        LEFT JOIN (SELECT doc_id, max(page) AS n FROM order_pages GROUP BY 1) s ON s.doc_id = c_custkey)
"""


@query(
    "split_ranges",
    f"""
    WITH {SPLIT_SQL}
    SELECT p.doc_id, p.page AS pos, range_no, concat('cust', p.doc_id, '_p', lo, '-', hi, '.pdf') AS output
    FROM order_pages p JOIN sized s ON p.doc_id = s.doc_id AND p.page BETWEEN lo AND hi
    """,
)
def _split_ranges(spark, sf_dir):
    pages = order_pages(spark, sf_dir).select("doc_id", F.col("page").alias("pos"))
    ranges = by_segment(spark, sf_dir, SPLITS, ["range_no", "start", "end"])
    return A.split_ranges(pages, ranges, F.concat(F.lit("cust"), F.col("doc_id").cast("string")))[0]


@query(
    "split_ranges_errors",
    f"WITH {SPLIT_SQL} SELECT doc_id, range_no, 'INVALID_RANGE' AS error FROM sized WHERE lo > n",
)
def _split_ranges_errors(spark, sf_dir):
    pages = order_pages(spark, sf_dir).select("doc_id", F.col("page").alias("pos"))
    ranges = by_segment(spark, sf_dir, SPLITS, ["range_no", "start", "end"])
    return A.split_ranges(pages, ranges, F.lit("x"))[1]


def _remap(spark, sf_dir):
    """Unshipped orders leave the page list, the rest turn around."""
    pages = order_pages(spark, sf_dir)
    old = pages.select("doc_id", (F.col("page") - 1).alias("page_index"), F.col("o_orderkey").alias("key"))
    left = pages.filter(F.col("o_orderstatus") != "P").select("doc_id", F.col("o_orderkey").alias("key"), (-F.col("o_orderkey")).alias("__o"))
    new = row_numbers(left, ["doc_id"], "__o", "page_index").select(
        "doc_id", (F.col("page_index") - 1).alias("page_index"), "key"
    )
    annots = pages.select(
        "doc_id", F.col("o_orderkey").alias("id"), F.pmod(F.col("o_orderkey"), F.lit(14)).alias("page_index")
    )
    return A.remap(annots, old, new)


REMAP_SQL = f"""
    {ORDER_PAGES},
    fresh AS (
        SELECT doc_id, o_orderkey, row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey DESC) - 1 AS next
        FROM order_pages WHERE o_orderstatus <> 'P'),
    placed AS (
        SELECT a.doc_id, a.o_orderkey AS id, a.o_orderkey % 14 AS page_index, f.next
        FROM order_pages a LEFT JOIN order_pages o ON o.doc_id = a.doc_id AND o.page - 1 = a.o_orderkey % 14
        LEFT JOIN fresh f ON f.doc_id = o.doc_id AND f.o_orderkey = o.o_orderkey)
"""


@query(
    "remap",
    f"""
    WITH {REMAP_SQL}
    SELECT doc_id, id, coalesce(next, page_index) AS page_index, next IS NOT NULL AS kept FROM placed
    """,
)
def _remap_rows(spark, sf_dir):
    kept, dropped, _ = _remap(spark, sf_dir)
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


@query(
    "remap_history",
    f"WITH {REMAP_SQL} SELECT doc_id, bool_or(next IS NULL) AS history_dropped FROM placed GROUP BY 1",
)
def _remap_history(spark, sf_dir):
    return _remap(spark, sf_dir)[2]


def _sheets(spark, sf_dir, mode):
    price = F.col("o_totalprice")
    boxes = order_pages(spark, sf_dir).select(
        "doc_id",
        "page",
        geo.box(F.lit(10.0), F.lit(20.0), price / 1000.0 + 10.0, F.lit(400.0)).alias("box"),
        (F.pmod(F.col("o_orderkey"), F.lit(4)) * 90).cast("int").alias("rotate"),
    )
    plan, _ = A.sheet_plan(customer_counts(spark, sf_dir), boxes, mode, 842.0, 595.0)
    return plan.select(
        "doc_id", "sheet", "slot", "page",
        *[rounded(F.get("matrix", F.lit(i))).alias(name) for i, name in enumerate("abcdef")],
    )


def _sheet_sql(mode: str) -> str:
    per = {"2up": 2, "4up": 4, "booklet": 2}[mode]
    sheets = "((n + 3) // 4) * 2" if mode == "booklet" else f"(n + {per - 1}) // {per}"
    if mode == "booklet":
        page = """CASE WHEN ((sheet - 1) % 2 = 0) = (slot = 0) THEN ((n + 3) // 4) * 4 - (sheet - 1) ELSE sheet END"""
    else:
        page = f"(sheet - 1) * {per} + slot + 1"
    if mode == "4up":
        slot = "(slot % 2) * 421.0 AS sx, CASE WHEN slot < 2 THEN 297.5 ELSE 0.0 END AS sy, 421.0 AS sw, 297.5 AS sh"
    else:
        slot = "slot * 421.0 AS sx, 0.0 AS sy, 421.0 AS sw, 595.0 AS sh"
    return f"""
    WITH {ORDER_PAGES},
    docs AS (SELECT doc_id, count(*) AS n FROM order_pages GROUP BY 1),
    s AS (SELECT doc_id, n, unnest(range(1, {sheets} + 1)) AS sheet FROM docs),
    t AS (SELECT doc_id, n, sheet, unnest(range(0, {per}))::INTEGER AS slot FROM s),
    u AS (SELECT doc_id, n, sheet, slot, {page} AS p, {slot} FROM t),
    v AS (SELECT doc_id, sheet, slot, CASE WHEN p <= n THEN p ELSE 0 END AS page,
                 sx::DOUBLE AS sx, sy::DOUBLE AS sy, sw::DOUBLE AS sw, sh::DOUBLE AS sh FROM u),
    w AS (
        SELECT v.*, 10.0::DOUBLE AS x0, 20.0::DOUBLE AS y0, o.o_totalprice / 1000.0::DOUBLE + 10.0::DOUBLE AS x1,
               400.0::DOUBLE AS y1, (o.o_orderkey % 4) * 90 AS r
        FROM v LEFT JOIN order_pages o USING (doc_id, page)),
    x AS (
        SELECT *, CASE WHEN r % 180 = 90 THEN y1 - y0 ELSE x1 - x0 END AS dw,
               CASE WHEN r % 180 = 90 THEN x1 - x0 ELSE y1 - y0 END AS dh FROM w),
    y AS (
        SELECT *, CASE WHEN x1 - x0 > 1 AND y1 - y0 > 1 THEN least((sw - 24) / dw, (sh - 24) / dh) END AS k FROM x)
    SELECT doc_id, sheet, slot, page,
           round(k * CASE r WHEN 0 THEN 1 WHEN 180 THEN -1 ELSE 0 END, 9) + 0.0 AS a,
           round(k * CASE r WHEN 90 THEN -1 WHEN 270 THEN 1 ELSE 0 END, 9) + 0.0 AS b,
           round(k * CASE r WHEN 90 THEN 1 WHEN 270 THEN -1 ELSE 0 END, 9) + 0.0 AS c,
           round(k * CASE r WHEN 0 THEN 1 WHEN 180 THEN -1 ELSE 0 END, 9) + 0.0 AS d,
           round(k * CASE r WHEN 90 THEN -y0 WHEN 180 THEN x1 WHEN 270 THEN y1 ELSE -x0 END + sx + (sw - k * dw) / 2, 9) + 0.0 AS e,
           round(k * CASE r WHEN 90 THEN x1 WHEN 180 THEN y1 WHEN 270 THEN -x0 ELSE -y0 END + sy + (sh - k * dh) / 2, 9) + 0.0 AS f
    FROM y
    """


@query("sheet_plan_booklet", _sheet_sql("booklet"))
def _booklet(spark, sf_dir):
    return _sheets(spark, sf_dir, "booklet")


@query("sheet_plan_2up", _sheet_sql("2up"))
def _two_up(spark, sf_dir):
    return _sheets(spark, sf_dir, "2up")


@query("sheet_plan_4up", _sheet_sql("4up"))
def _four_up(spark, sf_dir):
    return _sheets(spark, sf_dir, "4up")


TILES_SQL = f"""
    WITH {PART_BOXES},
    k AS (SELECT 2.834645669::DOUBLE AS u),
    sized AS (
        SELECT doc_id, page, rotate, mx0::DOUBLE AS x0, my0::DOUBLE AS y0, mx1::DOUBLE AS x1, my1::DOUBLE AS y1,
               CASE WHEN rotate % 180 = 90 THEN my1 ELSE mx1 END AS vw,
               CASE WHEN rotate % 180 = 90 THEN mx1 ELSE my1 END AS vh,
               148.0::DOUBLE * 0 + 210.0::DOUBLE * u AS s, 297.0::DOUBLE * u AS l
        FROM part_boxes, k),
    picked AS (
        SELECT *, (CASE WHEN vw <= l + 0.5 THEN 1 ELSE ceil((vw - l) / (l - 30)) + 1 END)
                  * (CASE WHEN vh <= s + 0.5 THEN 1 ELSE ceil((vh - s) / (s - 30)) + 1 END)
                < (CASE WHEN vw <= s + 0.5 THEN 1 ELSE ceil((vw - s) / (s - 30)) + 1 END)
                  * (CASE WHEN vh <= l + 0.5 THEN 1 ELSE ceil((vh - l) / (l - 30)) + 1 END) AS wide
        FROM sized),
    tile AS (
        SELECT *, CASE WHEN wide = (rotate % 180 = 90) THEN s ELSE l END AS tw,
               CASE WHEN wide = (rotate % 180 = 90) THEN l ELSE s END AS th FROM picked),
    grid AS (
        SELECT *, CASE WHEN x1 - x0 <= tw + 0.5 THEN 1 ELSE ceil((x1 - x0 - tw) / (tw - 30))::BIGINT + 1 END AS cols,
               CASE WHEN y1 - y0 <= th + 0.5 THEN 1 ELSE ceil((y1 - y0 - th) / (th - 30))::BIGINT + 1 END AS rows
        FROM tile),
    r AS (SELECT *, unnest(range(0, rows)) AS "row" FROM grid),
    c AS (SELECT *, unnest(range(0, cols)) AS col FROM r),
    cut AS (
        SELECT doc_id, page, "row", col, x0 + col * (tw - 30) AS bx0,
               greatest(y1 - "row" * (th - 30) - th, y0) AS by0, least(x0 + col * (tw - 30) + tw, x1) AS bx1,
               y1 - "row" * (th - 30) AS by1 FROM c)
    SELECT doc_id, page, "row", col, round(bx0, 9) + 0.0 AS x0, round(by0, 9) + 0.0 AS y0,
           round(bx1, 9) + 0.0 AS x1, round(by1, 9) + 0.0 AS y1
    FROM cut WHERE bx1 - bx0 >= 2 AND by1 - by0 >= 2
"""


@query("tile_plan", TILES_SQL)
def _tile_plan(spark, sf_dir):
    boxes = part_boxes(spark, sf_dir).select(
        "doc_id", "page", geo.normalize_box("media").alias("box"), "rotate"
    )
    tiles, _ = A.tile_plan(boxes, "a4", "auto", 30.0)
    return tiles.select(
        "doc_id", "page", "row", "col", *[rounded(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    )


@query(
    "z_order",
    f"""
    WITH {ORDER_PAGES},
    a AS (
        SELECT doc_id, page % 3 AS page_index, o_orderkey AS id,
               row_number() OVER (PARTITION BY doc_id, page % 3 ORDER BY o_orderkey) AS pos,
               count(*) OVER (PARTITION BY doc_id, page % 3) AS n
        FROM order_pages),
    w AS (
        SELECT doc_id, page_index, pos AS src,
               CASE c_mktsegment WHEN 'AUTOMOBILE' THEN n WHEN 'BUILDING' THEN 1
                   WHEN 'FURNITURE' THEN pos + 1 ELSE pos - 1 END AS dst, n
        FROM a JOIN customer ON c_custkey = doc_id
        JOIN (SELECT doc_id, min(page) AS page FROM order_pages WHERE o_orderstatus = 'O' GROUP BY 1) m USING (doc_id)
        JOIN order_pages o USING (doc_id, page) WHERE o.o_orderkey = a.id),
    v AS (SELECT * FROM w WHERE dst BETWEEN 1 AND n AND dst <> src)
    SELECT a.doc_id, a.page_index, a.id,
           CASE WHEN src IS NULL THEN pos WHEN pos = src THEN dst
                WHEN pos > src AND pos <= dst THEN pos - 1 WHEN pos < src AND pos >= dst THEN pos + 1
                ELSE pos END AS ord
    FROM a LEFT JOIN v USING (doc_id, page_index)
    """,
)
def _z_order(spark, sf_dir):
    pages = order_pages(spark, sf_dir)
    annots = pages.select(
        "doc_id", F.pmod(F.col("page"), F.lit(3)).alias("page_index"), F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("ord"),
    )
    # the first open order of each customer moves
    first = pages.filter(F.col("o_orderstatus") == "O").groupBy("doc_id").agg(F.min_by("o_orderkey", "page").alias("id"))
    dirs = {"AUTOMOBILE": [("front",)], "BUILDING": [("back",)], "FURNITURE": [("forward",)],
            "HOUSEHOLD": [("backward",)], "MACHINERY": [("backward",)]}
    moves = first.join(by_segment(spark, sf_dir, dirs, ["dir"]), "doc_id")
    return z_order(annots, moves)


@query(
    "recent_jobs",
    """
    WITH latest AS (
        SELECT user_id, event_type, value, ts, event_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
    SELECT user_id AS id, event_type AS status, ts AS finished_at, event_id AS seq FROM latest WHERE r = 1
    ORDER BY ts DESC, event_id DESC, user_id LIMIT 25
    """,
)
def _recent_jobs(spark, sf_dir):
    jobs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("finished_at"),
        F.col("event_id").alias("seq"),
    )
    return recent_jobs(jobs, seq="seq")
