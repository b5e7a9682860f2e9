"""Quality, diff and choice queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import quality as Q
from quire.plans.blocks import row_numbers
from quire.plans.registry import query
from quire.plans.roles import ORDER_PAGES, order_pages, rounded, table

GRAY = "least(255, greatest(0, cast(floor(128 + 400 * cast(x as double) + 0.5) as int)))"


def _gray(spark, sf_dir):
    """Embeddings as 8x8 gray pages: (vec_id, pixels)."""
    vec = table(spark, sf_dir, "embeddings")
    pixels = F.expr(f"transform(embedding, x -> {GRAY})")
    return vec.select("vec_id", "label", pixels.alias("pixels"))


def _tiles(spark, sf_dir):
    """Four tiles a page; documents are the labels, every tenth page is washed out."""
    gray = _gray(spark, sf_dir)
    light = F.transform("pixels", lambda p: F.lit(250) - F.pmod(p, F.lit(3)))
    shown = gray.withColumn("pixels", F.when(F.col("label") == 0, light).otherwise(F.col("pixels")))
    return shown.select(
        F.col("label").alias("doc_id"), F.col("vec_id").alias("page"), "pixels",
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tile"),
    ).select("doc_id", "page", "tile", F.slice("pixels", F.col("tile") * 16 + 1, F.lit(16)).alias("pixels"))


GRAY_SQL = f"""
    gray AS (
        SELECT vec_id, label, i, least(255, greatest(0, floor(128 + 400 * embedding[i]::DOUBLE + 0.5)::INTEGER)) AS v
        FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
    px AS (SELECT label AS doc_id, vec_id AS page, CASE WHEN label = 0 THEN 250 - v % 3 ELSE v END AS p FROM gray),
    stats AS (
        SELECT doc_id, page, count(*) FILTER (p < 240) / count(*) AS dark, sum(p) / count(*)::DOUBLE AS mean,
               sqrt((count(*)::HUGEINT * sum(p * p) - sum(p) * sum(p))::DOUBLE) / count(*) AS std
        FROM px GROUP BY 1, 2)
"""


@query(
    "luma_stats",
    f"WITH {GRAY_SQL} SELECT doc_id, page, round(dark, 9) AS dark, round(mean, 9) AS mean, round(std, 9) AS std FROM stats",
)
def _luma_stats(spark, sf_dir):
    stats = Q.luma_stats(_tiles(spark, sf_dir))
    return stats.select("doc_id", "page", rounded("dark").alias("dark"), rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(
    "luma_stats_binary",
    f"WITH {GRAY_SQL} SELECT doc_id, page, round(dark, 9) AS dark, round(mean, 9) AS mean, round(std, 9) AS std FROM stats",
)
def _luma_stats_binary(spark, sf_dir):
    tiles = _tiles(spark, sf_dir)
    hexed = F.array_join(F.transform("pixels", lambda p: F.lpad(F.hex(p), 2, "0")), "")
    stats = Q.luma_stats(tiles.withColumn("pixels", F.unhex(hexed)))
    return stats.select("doc_id", "page", rounded("dark").alias("dark"), rounded("mean").alias("mean"), rounded("std").alias("std"))


@query(
    "blank_pages",
    f"""
    WITH {GRAY_SQL}
    SELECT doc_id, page, s AS sensitivity,
           dark < CASE s WHEN 'strict' THEN 0.0005 WHEN 'aggressive' THEN 0.01 ELSE 0.003 END OR (std < 4 AND mean > 160) AS blank
    FROM stats, (VALUES ('strict'), ('normal'), ('aggressive')) AS k(s)
    """,
)
def _blank_pages(spark, sf_dir):
    stats = Q.luma_stats(_tiles(spark, sf_dir))
    levels = [Q.is_blank_page(s) for s in ("strict", "normal", "aggressive")]
    tested = stats.select("doc_id", "page", F.array(*[
        F.struct(F.lit(s).alias("sensitivity"), test.alias("blank"))
        for s, test in zip(("strict", "normal", "aggressive"), levels)
    ]).alias("r"))
    return tested.select("doc_id", "page", F.explode("r").alias("r")).select("doc_id", "page", "r.*")


DROP_SQL = f"""
    {ORDER_PAGES},
    p AS (SELECT doc_id, o_orderstatus AS uid, page, o_orderpriority, o_totalprice FROM order_pages),
    kept AS (
        SELECT doc_id, uid, page FROM p
        WHERE NOT (o_totalprice < 300000 AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')))
"""


def _drop_blank(spark, sf_dir):
    """Cheap orders are blank pages, urgent and low ones were spared."""
    pages = order_pages(spark, sf_dir).withColumnRenamed("o_orderstatus", "uid")
    blanks = pages.filter(F.col("o_totalprice") < 300000)
    spared = pages.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return Q.drop_blank(pages.select("doc_id", "uid", "page"), blanks, spared)


@query("drop_blank", f"WITH {DROP_SQL} SELECT doc_id, uid, page FROM kept")
def _drop_blank_pages(spark, sf_dir):
    return _drop_blank(spark, sf_dir)[0]


@query(
    "drop_blank_errors",
    f"""
    WITH {DROP_SQL}
    SELECT DISTINCT doc_id, 'DELETE_ALL' AS error FROM p WHERE doc_id NOT IN (SELECT doc_id FROM kept)
    """,
)
def _drop_blank_errors(spark, sf_dir):
    return _drop_blank(spark, sf_dir)[1]


def _strips(spark, sf_dir, rest):
    """Pages of even or odd vectors as 16-pixel lines; odd pages are shorter and narrower."""
    gray = _gray(spark, sf_dir).filter(F.pmod(F.col("vec_id"), F.lit(2)) == rest)
    rows, width = (4, 16) if rest == 0 else (3, 14)
    lines = gray.select(
        F.floor(F.col("vec_id") / 2).cast("bigint").alias("doc_id"), F.lit(1).alias("page"),
        F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("y"), "pixels",
    )
    rgb = F.transform(
        F.slice("pixels", F.col("y") * 16 + 1, F.lit(width)), lambda p: p * 65536 + p * 256 + F.lit(100)
    )
    return lines.select("doc_id", "page", "y", F.lit(0).alias("chunk"), F.lit(width).alias("w"), F.lit(rows).alias("h"), rgb.alias("pixels"))


DIFF_SQL = f"""
    {GRAY_SQL},
    grid AS (SELECT vec_id // 2 AS doc_id, vec_id % 2 AS side, (i - 1) // 16 AS y, (i - 1) % 16 AS x, v FROM gray),
    a AS (SELECT * FROM grid WHERE side = 0),
    b AS (SELECT * FROM grid WHERE side = 1 AND y < 3 AND x < 14),
    gap AS (
        SELECT doc_id, y, x, 2 * abs(coalesce(a.v, 255) - coalesce(b.v, 255))
               + abs(CASE WHEN a.v IS NULL THEN 255 ELSE 100 END - CASE WHEN b.v IS NULL THEN 255 ELSE 100 END) AS d,
               a.v IS NOT NULL AS in_a
        FROM a FULL JOIN b USING (doc_id, y, x)),
    diff AS (
        SELECT doc_id, 1 AS page, count(*) FILTER (d > 60) AS changed,
               CASE WHEN bool_or(in_a) THEN 64 ELSE 42 END AS area
        FROM gap GROUP BY 1)
"""


@query(
    "pixel_diff",
    f"WITH {DIFF_SQL} SELECT doc_id, page, changed, round(changed / area::DOUBLE * 100, 9) AS changed_percent FROM diff",
)
def _pixel_diff(spark, sf_dir):
    diff = Q.pixel_diff(_strips(spark, sf_dir, 0), _strips(spark, sf_dir, 1))
    return diff.select("doc_id", "page", "changed", rounded("changed_percent").alias("changed_percent"))


def _versions(spark, sf_dir):
    """A conversation before and after: every third turn gains a mark, every other conversation loses what the user said."""
    turns = table(spark, sf_dir, "conversations")
    sides = []
    marked = F.when(F.pmod("turn", F.lit(3)) == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    stays = (F.pmod("conv_id", F.lit(2)) == 0) | (F.col("role") != "user")
    for rows, text in ((turns, F.col("text")), (turns.filter(stays), marked)):
        said = rows.select(F.col("conv_id").alias("doc_id"), "turn", text.alias("text"))
        sides.append(row_numbers(said, ["doc_id"], "turn", "page").select("doc_id", "page", "text"))
    return sides


VERSIONS_SQL = """
    a AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, text, true AS here FROM conversations),
    b AS (
        SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page,
               CASE WHEN turn % 3 = 0 THEN text || '!' ELSE text END AS text, true AS here
        FROM conversations WHERE conv_id % 2 = 0 OR role <> 'user')
"""


@query(
    "compare_docs",
    f"""
    WITH {VERSIONS_SQL}
    SELECT doc_id, page, CASE WHEN a.here IS NULL THEN 'b' WHEN b.here IS NULL THEN 'a' ELSE 'both' END AS side,
           CASE WHEN a.here AND b.here THEN a.text = b.text END AS same_text, NULL::FLOAT AS changed_percent
    FROM a FULL JOIN b USING (doc_id, page)
    """,
)
def _compare_docs(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    return Q.compare_docs(a, b)


@query(
    "compare_page_counts",
    f"""
    WITH {VERSIONS_SQL}
    SELECT doc_id, count(a.here) AS a_pages, count(b.here) AS b_pages, count(a.here) <> count(b.here) AS mismatch
    FROM a FULL JOIN b USING (doc_id, page) GROUP BY 1
    """,
)
def _compare_page_counts(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    return Q.page_count_report(a, b)


@query(
    "pick_quality",
    """
    WITH v AS (
        SELECT l_suppkey AS doc_id, l_orderkey AS page, (l_quantity + 30)::INTEGER AS quality, l_extendedprice::BIGINT AS bytes
        FROM (SELECT l_suppkey, l_orderkey, l_quantity, round(l_extendedprice) AS l_extendedprice FROM lineitem)),
    t AS (
        SELECT doc_id, greatest((20000 + doc_id * 300) * count(DISTINCT page) // count(DISTINCT page), 15000) AS budget
        FROM v GROUP BY 1),
    best AS (
        SELECT doc_id, page, budget, max(quality) FILTER (bytes <= budget AND quality BETWEEN 40 AND 75) AS q,
               max(bytes) FILTER (quality = 75) AS probe
        FROM v JOIN t USING (doc_id) GROUP BY 1, 2, 3)
    SELECT doc_id, page, budget, coalesce(q, 40) AS quality,
           CASE WHEN probe = 0 THEN 150
                ELSE least(greatest(floor(150 * sqrt(budget * 0.9::DOUBLE / probe) + 0.5), 150), 200) END::INTEGER AS dpi
    FROM best
    """,
)
def _pick_quality(spark, sf_dir):
    variants = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page"),
        (F.col("l_quantity") + 30).cast("int").alias("quality"), F.round("l_extendedprice").cast("bigint").alias("bytes"),
    )
    pages = variants.groupBy("doc_id").agg(F.count_distinct("page").alias("n"))
    targets = pages.select("doc_id", ((F.lit(20000) + F.col("doc_id") * 300) * F.col("n")).alias("target_bytes"))
    return Q.pick_quality(variants, targets, cap=75, max_dpi=200)


@query(
    "pick_version",
    """
    WITH c AS (
        SELECT o_orderkey, o_orderpriority AS p, o_custkey % 5 + 1 AS n, trunc(o_totalprice)::BIGINT AS a,
               trunc(o_totalprice * (0.5 + (o_custkey % 7) / 10.0))::BIGINT AS b,
               CASE WHEN o_orderstatus <> 'O' THEN trunc(o_totalprice * (o_orderkey % 10) / 10)::BIGINT END AS t
        FROM (SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, round(o_totalprice)::BIGINT AS o_totalprice FROM orders))
    SELECT o_orderkey,
           CASE WHEN t IS NULL THEN
                CASE WHEN (p = '1-URGENT' OR (p = '2-HIGH' AND n = 3)) AND a > 0 AND b >= a THEN 'original' ELSE 'rewrite' END
                WHEN a > 0 AND t >= a * 0.5 AND b <= t AND b < a THEN 'lossless' ELSE 'lossy' END AS chosen
    FROM c
    """,
)
def _pick_version(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.round("o_totalprice").cast("bigint"))
    candidates = orders.selectExpr(
        "o_orderkey",
        "CASE o_orderpriority WHEN '1-URGENT' THEN '1-z' WHEN '2-HIGH' THEN '1-2,3' ELSE '2,1' END AS spec",
        "o_custkey % 5 + 1 AS n",
        "o_totalprice AS in_bytes",
        "cast(o_totalprice * cast(5 + o_custkey % 7 as int) div 10 as bigint) AS out_bytes",
        "CASE WHEN o_orderstatus <> 'O' THEN cast(o_totalprice * (o_orderkey % 10) div 10 as bigint) END AS target_bytes",
    )
    return Q.pick_version(candidates).select("o_orderkey", "chosen")


@query(
    "size_estimate",
    """
    SELECT tool, ceil(sum(size) * CASE tool WHEN 'merge' THEN 1.5 WHEN 'optimize' THEN 2.5 ELSE 2 END)::BIGINT AS bytes,
           ceil(sum(size) * CASE tool WHEN 'merge' THEN 1.5 WHEN 'optimize' THEN 2.5 ELSE 2 END)::BIGINT <= 1000000 AS sufficient
    FROM (SELECT CASE lang WHEN 'de' THEN 'merge' WHEN 'fr' THEN 'optimize' WHEN 'es' THEN 'split' ELSE 'crop' END AS tool,
                 n_chars AS size FROM documents) GROUP BY 1
    """,
)
def _size_estimate(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr(
        "CASE lang WHEN 'de' THEN 'merge' WHEN 'fr' THEN 'optimize' WHEN 'es' THEN 'split' ELSE 'crop' END AS tool",
        "n_chars AS size",
    )
    return Q.size_estimate(files, free=F.lit(1_000_000))


@query(
    "validate_docs",
    """
    WITH d AS (SELECT DISTINCT conv_id AS doc_id, CASE WHEN conv_id % 50 = 7 THEN 2 ELSE 1 END AS version FROM conversations
               UNION ALL SELECT -1, 1),
    a AS (
        SELECT conv_id AS doc_id, turn AS ord, CASE
            WHEN role = 'user' AND length(text) > 400 THEN 'TEXT_TOO_LONG'
            WHEN role <> 'user' AND length(text) > 600 THEN 'INK_TOO_LONG' END AS broken
        FROM conversations),
    f AS (SELECT doc_id, count(*) AS n, arg_min(broken, ord) FILTER (broken IS NOT NULL) AS first FROM a GROUP BY 1)
    SELECT d.doc_id, CASE WHEN version <> 1 THEN 'BAD_EDIT' WHEN n IS NULL THEN 'NO_EDITS'
                          WHEN n > 6 THEN 'TOO_MANY_OBJECTS' ELSE first END AS reason
    FROM d LEFT JOIN f USING (doc_id)
    """,
)
def _validate_docs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    docs = turns.select(
        F.col("conv_id").alias("doc_id"), F.when(F.pmod(F.col("conv_id"), F.lit(50)) == 7, 2).otherwise(1).alias("version")
    ).distinct()
    empty = spark.range(1).select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit(1).alias("version"))
    annots = turns.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"),
        F.when(F.col("role") == "user", "text").otherwise("ink").alias("kind"),
        F.col("text").alias("content"), F.length("text").alias("n_points"),
    )
    return Q.validate_docs(docs.unionByName(empty), annots, max_objects=6, max_chars=400, max_points=600)
