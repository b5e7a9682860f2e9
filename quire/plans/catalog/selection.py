"""Page selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import ranges as R
from quire.operators.select import delete_pages, extract_pages, format_ranges, listed_pages
from quire.operators.text import has_text
from quire.plans.registry import query
from quire.plans.roles import (
    LINES,
    ORDER_PAGES,
    by_segment,
    customer_counts,
    lines,
    order_pages,
    table,
)

# page specs made of order keys; each priority uses another shape
STRICT_SPEC = """
    CASE o_orderpriority
        WHEN '1-URGENT' THEN concat(o_orderkey % 9, ', ', o_custkey % 6 + 1, ' - ', o_custkey % 11)
        WHEN '2-HIGH' THEN concat(o_custkey % 8 + 1, '-', o_orderkey % 5 + 1, ',3,', o_orderkey % 13)
        WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'F' THEN 'ALL' ELSE ' * ' END
        WHEN '4-NOT SPECIFIED' THEN concat(o_orderkey % 4, ',,', o_custkey % 7)
        ELSE CASE o_orderstatus WHEN 'F' THEN concat('1-', o_custkey % 5, '-3')
                                WHEN 'O' THEN '  ' ELSE concat(o_custkey % 5, ',x') END
    END
"""

STRICT_SQL = """
    WITH specs AS (
        SELECT o_orderkey, {spec} AS spec, (o_custkey % 15)::INTEGER AS n FROM orders),
    clean AS (SELECT *, lower(regexp_replace(spec, '\\s', '', 'g')) AS s FROM specs),
    tok AS (
        SELECT o_orderkey, n, unnest(string_split(s, ',')) AS t,
               unnest(range(1, len(string_split(s, ',')) + 1)) AS i
        FROM clean WHERE s NOT IN ('', 'all', '*')),
    num AS (
        SELECT *, contains(t, '-') AS rng,
               try_cast(nullif(split_part(t, '-', 1), '') AS BIGINT) AS lo,
               CASE WHEN contains(t, '-') THEN try_cast(nullif(split_part(t, '-', 2), '') AS BIGINT)
                    ELSE try_cast(nullif(t, '') AS BIGINT) END AS hi,
               len(string_split(t, '-')) AS k
        FROM tok),
    err AS (
        SELECT *, CASE WHEN t = '' THEN 'EMPTY_TOKEN'
                       WHEN rng AND (k <> 2 OR split_part(t, '-', 1) = '' OR split_part(t, '-', 2) = '') THEN 'BAD_RANGE'
                       WHEN lo IS NULL OR hi IS NULL OR lo < 1 OR hi < 1 THEN 'BAD_NUMBER'
                       WHEN n <> 0 AND greatest(lo, hi) > n THEN 'OUT_OF_RANGE' END AS e
        FROM num),
    first_err AS (SELECT o_orderkey, arg_min(e, i) AS e FROM err WHERE e IS NOT NULL GROUP BY o_orderkey),
    expanded AS (
        SELECT o_orderkey, i,
               unnest(CASE WHEN lo <= hi THEN range(lo, hi + 1) ELSE range(lo, hi - 1, -1) END) AS p,
               unnest(range(1, abs(hi - lo) + 2)) AS j
        FROM err WHERE o_orderkey NOT IN (SELECT o_orderkey FROM first_err)),
    listed AS ({listed}),
    whole AS (SELECT o_orderkey, n, string_agg(p::VARCHAR, ',' ORDER BY p) AS pages
              FROM (SELECT o_orderkey, n, unnest(range(1, n + 1)) AS p FROM clean WHERE s IN ('all', '*'))
              GROUP BY ALL)
    SELECT c.o_orderkey, c.spec, c.n,
           CASE WHEN c.s IN ('all', '*') THEN w.pages ELSE l.pages END AS pages,
           CASE WHEN c.s = '' THEN 'EMPTY'
                WHEN c.s IN ('all', '*') THEN CASE WHEN c.n < 1 THEN 'ALL_NEEDS_COUNT' END
                ELSE f.e END AS error
    FROM clean c LEFT JOIN first_err f USING (o_orderkey) LEFT JOIN listed l USING (o_orderkey)
    LEFT JOIN whole w USING (o_orderkey)
"""
SET_LIST = """SELECT o_orderkey, string_agg(p::VARCHAR, ',' ORDER BY p) AS pages
                  FROM (SELECT DISTINCT o_orderkey, p FROM expanded) GROUP BY 1"""
ORDER_LIST = "SELECT o_orderkey, string_agg(p::VARCHAR, ',' ORDER BY i, j) AS pages FROM expanded GROUP BY 1"


def _strict(spark, sf_dir, preserve_order):
    specs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(STRICT_SPEC).alias("spec"),
        F.expr("cast(o_custkey % 15 as int)").alias("n"),
    )
    parsed = specs.withColumn("r", R.parse_range("spec", F.col("n"), preserve_order))
    return parsed.select(
        "o_orderkey", "spec", "n", F.array_join("r.pages", ",").alias("pages"), F.col("r.error").alias("error")
    )


@query("parse_range", STRICT_SQL.format(spec=STRICT_SPEC, listed=SET_LIST))
def _parse_range(spark, sf_dir):
    return _strict(spark, sf_dir, preserve_order=False)


@query("parse_range_ordered", STRICT_SQL.format(spec=STRICT_SPEC, listed=ORDER_LIST))
def _parse_range_ordered(spark, sf_dir):
    return _strict(spark, sf_dir, preserve_order=True)


LENIENT_SPEC = """
    CASE o_orderpriority
        WHEN '1-URGENT' THEN concat(' ', o_orderkey % 9, ' ,, ', o_custkey % 6, ' - ', o_custkey % 11)
        WHEN '2-HIGH' THEN concat(o_custkey % 8 + 1, '-', o_orderkey % 5, ',3,+', o_orderkey % 13)
        WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'F' THEN 'all' ELSE ' , ' END
        WHEN '4-NOT SPECIFIED' THEN concat(o_orderkey % 4, ',', o_custkey % 7)
        ELSE concat('1-', o_custkey % 5, CASE o_orderstatus WHEN 'F' THEN '-3' WHEN 'O' THEN '' ELSE ' 2' END)
    END
"""


@query(
    "parse_range_lenient",
    f"""
    WITH specs AS (SELECT o_orderkey, {LENIENT_SPEC} AS spec FROM orders),
    tok AS (SELECT o_orderkey, trim(unnest(string_split(spec, ','))) AS t FROM specs),
    num AS (
        SELECT o_orderkey,
               CASE WHEN contains(t, '-') THEN trim(left(t, instr(t, '-') - 1)) ELSE t END AS a,
               CASE WHEN contains(t, '-') THEN trim(substr(t, instr(t, '-') + 1)) ELSE t END AS b
        FROM tok WHERE t <> ''),
    val AS (
        SELECT o_orderkey,
               CASE WHEN regexp_full_match(a, '\\+?[0-9]+') THEN a::BIGINT END AS a,
               CASE WHEN regexp_full_match(b, '\\+?[0-9]+') THEN b::BIGINT END AS b
        FROM num),
    ok AS (SELECT o_orderkey FROM val GROUP BY 1 HAVING bool_and(a IS NOT NULL AND b IS NOT NULL)),
    pages AS (
        SELECT DISTINCT o_orderkey, unnest(range(least(a, b), greatest(a, b) + 1)) AS p
        FROM val WHERE o_orderkey IN (SELECT o_orderkey FROM ok)),
    listed AS (SELECT o_orderkey, string_agg(p::VARCHAR, ',' ORDER BY p) AS pages FROM pages GROUP BY 1)
    SELECT o_orderkey, spec, pages, CASE WHEN pages IS NULL THEN 'INVALID_PAGES' END AS error
    FROM specs LEFT JOIN listed USING (o_orderkey)
    """,
)
def _parse_range_lenient(spark, sf_dir):
    specs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(LENIENT_SPEC).alias("spec"))
    return specs.withColumn("r", R.parse_range_lenient("spec")).select(
        "o_orderkey", "spec", F.array_join("r.pages", ",").alias("pages"), F.col("r.error").alias("error")
    )


@query(
    "listed_pages",
    f"""
    WITH specs AS (SELECT o_orderkey, {LENIENT_SPEC} AS spec FROM orders),
    tok AS (SELECT o_orderkey, trim(unnest(string_split(spec, ','))) AS t FROM specs),
    num AS (
        SELECT o_orderkey,
               CASE WHEN contains(t, '-') THEN trim(left(t, instr(t, '-') - 1)) ELSE t END AS a,
               CASE WHEN contains(t, '-') THEN trim(substr(t, instr(t, '-') + 1)) ELSE t END AS b
        FROM tok WHERE t <> ''),
    val AS (
        SELECT o_orderkey,
               CASE WHEN regexp_full_match(a, '\\+?[0-9]+') THEN a::BIGINT END AS a,
               CASE WHEN regexp_full_match(b, '\\+?[0-9]+') THEN b::BIGINT END AS b
        FROM num),
    ok AS (SELECT o_orderkey FROM val GROUP BY 1 HAVING bool_and(a IS NOT NULL AND b IS NOT NULL)),
    pages AS (
        SELECT DISTINCT o_orderkey, unnest(range(least(a, b), greatest(a, b) + 1)) AS page
        FROM val WHERE o_orderkey IN (SELECT o_orderkey FROM ok))
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY page) AS item, page FROM pages
    """,
)
def _listed_pages(spark, sf_dir):
    """The pages of every lenient set as rows; no array of pages is made."""
    specs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(LENIENT_SPEC).alias("spec"))
    return listed_pages(specs.select("o_orderkey", R.page_set(R.lenient_segments("spec"))["segments"].alias("segments")))


WIDE_SPEC = """
    concat(o_orderkey * 700001 % 4000000007, '-', o_custkey * 900001 % 4000000007, ',', o_orderkey % 9 + 1, '-', o_custkey % 11 + 1,
           ', +', o_orderkey % 13, CASE WHEN o_orderstatus = 'F' THEN ',x' ELSE ',5-2 , 1-4000000000' END,
           CASE WHEN o_orderpriority = '2-HIGH' THEN ',4000000002' ELSE '' END)
"""


@query(
    "page_set",
    f"""
    WITH specs AS (SELECT o_orderkey, o_orderstatus, {WIDE_SPEC} AS spec FROM orders),
    tok AS (SELECT o_orderkey, trim(unnest(string_split(spec, ','))) AS t FROM specs WHERE o_orderstatus <> 'F'),
    val AS (
        SELECT o_orderkey, ltrim(split_part(t, '-', 1), '+')::BIGINT AS a,
               ltrim(CASE WHEN contains(t, '-') THEN split_part(t, '-', 2) ELSE t END, '+')::BIGINT AS b FROM tok),
    seg AS (SELECT o_orderkey, least(a, b) AS lo, greatest(a, b) AS hi FROM val),
    run AS (
        SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY o_orderkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
                       THEN 0 ELSE 1 END AS opens FROM seg),
    numbered AS (SELECT *, sum(opens) OVER (PARTITION BY o_orderkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM run),
    merged AS (SELECT o_orderkey, g, min(lo) AS lo, max(hi) AS hi FROM numbered GROUP BY ALL),
    folded AS (
        SELECT o_orderkey, string_agg(concat(lo, '-', hi), ';' ORDER BY lo) AS ranges, sum(hi - lo + 1)::BIGINT AS n FROM merged GROUP BY 1)
    SELECT s.o_orderkey, s.spec, f.ranges, f.n, CASE WHEN s.o_orderstatus = 'F' THEN 'INVALID_PAGES' END AS error
    FROM specs s LEFT JOIN folded f USING (o_orderkey)
    """,
)
def _page_set(spark, sf_dir):
    """Sets of billions of pages, folded."""
    specs = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(WIDE_SPEC).alias("spec"))
    ranges = F.transform("r.segments", lambda s: F.concat_ws("-", s["lo"].cast("string"), s["hi"].cast("string")))
    return specs.withColumn("r", R.page_set(R.lenient_segments("spec"))).select(
        "o_orderkey", "spec", F.array_join(ranges, ";").alias("ranges"), F.col("r.n").alias("n"), F.col("r.error").alias("error")
    )


ORDERED_SPEC = """
    CASE o_orderpriority
        WHEN '1-URGENT' THEN concat(o_orderkey % 9, ' , ', o_custkey % 6 + 1, '-Z')
        WHEN '2-HIGH' THEN concat('z-', o_orderkey % 5 + 1, ',3,,', o_orderkey % 13)
        WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'All' WHEN 'O' THEN ' ' ELSE '1-z' END
        WHEN '4-NOT SPECIFIED' THEN concat(o_orderkey % 4 + 1, ',', o_custkey % 7, '-', o_orderkey % 7)
        ELSE CASE o_orderstatus WHEN 'F' THEN ',' WHEN 'O' THEN 'a-b' ELSE 'z,1,z' END
    END
"""


@query(
    "expand_spec",
    f"""
    WITH specs AS (
        SELECT o_orderkey, {ORDERED_SPEC} AS spec, (o_custkey % 12)::INTEGER AS n FROM orders),
    clean AS (SELECT *, trim(spec) AS s, trim(spec) IN ('', '1-z') OR lower(trim(spec)) = 'all' AS is_all FROM specs),
    tok AS (
        SELECT o_orderkey, n, trim(unnest(string_split(s, ','))) AS t,
               unnest(range(1, len(string_split(s, ',')) + 1)) AS i
        FROM clean WHERE NOT is_all
        UNION ALL SELECT o_orderkey, n, '1-z', 1 FROM clean WHERE is_all AND n > 0),
    part AS (
        SELECT o_orderkey, n, i,
               lower(CASE WHEN contains(t, '-') THEN trim(left(t, instr(t, '-') - 1)) ELSE t END) AS a,
               lower(CASE WHEN contains(t, '-') THEN trim(substr(t, instr(t, '-') + 1)) ELSE t END) AS b
        FROM tok WHERE t <> ''),
    val AS (
        SELECT o_orderkey, n, i, CASE WHEN a = 'z' THEN n ELSE try_cast(a AS BIGINT) END AS a,
               CASE WHEN b = 'z' THEN n ELSE try_cast(b AS BIGINT) END AS b
        FROM part),
    state AS (
        SELECT o_orderkey, bool_or(a IS NULL OR b IS NULL) AS bad,
               bool_or(least(a, b) < 1 OR greatest(a, b) > n) AS outside
        FROM val GROUP BY 1),
    good AS (
        SELECT o_orderkey, i,
               unnest(CASE WHEN a <= b THEN range(a, b + 1) ELSE range(a, b - 1, -1) END) AS p,
               unnest(range(1, abs(b - a) + 2)) AS j
        FROM val JOIN state USING (o_orderkey) WHERE NOT bad AND NOT outside),
    listed AS (SELECT o_orderkey, string_agg(p::VARCHAR, ',' ORDER BY i, j) AS pages FROM good GROUP BY 1)
    SELECT o_orderkey, spec, n,
           CASE WHEN is_all AND n < 1 THEN '' ELSE pages END AS pages,
           CASE WHEN is_all AND n < 1 THEN NULL
                WHEN bad IS NULL OR bad THEN 'INVALID_PAGES' WHEN outside THEN 'OUT_OF_RANGE' END AS error
    FROM clean LEFT JOIN state USING (o_orderkey) LEFT JOIN listed USING (o_orderkey)
    """,
)
def _expand_spec(spark, sf_dir):
    specs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(ORDERED_SPEC).alias("spec"),
        F.expr("cast(o_custkey % 12 as int)").alias("n"),
    )
    return specs.withColumn("r", R.expand_spec("spec", "n")).select(
        "o_orderkey", "spec", "n", F.array_join("r.pages", ",").alias("pages"), F.col("r.error").alias("error")
    )


SPLIT_SPEC = """
    CASE o_orderpriority
        WHEN '1-URGENT' THEN concat(o_orderkey % 4, '-', o_custkey % 6 + 3, ', ', o_orderkey % 9)
        WHEN '2-HIGH' THEN concat('1 - 2', chr(10), ' 3-4 ', chr(10), chr(10), o_orderkey % 13)
        WHEN '3-MEDIUM' THEN CASE WHEN o_orderstatus = 'F' THEN ' , ' ELSE '1-2-3' END
        WHEN '4-NOT SPECIFIED' THEN concat(o_orderkey % 4 + 1, ',', o_custkey % 7, '-', o_orderkey % 7)
        ELSE '1-5,2-4,2-4'
    END
"""


@query(
    "parse_split_ranges",
    f"""
    WITH specs AS (
        SELECT o_orderkey, {SPLIT_SPEC} AS spec, (o_custkey % 12)::INTEGER AS n FROM orders),
    cut AS (SELECT o_orderkey, n, string_split(replace(spec, chr(10), ','), ',') AS ts FROM specs),
    tok AS (SELECT o_orderkey, n, trim(unnest(ts)) AS t, unnest(range(1, len(ts) + 1)) AS i FROM cut),
    val AS (
        SELECT o_orderkey, n, i, t, regexp_full_match(t, '[0-9]+(\\s*-\\s*[0-9]+)?') AS shaped,
               try_cast(trim(split_part(t, '-', 1)) AS BIGINT) AS a,
               try_cast(trim(CASE WHEN contains(t, '-') THEN split_part(t, '-', 2) ELSE t END) AS BIGINT) AS b
        FROM tok WHERE t <> ''),
    err AS (
        SELECT *, CASE WHEN NOT shaped THEN 'BAD_TOKEN' WHEN a < 1 OR b < 1 OR a > b THEN 'BAD_RANGE'
                       WHEN b > n THEN 'OUT_OF_RANGE' END AS e FROM val),
    folded AS (
        SELECT o_orderkey, arg_min(e, i) FILTER (e IS NOT NULL) AS error,
               string_agg(concat(a, '-', b), ';' ORDER BY i) AS ranges FROM err GROUP BY 1)
    SELECT s.o_orderkey, s.n, CASE WHEN f.error IS NULL THEN f.ranges END AS ranges,
           CASE WHEN f.o_orderkey IS NULL THEN 'EMPTY' ELSE f.error END AS error
    FROM specs s LEFT JOIN folded f USING (o_orderkey)
    """,
)
def _parse_split_ranges(spark, sf_dir):
    specs = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(SPLIT_SPEC).alias("spec"),
        F.expr("cast(o_custkey % 12 as int)").alias("n"),
    )
    parsed = specs.withColumn("r", R.parse_split_ranges("spec", "n"))
    pairs = F.transform("r.ranges", lambda g: F.concat_ws("-", g["start"].cast("string"), g["end"].cast("string")))
    return parsed.select(
        "o_orderkey", "n", F.array_join(pairs, ";").alias("ranges"), F.col("r.error").alias("error")
    )


@query(
    "format_ranges",
    f"""
    WITH {ORDER_PAGES},
    kept AS (SELECT doc_id, page FROM order_pages WHERE o_orderstatus <> 'P'),
    islands AS (
        SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM kept),
    runs AS (SELECT doc_id, g, min(page) AS a, max(page) AS b FROM islands GROUP BY 1, 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS run,
           CASE WHEN a = b THEN a::VARCHAR ELSE concat(a, '-', b) END AS spec
    FROM runs
    """,
)
def _format_ranges(spark, sf_dir):
    kept = order_pages(spark, sf_dir).filter(F.col("o_orderstatus") != "P")
    return format_ranges(kept.select("doc_id", "page"), ["doc_id"], "page")


REMOVALS = {
    "AUTOMOBILE": [("1,3-5",)],
    "BUILDING": [("5-3, 9",)],
    "FURNITURE": [("0-100",)],
    "HOUSEHOLD": [("x",)],
    "MACHINERY": [(",, 2 ,7-4000000000",)],
}
REMOVED = """
    seg(segment, lo, hi) AS (
        VALUES ('AUTOMOBILE', 1, 1), ('AUTOMOBILE', 3, 5), ('BUILDING', 3, 5), ('BUILDING', 9, 9),
               ('FURNITURE', 0, 100), ('MACHINERY', 2, 2), ('MACHINERY', 7, 4000000000)),
    kept AS (
        SELECT p.doc_id, p.page, p.o_orderkey, c.c_mktsegment
        FROM order_pages p JOIN customer c ON c.c_custkey = p.doc_id
        WHERE c.c_mktsegment <> 'HOUSEHOLD' AND NOT EXISTS (
            SELECT 1 FROM seg s WHERE s.segment = c.c_mktsegment AND p.page BETWEEN s.lo AND s.hi))
"""


@query("delete_pages", f"WITH {ORDER_PAGES}, {REMOVED} SELECT doc_id, page, o_orderkey FROM kept")
def _delete_pages(spark, sf_dir):
    removals = by_segment(spark, sf_dir, REMOVALS, ["spec"])
    kept, _ = delete_pages(order_pages(spark, sf_dir), removals)
    return kept.select("doc_id", "page", "o_orderkey")


@query(
    "delete_pages_errors",
    f"""
    WITH {ORDER_PAGES}, {REMOVED}
    SELECT c_custkey AS doc_id, 'INVALID_PAGES' AS error FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
    UNION ALL
    SELECT DISTINCT o_custkey, 'DELETE_ALL' FROM orders JOIN customer ON c_custkey = o_custkey
    WHERE c_mktsegment <> 'HOUSEHOLD' AND o_custkey NOT IN (SELECT doc_id FROM kept)
    """,
)
def _delete_pages_errors(spark, sf_dir):
    removals = by_segment(spark, sf_dir, REMOVALS, ["spec"])
    _, errors = delete_pages(order_pages(spark, sf_dir), removals)
    return errors


EXTRACTS = {
    "AUTOMOBILE": [("1-z",)],
    "BUILDING": [("z-1",)],
    "FURNITURE": [("2,1,2",)],
    "HOUSEHOLD": [("3-2,1,z",)],
    "MACHINERY": [("4-6,8",)],
}
EXTRACTED = """
    seg(segment, i, lo, hi) AS (
        VALUES ('AUTOMOBILE', 1, 1, -1), ('BUILDING', 1, -1, 1), ('FURNITURE', 1, 2, 2), ('FURNITURE', 2, 1, 1),
               ('FURNITURE', 3, 2, 2), ('HOUSEHOLD', 1, 3, 2), ('HOUSEHOLD', 2, 1, 1), ('HOUSEHOLD', 3, -1, -1),
               ('MACHINERY', 1, 4, 6), ('MACHINERY', 2, 8, 8)),
    sized AS (
        SELECT o_custkey AS doc_id, any_value(c_mktsegment) AS segment, count(*) AS n
        FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1),
    named AS (
        SELECT doc_id, n, i, CASE WHEN lo = -1 THEN n ELSE lo END AS lo, CASE WHEN hi = -1 THEN n ELSE hi END AS hi
        FROM sized JOIN seg USING (segment)),
    bad AS (SELECT DISTINCT doc_id FROM named WHERE greatest(lo, hi) > n),
    wanted AS (
        SELECT doc_id, i, unnest(CASE WHEN lo <= hi THEN range(lo, hi + 1) ELSE range(lo, hi - 1, -1) END) AS page,
               unnest(range(1, abs(hi - lo) + 2)) AS j
        FROM named WHERE doc_id NOT IN (SELECT doc_id FROM bad)),
    placed AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS position FROM wanted)
"""


@query(
    "extract_pages",
    f"""
    WITH {ORDER_PAGES}, {EXTRACTED}
    SELECT doc_id, page, o_orderkey, position FROM placed JOIN order_pages USING (doc_id, page)
    """,
)
def _extract_pages(spark, sf_dir):
    specs = by_segment(spark, sf_dir, EXTRACTS, ["spec"]).join(customer_counts(spark, sf_dir), "doc_id")
    found, _ = extract_pages(order_pages(spark, sf_dir), specs)
    return found.select("doc_id", "page", "o_orderkey", "position")


@query("extract_pages_errors", f"WITH {EXTRACTED} SELECT doc_id, 'OUT_OF_RANGE' AS error FROM bad")
def _extract_pages_errors(spark, sf_dir):
    specs = by_segment(spark, sf_dir, EXTRACTS, ["spec"]).join(customer_counts(spark, sf_dir), "doc_id")
    return extract_pages(order_pages(spark, sf_dir), specs)[1]


FULL_SPEC = """
    CASE o_orderpriority WHEN '1-URGENT' THEN '1-z' WHEN '2-HIGH' THEN '1-3' WHEN '3-MEDIUM' THEN '1, 2,3'
        WHEN '4-NOT SPECIFIED' THEN '2-3,1' ELSE ' 1-2,3-5 ' END
"""


@query(
    "is_full_range",
    f"""
    SELECT o_orderkey, {FULL_SPEC} AS spec, (o_custkey % 7)::INTEGER AS n,
           CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN o_custkey % 7 = 3
               WHEN '3-MEDIUM' THEN o_custkey % 7 = 3 WHEN '4-NOT SPECIFIED' THEN false
               ELSE o_custkey % 7 = 5 END AS is_full
    FROM orders
    """,
)
def _is_full_range(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.expr(FULL_SPEC).alias("spec"),
        F.expr("cast(o_custkey % 7 as int)").alias("n"),
    ).withColumn("is_full", R.is_full_range("spec", "n"))


@query(
    "has_text",
    f"""
    WITH {LINES}
    SELECT doc_id, bool_or(regexp_matches(text, '[0-9]')) AS has_text FROM lines GROUP BY 1
    """,
)
def _has_text(spark, sf_dir):
    # pages without a digit play the scanned ones
    masked = lines(spark, sf_dir).withColumn(
        "text", F.when(F.col("text").rlike("[0-9]"), F.col("text")).otherwise(" \t ")
    )
    return has_text(masked)
