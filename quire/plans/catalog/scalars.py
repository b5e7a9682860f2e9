"""Scalar function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import formats, paths
from quire.plans.registry import query
from quire.plans.roles import table


@query(
    "path_parts",
    """
    WITH p AS (SELECT page_id, url AS path FROM pages
               UNION ALL SELECT -1 - page_id, replace(concat(url, '.tar.gz'), '/', chr(92)) FROM pages
               UNION ALL SELECT -100000000 - page_id, concat('dir/.hidden', page_id) FROM pages),
    b AS (SELECT *, regexp_extract(path, '([^/\\\\]*)$', 1) AS tail FROM p),
    c AS (SELECT page_id, path, CASE WHEN tail = '' THEN path ELSE tail END AS base,
                 CASE WHEN contains(path, '/') OR contains(path, chr(92)) THEN left(path, length(path) - length(tail) - 1) ELSE '' END AS dir
          FROM b)
    SELECT page_id, base, dir,
           CASE WHEN contains(substr(base, 2), '.') THEN left(base, length(base) - instr(reverse(base), '.')) ELSE base END AS stem
    FROM c
    """,
)
def _path_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    windows = F.replace(F.concat(F.col("url"), F.lit(".tar.gz")), F.lit("/"), F.lit("\\"))
    hidden = F.concat(F.lit("dir/.hidden"), F.col("page_id").cast("string"))
    every = (
        pages.select("page_id", F.col("url").alias("path"))
        .unionByName(pages.select((F.lit(-1) - F.col("page_id")).alias("page_id"), windows.alias("path")))
        .unionByName(pages.select((F.lit(-100000000) - F.col("page_id")).alias("page_id"), hidden.alias("path")))
    )
    return every.select("page_id", paths.path_parts("path").alias("p")).select("page_id", "p.*")


@query(
    "join_path",
    """
    SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN p_name WHEN 'SMALL' THEN concat('C:', chr(92), 'out', chr(92), p_name)
        WHEN 'LARGE' THEN concat('C:', chr(92), 'a/b/', p_name) WHEN 'MEDIUM' THEN concat('/', p_name)
        ELSE concat('/out/', p_brand, '/', p_name) END AS path
    FROM part
    """,
)
def _join_path(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    kind = F.col("p_type")
    directory = (
        F.when(kind == "PROMO", "").when(kind == "SMALL", "C:\\out\\").when(kind == "LARGE", "C:\\a/b")
        .when(kind == "MEDIUM", "//").otherwise(F.concat(F.lit("/out/"), F.col("p_brand"), F.lit("//")))
    )
    return part.select("p_partkey", paths.join_path(directory, "p_name").alias("path"))


# sizes from bytes to petabytes
SIZES = "cast(o_totalprice * 100 as bigint) * CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN -1 WHEN '3-MEDIUM' THEN 1 WHEN '4-NOT SPECIFIED' THEN 1000 ELSE 1000000000 END"
SIZES_SQL = """
    SELECT o_orderkey, round(o_totalprice * 100)::BIGINT * CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN -1
        WHEN '3-MEDIUM' THEN 1 WHEN '4-NOT SPECIFIED' THEN 1000 ELSE 1000000000 END AS n FROM orders
"""


@query(
    "format_bytes",
    f"""
    WITH s AS ({SIZES_SQL}),
    t AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2
                         WHEN n < 1099511627776 THEN 3 WHEN n < 1125899906842624 THEN 4 ELSE 5 END AS k FROM s)
    SELECT o_orderkey, n,
           CASE WHEN n < 0 THEN '—' WHEN k = 0 THEN concat(n, ' B')
                ELSE concat(printf('%.2f', n / pow(1024::DOUBLE, k)), ' ', CASE k WHEN 1 THEN 'KB' WHEN 2 THEN 'MB' WHEN 3 THEN 'GB' WHEN 4 THEN 'TB' ELSE 'PB' END)
           END AS size,
           CASE WHEN n >= 2147483648 THEN 'veryLarge' WHEN n >= 524288000 THEN 'large' ELSE 'normal' END AS tier,
           format('{{:,}}', n) AS count_text
    FROM t
    """,
)
def _format_bytes(spark, sf_dir):
    sized = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", SIZES.replace("o_totalprice * 100", "round(o_totalprice * 100)") + " AS n"
    )
    return sized.select(
        "o_orderkey", "n", formats.format_bytes("n").alias("size"), formats.size_tier("n").alias("tier"),
        formats.format_count("n").alias("count_text"),
    )


@query(
    "size_tier_of_set",
    f"""
    SELECT o_custkey, CASE WHEN max(n) >= 2147483648 THEN 'veryLarge' WHEN max(n) >= 524288000 THEN 'large' ELSE 'normal' END AS tier
    FROM (SELECT o_custkey, (round(o_totalprice)::BIGINT * 4000) AS n FROM orders) GROUP BY 1
    """,
)
def _size_tier_of_set(spark, sf_dir):
    sized = table(spark, sf_dir, "orders").select(
        "o_custkey", (F.round("o_totalprice").cast("bigint") * 4000).alias("n")
    )
    return sized.groupBy("o_custkey").agg(formats.highest_tier("n").alias("tier"))


@query(
    "relative_time",
    """
    WITH d AS (
        SELECT event_id, ts, greatest(0, date_diff('millisecond', ts, TIMESTAMP '2024-01-20 00:00:00')) // 1000 AS s FROM events
        UNION ALL
        SELECT -1 - event_id, ts, greatest(0, date_diff('millisecond', ts, ts + to_seconds(event_id % 9000))) // 1000 FROM events
        UNION ALL
        SELECT -100000000 - event_id, ts, greatest(0, date_diff('millisecond', ts, TIMESTAMP '2024-03-01 00:00:00')) // 1000 FROM events)
    SELECT event_id, CASE WHEN s < 45 THEN 'just now' WHEN s < 3600 THEN concat(greatest(1, s // 60), ' min ago')
        WHEN s < 86400 THEN concat(s // 3600, CASE WHEN s // 3600 = 1 THEN ' hour ago' ELSE ' hours ago' END)
        WHEN s < 2592000 THEN concat(s // 86400, CASE WHEN s // 86400 = 1 THEN ' day ago' ELSE ' days ago' END)
        ELSE strftime(ts, '%-m/%-d/%Y') END AS said
    FROM d
    """,
)
def _relative_time(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    later = F.timestamp_millis(F.unix_millis("ts") + F.pmod(F.col("event_id"), F.lit(9000)) * 1000)
    cases = [
        (F.col("event_id"), F.lit("2024-01-20 00:00:00").cast("timestamp")),
        (F.lit(-1) - F.col("event_id"), later),
        (F.lit(-100000000) - F.col("event_id"), F.lit("2024-03-01 00:00:00").cast("timestamp")),
    ]
    said = F.array(*[
        F.struct(key.cast("bigint").alias("event_id"), formats.relative_time("ts", now).alias("said")) for key, now in cases
    ])
    return events.select(F.explode(said).alias("s")).select("s.*")


NAME = """
    CASE p_type WHEN 'PROMO' THEN concat('  ', p_name, '.PDF ') WHEN 'SMALL' THEN concat(p_name, CASE WHEN p_size > 25 THEN ':' ELSE '?' END)
        WHEN 'MEDIUM' THEN CASE WHEN p_size > 25 THEN 'Com7' ELSE 'nul.x' END WHEN 'LARGE' THEN repeat('ab', 70 + p_size)
        WHEN 'ECONOMY' THEN CASE WHEN p_size > 40 THEN ' ' ELSE concat(p_name, chr(7)) END ELSE p_name END
"""


@query(
    "check_name",
    f"""
    WITH n AS (SELECT p_partkey, p_type, p_size, trim({NAME}) AS t FROM part)
    SELECT p_partkey,
           CASE p_type WHEN 'PROMO' THEN t WHEN 'LARGE' THEN CASE WHEN 2 * (70 + p_size) + 4 <= 200 THEN concat(t, '.pdf') END
                WHEN 'STANDARD' THEN concat(t, '.pdf') END AS pdf_name,
           CASE p_type WHEN 'SMALL' THEN 'BAD_CHARACTER' WHEN 'MEDIUM' THEN 'RESERVED'
                WHEN 'LARGE' THEN CASE WHEN 2 * (70 + p_size) + 4 > 200 THEN 'TOO_LONG' END
                WHEN 'ECONOMY' THEN CASE WHEN p_size > 40 THEN 'EMPTY' ELSE 'BAD_CHARACTER' END END AS pdf_error,
           CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN CASE WHEN 2 * (70 + p_size) <= 200 THEN concat(t, '.txt') END
                WHEN 'ECONOMY' THEN CASE WHEN p_size <= 40 THEN concat(t, '.txt') END ELSE concat(t, '.txt') END AS txt_name,
           CASE p_type WHEN 'SMALL' THEN 'BAD_CHARACTER' WHEN 'LARGE' THEN CASE WHEN 2 * (70 + p_size) > 200 THEN 'TOO_LONG' END
                WHEN 'ECONOMY' THEN CASE WHEN p_size > 40 THEN 'EMPTY' END END AS txt_error
    FROM n
    """,
)
def _check_name(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", F.expr(NAME).alias("name"))
    checked = named.select("p_partkey", paths.check_name("name").alias("p"), paths.check_name("name", "txt").alias("t"))
    return checked.select(
        "p_partkey", F.col("p.value").alias("pdf_name"), F.col("p.error").alias("pdf_error"),
        F.col("t.value").alias("txt_name"), F.col("t.error").alias("txt_error"),
    )


@query(
    "parse_hex",
    """
    WITH c AS (SELECT p_partkey, p_type, p_size AS s, (p_partkey * 7) % 256 AS a, (p_partkey * 3) % 256 AS b, p_partkey % 256 AS d FROM part)
    SELECT p_partkey,
           CASE WHEN p_type = 'PROMO' THEN 0.067 WHEN p_type = 'SMALL' THEN s % 16 * 17 / 255 ELSE a / 255 END::DOUBLE AS r,
           CASE WHEN p_type = 'PROMO' THEN 0.094 WHEN p_type = 'SMALL' THEN 187 / 255 ELSE b / 255 END::DOUBLE AS g,
           CASE WHEN p_type = 'PROMO' THEN 0.153 WHEN p_type = 'SMALL' THEN s % 16 * 17 / 255 ELSE d / 255 END::DOUBLE AS b
    FROM c
    """,
)
def _parse_hex(spark, sf_dir):
    key = F.col("p_partkey")

    def pair(k):
        return F.lpad(F.hex(F.pmod(key * k, F.lit(256))), 2, "0")

    digit = F.hex(F.pmod(F.col("p_size"), F.lit(16)).cast("bigint"))
    full = F.concat(pair(7), pair(3), pair(1))
    color = (
        F.when(F.col("p_type") == "PROMO", "#12345").when(F.col("p_type") == "SMALL", F.concat(F.lit(" #"), digit, F.lit("b"), digit))
        .when(F.col("p_type") == "LARGE", full).otherwise(F.concat(F.lit("#"), F.lower(full)))
    )
    return table(spark, sf_dir, "part").select("p_partkey", formats.parse_hex(color).alias("c")).select("p_partkey", "c.*")
