"""The test tables in the roles of documents, pages, files and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.operators.text import split_pages
from quire.plans.blocks import row_numbers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut at line ends: (doc_id, page, text)."""
    return split_pages(table(spark, sf_dir, "documents"), sep="\n")


# blank last lines go, as the reading of pages asks
LINES = r"""
    cut AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    counted AS (
        SELECT doc_id, parts,
               len(parts) - CASE WHEN regexp_matches(parts[len(parts)], '[^\s]') THEN 0 ELSE 1 END AS n
        FROM cut),
    numbered AS (SELECT doc_id, parts, unnest(range(1, n + 1)) AS page FROM counted),
    lines AS (SELECT doc_id, page::INTEGER AS page, parts[page] AS text FROM numbered)
"""


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages of their customer: (doc_id, page, and the order columns)."""
    orders = table(spark, sf_dir, "orders").withColumn("doc_id", F.col("o_custkey"))
    return row_numbers(orders, ["doc_id"], "o_orderkey", "page").select(
        "doc_id", "page", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"
    )


ORDER_PAGES = """
    order_pages AS (
        SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page,
               o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate
        FROM orders)
"""


def by_segment(spark: SparkSession, sf_dir: str, choices: dict[str, list[tuple]], names: list[str]) -> DataFrame:
    """Rows (doc_id, *names) for every customer, chosen by market segment."""
    structs = {
        seg: F.array(*[F.struct(*[_typed(v).alias(n) for v, n in zip(row, names)]) for row in rows])
        for seg, rows in choices.items()
    }
    picked: Column | None = None
    for seg, rows in structs.items():
        hit = F.col("c_mktsegment") == seg
        picked = F.when(hit, rows) if picked is None else picked.when(hit, rows)
    return (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("doc_id"), F.explode(picked).alias("__r"))
        .select("doc_id", "__r.*")
    )


def _typed(value: object) -> Column:
    return F.lit(value).cast("bigint") if isinstance(value, int) else F.lit(value)


def customer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n) of every customer that has orders."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


def part_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages: (doc_id, page, media, crop, trim, rotate), one document per brand."""
    part = table(spark, sf_dir, "part")
    w, h = F.col("p_retailprice"), F.col("p_size") * 20.0
    crop = geo.box(F.lit(100.0), F.lit(50.0), w * 0.75, F.lit(600.0))
    trim = geo.box(w, h, F.lit(-10.0), F.lit(-10.0))
    return part.select(
        F.col("p_brand").alias("doc_id"),
        (F.col("p_partkey") + 1).alias("page"),
        geo.box(w, F.lit(0.0), F.lit(0.0), h).alias("media"),
        F.when(F.col("p_type") != "PROMO", crop).alias("crop"),
        F.when(F.col("p_type") == "LARGE", trim).alias("trim"),
        (F.pmod(F.col("p_partkey"), F.lit(4)) * 90).cast("int").alias("rotate"),
    )


PART_BOXES = """
    part_boxes AS (
        SELECT p_brand AS doc_id, p_partkey + 1 AS page, ((p_partkey % 4) * 90)::INTEGER AS rotate,
               0.0::DOUBLE AS mx0, 0.0::DOUBLE AS my0, p_retailprice AS mx1, p_size * 20.0::DOUBLE AS my1,
               p_type <> 'PROMO' AS has_crop,
               least(100.0, p_retailprice * 0.75::DOUBLE) AS cx0, 50.0::DOUBLE AS cy0,
               greatest(100.0, p_retailprice * 0.75::DOUBLE) AS cx1, 600.0::DOUBLE AS cy1,
               p_type = 'LARGE' AS has_trim
        FROM part),
    visible AS (
        SELECT *,
               CASE WHEN meet THEN greatest(cx0, mx0) ELSE mx0 END AS vx0,
               CASE WHEN meet THEN greatest(cy0, my0) ELSE my0 END AS vy0,
               CASE WHEN meet THEN least(cx1, mx1) ELSE mx1 END AS vx1,
               CASE WHEN meet THEN least(cy1, my1) ELSE my1 END AS vy1
        FROM (SELECT *, has_crop AND least(cx1, mx1) - greatest(cx0, mx0) > 1
                     AND least(cy1, my1) - greatest(cy0, my0) > 1 AS meet FROM part_boxes))
"""


def rounded(value: Column | str, digits: int = 9) -> Column:
    """Rounded double without a negative zero, for comparison across engines."""
    v = F.col(value) if isinstance(value, str) else value
    return F.round(v, digits) + F.lit(0.0)
