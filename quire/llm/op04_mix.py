"""Mixing sources to target weights by systematic sampling.

Each document's expected copies are prefix-summed within its source in a fixed order, one random offset is added, and
a copy is emitted for each integer boundary that the sum crosses. The order puts documents of like size side by side,
so that the words taken stay near the target, and is otherwise random. Sums are whole numbers of 2**-24 copies, so
they are the same in any grouping.

Sources of any size: rows are numbered inside cells of (source, size class, first digits of a hash); one summary row per
cell carries the sum of the cells before it. Cells hold a bounded share of a source, as the hash spreads copies too.
The number of digits changes the layout, never the result.

Edge cases: a null source is a source of its own, after all others; null and empty texts have size 0 and take part;
rows repeated under one id are sampled one by one, equal ones are interchangeable; a source without words has target 0
and gives nothing; an empty table gives no rows. Other columns are kept; names that clash with result columns are
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
BITS = 24
#: Rows for which one hexadecimal digit of the hash is spent; bounds a cell of a source with all rows.
CELL_ROWS = 1 << 22
RESULT = ["size", "source_size", "target", "copies"]


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.when(text.isNull(), 0).otherwise(F.size(F.array_remove(F.split(text, SPACE), ""))).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes to each doubling of the size."""
    bits = F.when(size > 0, F.length(F.bin(size))).otherwise(0)
    return (bits * 16 + F.call_function("shiftright", size * 16, bits)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in 2**-24 copies."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long")


def targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), one row for each source.

    Sources share ``share`` times all sizes by weight, but none gets over ``most`` times its own size; what it would
    have got beyond goes to the others by weight. So targets are min(cap, level * weight), and the level follows from
    sorting sources by cap / weight: of the levels that leave the first k sources at their caps, it is the first, and so
    the greatest, that is not above the next source's own ratio.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")  # one row per source, not per document
    place = F.row_number().over(by_name) - 1
    weighed = totals.withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int"))
    )
    caps = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    ratio = F.col("cap") / F.col("weight")
    by_ratio = Window.orderBy(ratio, F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(onward)
    levels = caps.withColumn("level", level).withColumn("level", F.when(F.col("level") <= ratio, F.col("level")))
    chosen = F.max("level").over(everyone)
    return levels.select(
        "source", "source_size", "weight",
        F.least("cap", F.coalesce(chosen * F.col("weight"), F.col("cap"))).alias("target"),
    )


def plan_copies(
    documents: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    source: str = "source",
    text: str = "text",
    keys: Sequence[str] = ("doc_id",),
    digits: int | None = None,
) -> DataFrame:
    """Documents with size, source_size, target and copies; copies are below ``most`` + 1."""
    if digits is None:
        digits = max(1, math.ceil(math.log(max(2, documents.count()) / CELL_ROWS, 16)))
    tie = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.md5(F.coalesce(F.col(text), F.lit("")))))
    rows = documents.select(
        *[c for c in documents.columns if c not in RESULT],
        F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("null")).alias("__source"),
        n_words(F.col(text)).alias("size"),
        tie.alias("__tie"),
    ).withColumns({"__class": size_class(F.col("size")), "__sub": F.substring("__tie", 1, digits)})

    cell = ["__source", "__class", "__sub"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__words"))
    named = F.when(F.col("__source") != "null", F.expr("substring(__source, 2)"))
    totals = cells.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    aims = targets(totals.select(named.alias("source"), "source_size"), weights, share, most).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")).alias("__source"),
        "source_size", "target", offset(F.col("source"), seed).alias("__offset"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << BITS))).otherwise(0).cast("long").alias("__each"),
    )
    before = Window.partitionBy("__source").orderBy("__class", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.join(aims, "__source").select(
        *cell, "source_size", "target", "__each",
        (F.col("__offset") + F.coalesce(F.sum(F.col("__n") * F.col("__each")).over(before), F.lit(0))).alias("__from"),
    )
    number = F.row_number().over(Window.partitionBy(*cell).orderBy("__tie"))
    summed = rows.withColumn("__number", number).join(cells, cell)
    end = F.col("__from") + F.col("__number") * F.col("__each")
    copies = F.shiftright(end, BITS) - F.shiftright(end - F.col("__each"), BITS)
    return summed.withColumn("copies", copies).drop(*cell, "__tie", "__number", "__from", "__each")


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of the input."""
    aside = {c: f"__own_{c}" for c in documents.columns if c in RESULT}
    planned = plan_copies(documents.withColumnsRenamed(aside), **options).filter("copies > 0")
    each = planned.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop(*RESULT)
    return each.withColumnsRenamed({own: c for c, own in aside.items()}).select(*documents.columns)


def op4_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    planned = plan_copies(documents)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH docs AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '') || chr(31) || md5(coalesce(text, ''))) AS tie FROM documents),
classed AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS bits FROM docs),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
    SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight,
           source_size * 2.0::DOUBLE AS cap FROM totals),
levels AS (
    SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aims AS (
    SELECT source, source_size, least(cap, coalesce((max(level) FILTER (WHERE level <= cap / weight) OVER ()) * weight, cap)) AS target,
           ('0x' || substr(md5('7:' || coalesce('=' || source, 'null')), 1, 6))::BIGINT AS shift FROM levels),
placed AS (
    SELECT doc_id, d.source, size, source_size, target, shift,
           CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216)::BIGINT ELSE 0 END AS each,
           row_number() OVER (PARTITION BY d.source ORDER BY bits * 16 + ((size * 16) >> bits), tie) AS k
    FROM classed d JOIN aims a ON d.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target, (size * (((shift + k * each) >> 24) - ((shift + (k - 1) * each) >> 24)))::BIGINT AS taken FROM placed
"""
