"""Page text: splitting, byte budget, export, OCR fallback, text layer test."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_blank
from quire.plans.blocks import BLOCK, ORDER_BITS, block
from quire.plans.scan import scan_sums

#: Bytes of joined text in one row.
PART_BYTES = 16 << 20


def head(text: Column, max_bytes: int | None) -> Column:
    """The first bytes of a text, a broken last character as U+FFFD; all of it for None."""
    if max_bytes is None:
        return text
    cut = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, max_bytes).cast("string"))
    return F.when(F.octet_length(text) > max_bytes, cut).otherwise(text)


def page_count(text: Column, sep: str = "\f") -> Column:
    """Number of pages that ``split_pages`` makes of a text; null for null."""
    parts = F.split(text, re.escape(sep))
    last_blank = is_blank(F.get(parts, F.size(parts) - 1))
    return F.when(text.isNotNull(), F.size(parts) - last_blank.cast("int"))


def split_pages(df: DataFrame, key: str = "doc_id", text: str = "text", sep: str = "\f", keep: Sequence[str] = ()) -> DataFrame:
    """One row per page (key, keep, page, text); a blank last page is dropped, inner ones stay."""
    parts = F.split(F.col(text), re.escape(sep))
    cut = df.select(key, *keep, parts.alias("__parts"))
    cut = cut.withColumn("__n", F.size("__parts"))
    last_blank = is_blank(F.get("__parts", F.col("__n") - 1))
    kept = F.when(last_blank, F.slice("__parts", F.lit(1), F.col("__n") - 1)).otherwise(
        F.col("__parts")
    )
    return cut.select(key, *keep, F.posexplode(kept).alias("__pos", "text")).select(
        key, *keep, (F.col("__pos") + 1).alias("page"), "text"
    )


def cap_text(
    pages: DataFrame,
    max_bytes: int,
    key: str = "doc_id",
    bits: int = ORDER_BITS,
) -> DataFrame:
    """Keep the first ``max_bytes`` of each document; page breaks count one byte.

    The text itself is never shuffled for the running total: byte counts are
    summed per block of pages, only the block that crosses the budget is looked
    at page by page, and the result is one (document, page, bytes) limit per
    document that is too long.
    """
    sizes = pages.select(
        key,
        "page",
        block("page", bits).alias(BLOCK),
        (F.octet_length("text") + 1).cast("bigint").alias("__size"),
    )
    ahead = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    crossing = (
        sizes.groupBy(key, BLOCK)
        .agg(F.sum("__size").alias("__total"))
        .withColumn("__skip", F.coalesce(F.sum("__total").over(ahead), F.lit(0)))
        .filter(
            (F.col("__skip") < max_bytes) & (F.col("__skip") + F.col("__total") >= max_bytes)
        )
        .select(key, BLOCK, "__skip")
    )
    within = (
        Window.partitionBy(key, BLOCK).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.join(crossing, [key, BLOCK]).select(
        key,
        "page",
        (F.col("__skip") + F.coalesce(F.sum("__size").over(within), F.lit(0))).alias("__start"),
    )
    limits = (
        starts.filter(F.col("__start") < max_bytes)
        .groupBy(key)
        .agg(
            F.max("page").alias("__last"),
            (F.lit(max_bytes) - F.max_by("__start", "page")).cast("int").alias("__bytes"),
        )
    )

    on_limit = (F.col("page") == F.col("__last")) & (F.octet_length("text") >= F.col("__bytes"))
    head = F.make_valid_utf8(
        F.substring(F.encode("text", "UTF-8"), F.lit(1), F.col("__bytes")).cast("string")
    )
    limited = pages.join(limits, key, "left").filter(
        F.col("__last").isNull() | (F.col("page") <= F.col("__last"))
    )
    limited = limited.withColumn("__cut", F.coalesce(on_limit, F.lit(False)))
    limited = limited.withColumn("text", F.when(F.col("__cut"), head).otherwise(F.col("text")))
    return limited.filter(~(F.col("__cut") & is_blank("text"))).select(*pages.columns)


def export_text(
    pages: DataFrame, ranges: DataFrame, key: str = "doc_id", part_bytes: int = PART_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Text of pages ``first``..``last`` of each document, and the refused ranges.

    ``ranges`` is (key, first, last) with null for an open end. The text comes in
    parts: one begins with the first page after each ``part_bytes``, so a part is
    shorter than that or a page longer. Parts of one document joined by a form
    feed, in order, are its whole text.
    """
    reversed_range = F.coalesce(F.col("first") > F.col("last"), F.lit(False))
    errors = ranges.filter(reversed_range).select(key, F.lit("INVALID_RANGE").alias("error"))
    usable = ranges.filter(~reversed_range).select(
        key,
        F.greatest(F.coalesce(F.col("first"), F.lit(1)), F.lit(1)).alias("__first"),
        F.col("last").alias("__last"),
    )
    # places come from sizes alone; the text moves to its place and to its part
    size = (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("bigint")
    chosen = pages.select(key, "page", size.alias("__size")).join(usable, key).filter(
        (F.col("page") >= F.col("__first"))
        & (F.col("__last").isNull() | (F.col("page") <= F.col("__last")))
    )
    before = scan_sums(chosen.select(key, "page", "__size"), [key], "page", {"__before": F.col("__size")})
    placed = pages.select(key, "page", "text").join(before.select(key, "page", "__before"), [key, "page"])
    part = F.floor(F.col("__before") / part_bytes).cast("bigint")
    ordered = F.sort_array(F.collect_list(F.struct("page", "text")))
    text = (
        placed.groupBy(key, part.alias("part"))
        .agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\f").alias("text"))
    )
    return text, errors


def effective_text(pages: DataFrame, ocr: DataFrame, key: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Native text unless empty, else the recognised text, else ""."""
    found = ocr.select(*key, F.col("text").alias("__ocr"))
    return pages.join(found, list(key), "left").select(
        *[c for c in pages.columns if c != "text"],
        F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("__ocr"), F.lit("")).alias("text"),
    )


def has_text(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, has_text): whether any page shows more than white space."""
    return pages.groupBy(key).agg(
        F.bool_or(~is_blank(F.coalesce("text", F.lit("")))).alias("has_text")
    )
