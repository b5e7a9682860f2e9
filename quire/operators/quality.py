"""Page quality: ink statistics, blank pages, diffs, variant and version choice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.ranges import is_full_range

DARK_LUMA = 240
FLAT_STD = 4.0
FLAT_MEAN = 160.0
DIFF_LIMIT = 60
WHITE = 0xFFFFFF
BLANK_SHARE = {"strict": 0.0005, "normal": 0.003, "aggressive": 0.01}

MIN_PAGE_BUDGET = 15_000
QUALITY_FLOOR = 40
MULTIPLIER = {"merge": 1.5, "optimize": 2.5}
OTHER_MULTIPLIER = 2.0

EDIT_VERSION = 1
MAX_OBJECTS = 500
MAX_TEXT_CHARS = 8000
MAX_INK_POINTS = 8000

SUMS = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n", "dark", "total", "squares")]
)


@F.pandas_udf(SUMS)
def _byte_sums(pixels: pd.Series) -> pd.DataFrame:
    """Integer sums of 8-bit gray tiles."""
    rows = []
    for raw in pixels:
        values = np.frombuffer(raw or b"", dtype=np.uint8).astype(np.int64)
        rows.append(
            (values.size, int((values < DARK_LUMA).sum()), int(values.sum()), int((values * values).sum()))
        )
    return pd.DataFrame(rows, columns=["n", "dark", "total", "squares"])


def luma_stats(
    tiles: DataFrame, keys: Sequence[str] = ("doc_id", "page"), pixels: str = "pixels"
) -> DataFrame:
    """(keys, dark, mean, std) of gray tiles; a page without pixels is 0, 255, 0.

    ``pixels`` is array<int> or binary. Only four integer sums per page and task
    are shuffled, and they stay exact until the final division.
    """
    if isinstance(tiles.schema[pixels].dataType, T.BinaryType):
        sums = tiles.select(*keys, _byte_sums(F.col(pixels)).alias("__s"))
        parts = [F.sum(f"__s.{n}").alias(f"__{n}") for n in SUMS.names]
    else:
        sums = tiles.select(*keys, F.explode_outer(pixels).alias("__p"))
        p = F.col("__p").cast("bigint")
        parts = [
            F.count(p).alias("__n"),
            F.count_if(p < DARK_LUMA).alias("__dark"),
            F.sum(p).alias("__total"),
            F.sum(p * p).alias("__squares"),
        ]
    totals = sums.groupBy(*keys).agg(*parts)
    n, wide = F.col("__n"), "decimal(38,0)"
    spread = (
        F.col("__n").cast("decimal(19,0)") * F.col("__squares").cast("decimal(19,0)")
    ).cast(wide) - (
        F.col("__total").cast("decimal(19,0)") * F.col("__total").cast("decimal(19,0)")
    ).cast(wide)
    return totals.select(
        *keys,
        F.when(n == 0, 0.0).otherwise(F.try_divide(F.col("__dark").cast("double"), n)).alias("dark"),
        F.when(n == 0, 255.0).otherwise(F.try_divide(F.col("__total").cast("double"), n)).alias("mean"),
        F.when(n == 0, 0.0)
        .otherwise(F.try_divide(F.sqrt(spread.cast("double")), n))
        .alias("std"),
    )


def is_blank_page(sensitivity: str = "normal") -> Column:
    """Predicate over the columns of ``luma_stats``; unknown names mean normal."""
    share = BLANK_SHARE.get(sensitivity, BLANK_SHARE["normal"])
    flat = (F.col("std") < FLAT_STD) & (F.col("mean") > FLAT_MEAN)
    return (F.col("dark") < share) | flat


def blank_pages(stats: DataFrame, sensitivity: str = "normal") -> DataFrame:
    return stats.withColumn("blank", is_blank_page(sensitivity))


def drop_blank(
    pages: DataFrame,
    blanks: DataFrame,
    spared: DataFrame,
    keys: Sequence[str] = ("doc_id", "uid", "page"),
    doc: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """Pages without the blank ones the reviewer did not spare; emptied documents are refused."""
    going = blanks.select(*keys).join(spared.select(*keys), list(keys), "left_anti")
    kept = pages.join(going, list(keys), "left_anti")
    emptied = (
        pages.select(doc).distinct().join(kept.select(doc).distinct(), doc, "left_anti")
    )
    return kept, emptied.withColumn("error", F.lit("DELETE_ALL"))


def pixel_diff(
    a: DataFrame,
    b: DataFrame,
    keys: Sequence[str] = ("doc_id", "page"),
    strip: Sequence[str] = ("y", "chunk"),
) -> DataFrame:
    """(keys, changed, changed_percent) of two renderings of the same pages.

    Rows are strips of one pixel line: (keys, y, chunk, w, h, pixels) with
    0xRRGGBB values and the page size. The smaller page counts as white where it
    ends: missing strips and missing tails of a strip are white.
    """
    on = [*keys, *strip]
    left = a.select(*on, F.col("pixels").alias("__a"), F.col("w").alias("__aw"), F.col("h").alias("__ah"))
    right = b.select(*on, F.col("pixels").alias("__b"), F.col("w").alias("__bw"), F.col("h").alias("__bh"))
    nothing = F.array().cast("array<int>")

    def channel(p: Column, shift: int) -> Column:
        return F.shiftright(p, shift).bitwiseAND(255)

    def changed(x: Column, y: Column) -> Column:
        p, q = F.coalesce(x, F.lit(WHITE)), F.coalesce(y, F.lit(WHITE))
        gap = None
        for shift in (16, 8, 0):
            step = F.abs(channel(p, shift) - channel(q, shift))
            gap = step if gap is None else gap + step
        return gap > DIFF_LIMIT

    pairs = left.join(right, on, "full_outer").select(
        *keys,
        F.explode_outer(F.arrays_zip(F.coalesce("__a", nothing), F.coalesce("__b", nothing))).alias("__p"),
        F.greatest("__aw", "__bw").alias("__w"),
        F.greatest("__ah", "__bh").alias("__h"),
    )
    totals = pairs.groupBy(*keys).agg(
        F.count_if(F.col("__p").isNotNull() & changed(F.col("__p.0"), F.col("__p.1"))).alias("changed"),
        (F.max("__w").cast("bigint") * F.max("__h").cast("bigint")).alias("__area"),
    )
    percent = F.try_divide(F.col("changed").cast("double"), F.col("__area")) * 100
    return totals.select(*keys, "changed", percent.alias("changed_percent"))


def compare_docs(a: DataFrame, b: DataFrame, diff: DataFrame | None = None) -> DataFrame:
    """Pages of two versions by number: (doc_id, page, side, same_text, changed_percent).

    ``side`` is both, a or b. Only pages on both sides are compared; ``diff`` is
    the output of ``pixel_diff`` where pixels exist.
    """
    # digests travel instead of texts
    left = a.select("doc_id", "page", F.sha2("text", 256).alias("__a"), F.lit(True).alias("__in_a"))
    right = b.select("doc_id", "page", F.sha2("text", 256).alias("__b"), F.lit(True).alias("__in_b"))
    paired = left.join(right, ["doc_id", "page"], "full_outer")
    side = (
        F.when(F.col("__in_a").isNull(), "b").when(F.col("__in_b").isNull(), "a").otherwise("both")
    )
    paired = paired.select(
        "doc_id",
        "page",
        side.alias("side"),
        F.when(side == "both", F.col("__a").eqNullSafe(F.col("__b"))).alias("same_text"),
    )
    if diff is None:
        return paired.withColumn("changed_percent", F.lit(None).cast("float"))
    return paired.join(diff, ["doc_id", "page"], "left").select(
        "doc_id",
        "page",
        "side",
        "same_text",
        F.when(F.col("side") == "both", F.col("changed_percent")).cast("float").alias("changed_percent"),
    )


def page_count_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, a_pages, b_pages, mismatch) of two versions."""
    left = a.groupBy("doc_id").agg(F.max("page").alias("a_pages"))
    right = b.groupBy("doc_id").agg(F.max("page").alias("b_pages"))
    zero = F.lit(0)
    return left.join(right, "doc_id", "full_outer").select(
        "doc_id",
        F.coalesce("a_pages", zero).alias("a_pages"),
        F.coalesce("b_pages", zero).alias("b_pages"),
        (F.coalesce("a_pages", zero) != F.coalesce("b_pages", zero)).alias("mismatch"),
    )


def fit_dpi(budget: Column, probe_bytes: Column, max_dpi: int) -> Column:
    """Resolution expected to meet the budget, from one probe rendering."""
    probe = max(min(max_dpi, 150), 50)
    scale = F.sqrt(budget.cast("double") * 0.9 / F.nullif(probe_bytes, F.lit(0)).cast("double"))
    estimate = F.floor(F.lit(float(probe)) * scale + 0.5).cast("bigint")
    clamped = F.least(F.greatest(estimate, F.lit(min(150, max_dpi))), F.lit(max_dpi))
    return F.when(probe_bytes == 0, F.lit(probe)).otherwise(clamped).cast("int")


def pick_quality(
    variants: DataFrame,
    targets: DataFrame,
    cap: int,
    floor: int = QUALITY_FLOOR,
    probe_quality: int | None = None,
    max_dpi: int = 300,
) -> DataFrame:
    """(doc_id, page, budget, dpi, quality): best rendering that fits the page budget.

    ``variants`` is (doc_id, page, quality, bytes), ``targets`` (doc_id,
    target_bytes). The highest quality within ``floor``..``cap`` whose size fits
    wins, otherwise ``floor``. ``dpi`` follows the bytes of ``probe_quality``
    (``cap`` by default) and is null where that variant is missing.
    """
    probe = cap if probe_quality is None else probe_quality
    pages = variants.groupBy("doc_id").agg(F.count_distinct("page").alias("__pages"))
    budgets = targets.join(pages, "doc_id").select(
        "doc_id",
        F.greatest(
            F.floor(F.col("target_bytes") / F.col("__pages")), F.lit(MIN_PAGE_BUDGET)
        ).cast("bigint").alias("budget"),
    )
    fits = (
        (F.col("bytes") <= F.col("budget"))
        & (F.col("quality") <= cap)
        & ((F.col("quality") >= floor) | (F.col("quality") == cap))
    )
    chosen = (
        variants.join(budgets, "doc_id")
        .groupBy("doc_id", "page", "budget")
        .agg(
            F.max(F.when(fits, F.col("quality"))).alias("__best"),
            F.max(F.when(F.col("quality") == probe, F.col("bytes"))).alias("__probe"),
        )
    )
    return chosen.select(
        "doc_id",
        "page",
        "budget",
        fit_dpi(F.col("budget"), F.col("__probe"), max_dpi).alias("dpi"),
        F.coalesce(F.col("__best"), F.lit(floor)).cast("int").alias("quality"),
    )


def pick_version(candidates: DataFrame) -> DataFrame:
    """Add ``chosen``: original, rewrite, lossless or lossy.

    ``candidates`` is (spec, n, in_bytes, out_bytes, target_bytes). Without a
    target a whole-file rewrite that is not smaller loses to the original. A
    target of at least half the input tries the rewrite before lossy work.
    """
    grew = (F.col("in_bytes") > 0) & (F.col("out_bytes") >= F.col("in_bytes"))
    plain = F.when(is_full_range("spec", "n") & grew, "original").otherwise("rewrite")
    mild = (F.col("in_bytes") > 0) & (F.col("target_bytes") >= F.col("in_bytes") * 0.5)
    enough = (F.col("out_bytes") <= F.col("target_bytes")) & (F.col("out_bytes") < F.col("in_bytes"))
    aimed = F.when(mild & enough, "lossless").otherwise("lossy")
    return candidates.withColumn(
        "chosen", F.when(F.col("target_bytes").isNull(), plain).otherwise(aimed)
    )


def size_estimate(files: DataFrame, tool: str = "tool", size: str = "size", free: Column | None = None) -> DataFrame:
    """(tool, bytes, sufficient): working space each tool needs for its files."""
    factor = F.lit(OTHER_MULTIPLIER)
    for name, value in MULTIPLIER.items():
        factor = F.when(F.col(tool) == name, value).otherwise(factor)
    out = files.groupBy(tool).agg(F.sum(size).alias("__sum"))
    need = F.ceil(F.col("__sum") * factor).cast("bigint")
    enough = (F.lit(None).cast("boolean") if free is None else free >= F.col("bytes"))
    return out.select(tool, need.alias("bytes")).withColumn("sufficient", enough)


def validate_docs(
    docs: DataFrame,
    annots: DataFrame,
    max_objects: int = MAX_OBJECTS,
    max_chars: int = MAX_TEXT_CHARS,
    max_points: int = MAX_INK_POINTS,
) -> DataFrame:
    """(doc_id, reason): the first broken rule of each annotation document, or null.

    ``docs`` is (doc_id, version), ``annots`` (doc_id, ord, kind, content,
    n_points).
    """
    broken = F.when(
        (F.col("kind") == "text") & (F.length("content") > max_chars), "TEXT_TOO_LONG"
    ).when((F.col("kind") == "ink") & (F.col("n_points") > max_points), "INK_TOO_LONG")
    checked = annots.select("doc_id", "ord", broken.alias("__broken"))
    found = checked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("__n"),
        F.min_by("__broken", F.when(F.col("__broken").isNotNull(), F.col("ord"))).alias("__first"),
    )
    reason = (
        F.when(F.col("version") != EDIT_VERSION, "BAD_EDIT")
        .when(F.coalesce(F.col("__n"), F.lit(0)) == 0, "NO_EDITS")
        .when(F.col("__n") > max_objects, "TOO_MANY_OBJECTS")
        .otherwise(F.col("__first"))
    )
    return docs.join(found, "doc_id", "left").select("doc_id", reason.alias("reason"))
