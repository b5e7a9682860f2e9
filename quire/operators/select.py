"""Page selection: page lists, deletion, extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.ranges import lenient_segments, spec_segments
from quire.plans.blocks import ORDER_BITS, clip, number_units, prefix_sums, range_join, run_numbers


def page_runs(
    df: DataFrame, keys: Sequence[str], page: str, order: str, bits: int = ORDER_BITS
) -> DataFrame:
    """(keys, run, start, end): stretches where each page is one more than the last."""
    src = df.select(*keys, F.col(order).alias("__ord"), F.col(page).alias("__page"))
    numbered = run_numbers(
        src,
        keys,
        "__ord",
        ["__page"],
        lambda prev, cur: cur["__page"] != prev["__page"] + 1,
        "run",
        bits,
    )
    return numbered.groupBy(*keys, "run").agg(
        F.min_by("__page", "__ord").alias("start"), F.max_by("__page", "__ord").alias("end")
    )


def format_ranges(
    df: DataFrame,
    keys: Sequence[str],
    page: str,
    order: str | None = None,
    bits: int = ORDER_BITS,
) -> DataFrame:
    """(keys, run, spec): "1", "3-4", "6", one row for each run, numbered from 1; runs keep the input order.

    The runs of one key joined by commas are its whole spec.
    """
    runs = page_runs(df, keys, page, order or page, bits)
    text = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(
        F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))
    )
    return runs.select(*keys, "run", text.alias("spec"))


def delete_pages(
    pages: DataFrame, removals: DataFrame, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """Pages not named by the document's lenient ``spec``, and the refused documents.

    A broken spec is INVALID_PAGES, a spec that would remove everything is
    DELETE_ALL; such documents give no pages.
    """
    parsed = removals.select(key, lenient_segments("spec").alias("__s"))
    broken = parsed.filter(F.col("__s.error").isNotNull()).select(
        key, F.col("__s.error").alias("error")
    )
    segments = (
        parsed.select(key, F.explode("__s.segments").alias("__g"))
        .select(key, F.col("__g.lo").alias("__lo"), F.col("__g.hi").alias("__hi"))
    )
    segments = clip(segments, pages, [key], "page", "__hi")
    sound = pages.join(broken.select(key), key, "left_anti")
    kept = range_join(sound, segments, [key], "page", "__lo", "__hi", "left_anti")
    emptied = (
        sound.join(removals.select(key).distinct(), key, "left_semi")
        .select(key)
        .distinct()
        .join(kept.select(key).distinct(), key, "left_anti")
        .select(key, F.lit("DELETE_ALL").alias("error"))
    )
    return kept, broken.unionByName(emptied)


def extract_pages(
    pages: DataFrame, specs: DataFrame, key: str = "doc_id"
) -> tuple[DataFrame, DataFrame]:
    """Pages of each ordered spec with their ``position``, and the refused specs.

    ``specs`` is (key, spec, n). Ranges stay folded: a segment meets its pages by
    block, so "1-z" over a huge document costs one row per block.
    """
    parsed = specs.select(key, spec_segments("spec", "n").alias("__s"))
    errors = parsed.filter(F.col("__s.error").isNotNull()).select(
        key, F.col("__s.error").alias("error")
    )
    segments = parsed.select(key, F.posexplode("__s.segments").alias("__no", "__g"))
    segments = segments.select(
        key, "__no", F.col("__g.lo").alias("__lo"), F.col("__g.hi").alias("__hi")
    )
    length = F.abs(F.col("__hi") - F.col("__lo")) + 1
    placed = prefix_sums(segments, [key], "__no", {"__offset": length}).select(
        key,
        "__offset",
        F.col("__lo").alias("__first"),
        F.least("__lo", "__hi").alias("__a"),
        F.greatest("__lo", "__hi").alias("__b"),
    )
    joined = range_join(pages, placed, [key], "page", "__a", "__b")
    position = F.col("__offset") + F.abs(F.col("page") - F.col("__first")) + 1
    return joined.select(*pages.columns, position.alias("position")), errors


def listed_pages(specs: DataFrame, segments: str = "segments", bits: int = 16) -> DataFrame:
    """One row (item, page) for each page of folded segments, in their order, for specs of any size.

    ``specs`` holds an array of (lo, hi) per row, lo > hi counting down; null gives no
    rows. Rows are made in two steps with a shuffle between, as in ``number_units``.
    """
    rest = [c for c in specs.columns if c != segments]
    count = F.transform(segments, lambda s: F.abs(s["hi"] - s["lo"]) + 1)
    before = F.aggregate(count, F.array(F.lit(0).cast("bigint")), lambda done, n: F.array_append(done, F.element_at(done, -1) + n))
    before = F.slice(before, 1, F.size(count))
    placed = F.arrays_zip(F.col(segments).alias("s"), count.alias("n"), before.alias("b"))
    flat = specs.select(*rest, F.explode(placed).alias("__p")).select(
        *rest, F.col("__p.s.lo").alias("__lo"), F.col("__p.s.hi").alias("__hi"), F.col("__p.n").alias("__n"), F.col("__p.b").alias("__b")
    )
    numbered = number_units(flat, ["__lo", "__b"], "__n", "__k", bits)
    step = F.when(F.col("__lo") <= F.col("__hi"), F.col("__k") - 1).otherwise(1 - F.col("__k"))
    return numbered.select(*rest, (F.col("__b") + F.col("__k")).alias("item"), (F.col("__lo") + step).alias("page"))
