"""Phrase search over page text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import INNER_SPACE
from quire.plans.scan import scan_numbers
from quire.session import shared_folder

BEFORE = 40
AFTER = 60


def _usable(phrases: Sequence[str], min_chars: int) -> list[str]:
    """Trimmed phrases of at least ``min_chars`` characters, once each; blank ones find nothing."""
    return list(dict.fromkeys(p.strip() for p in phrases if len(p.strip()) >= max(1, min_chars)))


def _hits(pages: DataFrame, phrases: Sequence[str], case_sensitive: bool, min_chars: int, opening: str | None = None) -> DataFrame:
    """One row per page and phrase found on it: a scan with no join or shuffle.

    With ``opening``, the first page of each document has one more row, without a phrase, whatever is found on it.
    """
    wanted = _usable(phrases, min_chars)
    text = F.col("text") if case_sensitive else F.lower("text")
    if not wanted and opening is None:
        return pages.withColumn("query", F.lit(None).cast("string")).filter(F.lit(False))

    def needle(q: Column) -> Column:
        return q if case_sensitive else F.lower(q)

    found = F.filter(
        F.array(*[F.lit(p) for p in wanted]).cast("array<string>"),
        lambda q: F.contains(F.col("__searched"), needle(q)),
    )
    if opening is not None:
        none = F.array(F.lit(None).cast("string"))
        found = F.coalesce(found, F.array().cast("array<string>"))
        found = F.when(F.col(opening) == 1, F.concat(found, none)).otherwise(found)
    return (
        pages.withColumn("__searched", text)
        .withColumn("query", F.explode(found))
        .drop("__searched")
    )


def search(pages: DataFrame, phrases: Sequence[str], min_chars: int = 1) -> DataFrame:
    """Every (page row, query) where the page contains the query in any case."""
    return _hits(pages, phrases, False, min_chars)


def search_snippets(
    pages: DataFrame,
    phrases: Sequence[str],
    case_sensitive: bool = False,
    limit: int | None = None,
    key: str = "doc_id",
    order: str = "page",
    min_chars: int = 1,
) -> DataFrame:
    """First hit of each page with its surroundings, numbered by page within a document and query.

    ``limit`` keeps the first pages of each document and query; without it every hit is kept.
    """
    short = _shown(_hits(pages, phrases, case_sensitive, min_chars), case_sensitive)
    return _numbered(short, key, order, limit)


def snippets_and_counts(
    pages: DataFrame, phrases: Sequence[str], case_sensitive: bool = False, key: str = "doc_id", order: str = "page", min_chars: int = 1
) -> tuple[DataFrame, DataFrame]:
    """The snippets of ``search_snippets``, and the columns of each document's first page: the text is read once for both."""
    short = _shown(_hits(pages, phrases, case_sensitive, min_chars, order), case_sensitive)
    place = shared_folder(pages.sparkSession, "hits")
    short.write.parquet(place)
    short = pages.sparkSession.read.parquet(place)
    firsts = short.filter(F.col("query").isNull()).select(*[c for c in pages.columns if c != "text"])
    return _numbered(short.filter(F.col("query").isNotNull()), key, order, None), firsts


def _shown(hits: DataFrame, case_sensitive: bool) -> DataFrame:
    """Hits with the text around them in place of the page; what moves later is this, never the page."""
    text = F.col("text") if case_sensitive else F.lower("text")
    needle = F.col("query") if case_sensitive else F.lower("query")
    # 1-based place of the match and of the first character shown before it
    hits = hits.withColumn("__at", F.instr(text, needle))
    hits = hits.withColumn("__from", F.greatest(F.col("__at") - BEFORE, F.lit(1)))
    size = F.length("query")
    return hits.select(
        *[c for c in hits.columns if c not in ("text", "query", "__at", "__from")],
        "query",
        (F.col("__from") > 1).alias("__cut"),
        F.substring(F.col("text"), F.col("__from"), F.col("__at") - F.col("__from")).alias("__lead"),
        F.substring(F.col("text"), F.col("__at"), size).alias("match"),
        F.substring(F.col("text"), F.col("__at") + size, F.lit(AFTER)).alias("__tail"),
    )


def _numbered(short: DataFrame, key: str, order: str, limit: int | None) -> DataFrame:
    rest = [c for c in short.columns if c not in ("query", "__cut", "__lead", "match", "__tail")]
    first = scan_numbers(short, ["query", key], order, "hit_no")
    if limit is not None:
        first = first.filter(F.col("hit_no") <= limit)

    def squeeze(value: Column) -> Column:
        return F.regexp_replace(value, INNER_SPACE, " ")

    return first.select(
        *rest,
        "query",
        "hit_no",
        F.concat(F.when(F.col("__cut"), "…").otherwise(""), squeeze(F.col("__lead"))).alias("before"),
        "match",
        F.concat(squeeze(F.col("__tail")), F.lit("…")).alias("after"),
    )
