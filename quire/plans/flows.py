"""Whole jobs built from the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.assemble import combine, split_every
from quire.operators.labels import page_label
from quire.operators.quality import drop_blank, is_blank_page, luma_stats
from quire.operators.search import snippets_and_counts
from quire.operators.text import effective_text, head, page_count, split_pages
from quire.plans.scan import scan_sums


def search_corpus(
    documents: DataFrame,
    phrases: Sequence[str],
    sep: str = "\f",
    ocr: DataFrame | None = None,
    prefix: str = "",
    pad: int = 6,
    library: str = "source",
    max_bytes: int | None = None,
) -> DataFrame:
    """Hits of phrases over a corpus: page, snippet and a running page label.

    ``documents`` is (doc_id, text, library). Pages are numbered through all
    documents of a library in document order, as if they were one volume.
    Phrases are looked for where the text is read, so only hits move, and a label
    is the number of pages before the document plus the page: no page rows are
    made for it. The text is read once, for hits and page counts. ``max_bytes``
    cuts each text before its pages are made.
    """
    known = documents.select("doc_id", library, head(F.col("text"), max_bytes).alias("text"), page_count(F.col("text"), sep).alias("page_count"))
    pages = split_pages(known, sep=sep, keep=[library, "page_count"])
    if ocr is not None:
        pages = effective_text(pages, ocr)
    hits, counted = snippets_and_counts(pages, phrases)
    if max_bytes is not None:  # a text may be cut before its first page ends
        counted = known.filter(F.col("page_count") > 0)
    before = scan_sums(counted.select("doc_id", library, "page_count"), [library], "doc_id", {"__before": F.col("page_count")})
    labelled = hits.drop(library, "page_count").join(before.select("doc_id", library, "__before"), "doc_id")
    number = F.col("__before") + F.col("page")
    return labelled.withColumn("label", page_label(number, prefix, pad)).drop("__before")


def remove_blank_pages(
    pages: DataFrame, tiles: DataFrame, spared: DataFrame, sensitivity: str = "normal"
) -> tuple[DataFrame, DataFrame]:
    """Pages (doc_id, uid, page) without blank ones, from their gray tiles."""
    keys = ["doc_id", "uid", "page"]
    blanks = luma_stats(tiles, keys).filter(is_blank_page(sensitivity))
    return drop_blank(pages, blanks, spared, keys)


def split_combined(files: DataFrame, n: int, stem: Column) -> DataFrame:
    """Combine files and cut the result into parts of n pages; no shuffle after the page rows."""
    return split_every(combine(files), n, stem)
