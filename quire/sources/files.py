"""File catalogue, intake and output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.paths import basename, classify_file, join_path
from quire.plans.blocks import ORDER_BITS, range_join, row_numbers
from quire.plans.scan import scan_numbers
from quire.sources.listing import FileListing


def catalogue(files: DataFrame, page_counts: DataFrame | None = None) -> DataFrame:
    """(path, name, size, page_count, is_valid) from (path, length).

    A file is valid when it is called .pdf and its page count is known; nothing
    here fails on an unreadable one.
    """
    if page_counts is None:
        counted = files.withColumn("page_count", F.lit(None).cast("int"))
    else:
        counted = files.join(page_counts.select("path", "page_count"), "path", "left")
    is_pdf = F.lower("path").endswith(".pdf")
    count = F.when(is_pdf, F.col("page_count").cast("int"))
    return counted.select(
        "path",
        basename("path").alias("name"),
        F.col("length").cast("bigint").alias("size"),
        count.alias("page_count"),
        count.isNotNull().alias("is_valid"),
    )


def scan_files(
    spark: SparkSession, path: str, page_counts: DataFrame | None = None, pattern: str = "*"
) -> DataFrame:
    """Catalogue of a folder tree, empty and hidden files included. Files are never opened.

    ``pattern`` is matched against names, * and ? standing for any characters.
    """
    spark.dataSource.register(FileListing)
    return catalogue(spark.read.format("file_listing").option("pattern", pattern).load(path), page_counts)


def conversions(incoming: DataFrame) -> DataFrame:
    """Image paths to convert, once each however often they were added."""
    return incoming.filter(classify_file("path") == "image").select("path").dropDuplicates(["path"])


def intake(
    incoming: DataFrame,
    existing: DataFrame,
    info: DataFrame,
    first_uid: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Add a batch of paths to a workspace: (added, report, rejected).

    ``incoming`` is (seq, path) with unique seq, ``existing`` (path, ...),
    ``info`` (path, is_valid, error) as found by reading or converting each path.
    A PDF that was loaded before this batch is skipped; the same PDF twice in
    one batch, images and office files are added each time. The report is one
    row of counts; every path that was not added is a row of ``rejected``.
    """
    loaded = existing.select("path").distinct().withColumn("__loaded", F.lit(True))
    facts = info.select("path", F.col("is_valid").alias("__ok"), F.col("error").alias("__error"))
    kind = classify_file("path")
    judged = (
        incoming.select("seq", "path", kind.alias("kind"))
        .join(loaded, "path", "left")
        .join(facts, "path", "left")
    )
    outcome = (
        F.when(F.col("kind") == "unsupported", "unsupported")
        .when((F.col("kind") == "pdf") & F.col("__loaded").isNotNull(), "already_loaded")
        .when(F.col("__error").isNotNull(), "error")
        .when(~F.coalesce(F.col("__ok"), F.col("kind") != "pdf"), "invalid")
        .otherwise("added")
    )
    judged = judged.withColumn("outcome", outcome)
    added = scan_numbers(judged.filter(F.col("outcome") == "added").select("seq", "path", "kind"), [], "seq", "__no").select(
        "seq",
        "path",
        "kind",
        F.concat(F.lit("f"), (F.col("__no") + (first_uid - 1)).cast("string")).alias("uid"),
    )

    def counted(name: str) -> Column:
        return F.count_if(F.col("outcome") == name)

    report = judged.agg(
        counted("added").alias("added"),
        counted("invalid").alias("invalid"),
        counted("error").alias("errors"),
        counted("already_loaded").alias("already_loaded"),
        (counted("unsupported") > 0).alias("not_pdf"),
    )
    rejected = judged.filter(F.col("outcome") != "added").select(
        "seq",
        "path",
        basename("path").alias("name"),
        "outcome",
        F.when(F.col("outcome") == "error", F.concat_ws(": ", basename("path"), F.col("__error"))).alias("message"),
    )
    return added, report, rejected


def name_outputs(
    inputs: DataFrame,
    ext: str = "pdf",
    existing: DataFrame | None = None,
    bits: int = ORDER_BITS,
) -> DataFrame:
    """Add ``output_path`` to (seq, dir, stem, ...): stem.pdf, stem (2).pdf, ...

    The first input with a stem keeps it, later ones take the next free number.
    A number is free when no input is literally called "stem (k)" and, with
    ``existing`` (dir, stem), no such file is there. Numbers come from block-wise
    counts and ranges of taken numbers, so a stem shared by most inputs is still
    spread over many tasks.
    """
    numbered = row_numbers(inputs, ["dir", "stem"], "seq", "__no", bits)

    keys = ["dir", "stem"]
    tops = inputs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__top")).filter(F.col("__top") > 1)

    shape = r"(?s)^(.*) \(([1-9][0-9]{0,17})\)$"
    names = inputs.select("dir", "stem")
    if existing is not None:
        names = names.unionByName(existing.select("dir", "stem"))
    taken = (
        names.filter(F.col("stem").rlike(shape))
        .select(
            "dir",
            F.regexp_extract("stem", shape, 1).alias("stem"),
            F.regexp_extract("stem", shape, 2).cast("bigint").alias("__k"),
        )
        .filter(F.col("__k") >= 2)
        .distinct()
    )
    # the r-th taken number k pushes every repeat from the (k - r)-th on to r places later
    ranked = row_numbers(taken, keys, "__k", "__r", bits).select(
        *keys, "__r", (F.col("__k") - F.col("__r")).alias("__lo")
    )
    after = ranked.select(*keys, (F.col("__r") - 1).alias("__r"), F.col("__lo").alias("__next"))
    pushes = (
        ranked.join(tops, keys)
        .join(after, [*keys, "__r"], "left")
        .withColumn("__hi", F.coalesce(F.col("__next") - 1, F.col("__top")))
        .withColumn("__hi", F.least("__hi", "__top"))
        .select(*keys, "__lo", "__hi", F.col("__r").alias("__shift"))
    )
    repeats = numbered.withColumn("__repeat", F.col("__no") - 1)
    named = range_join(repeats, pushes, keys, "__repeat", "__lo", "__hi", "left")
    number = F.col("__no") + F.coalesce(F.col("__shift"), F.lit(0))
    name = F.when(F.col("__no") == 1, F.col("stem")).otherwise(
        F.concat(F.col("stem"), F.lit(" ("), number.cast("string"), F.lit(")"))
    )
    return named.select(
        *inputs.columns,
        join_path("dir", F.concat(name, F.lit(f".{ext}"))).alias("output_path"),
    )


def page_image_name(pos: Column) -> Column:
    """page-001, page-002, ..."""
    return F.format_string("page-%03d", pos)
