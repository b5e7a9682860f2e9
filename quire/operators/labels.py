"""Numbering, layer order and recent jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.assemble import shifted
from quire.plans.moves import item_shifts
from quire.plans.moves import shifted as shifted_items
from quire.plans.scan import scan_numbers
from quire.session import shared_folder

RECENT = 25
SHOWN_ON_HOME = 6


def page_label(number: Column, prefix: str = "", pad: int = 0, date: Column | None = None) -> Column:
    """Prefix, zero-padded number, optional date. A wide number is never cut."""
    digits = F.format_string(f"%0{pad}d", number) if pad > 0 else number.cast("string")
    label = F.concat(F.lit(prefix), digits)
    if date is not None:
        label = F.concat(label, F.lit(" – "), F.date_format(date, "dd.MM.yyyy"))
    return label


def bates(
    pages: DataFrame, start: int = 1, prefix: str = "", pad: int = 0, date: Column | None = None, pos: str = "pos"
) -> DataFrame:
    """Add ``label``. Numbers follow ``pos``, so no window is needed."""
    number = F.col(pos).cast("bigint") + F.lit(start - 1).cast("bigint")
    return pages.withColumn("label", page_label(number, prefix, pad, date))


def z_order(annots: DataFrame, moves: DataFrame, block_moves: int | None = None) -> DataFrame:
    """Move annotations among the annotations of their page.

    ``annots`` is (doc_id, page_index, id, ord, ...), ``moves`` (doc_id, id, dir)
    with front, back, forward or backward and, where a page has several, ``seq``:
    they are applied in that order. ``ord`` comes back as the 1-based layer on the
    page, later layers in front. Moves of a page are replayed in blocks, each a map
    of stretches, see ``quire.plans.moves``.
    """
    spark, page = annots.sparkSession, ["doc_id", "page_index"]
    order = "seq" if "seq" in moves.columns else "__order"
    numbered = scan_numbers(annots, page, "ord", "__pos")
    sizes = numbered.groupBy(*page).agg(F.max("__pos").alias("n"))
    places = numbered.select(*page, "id", (F.col("__pos") - 1).alias("src"))
    moving = moves.withColumn("__order", F.struct("id", "dir")).join(places, ["doc_id", "id"]).join(sizes, page)
    place = shared_folder(spark, "moves")
    scan_numbers(moving.select(*page, order, "src", "dir", "n"), page, order, "no").write.parquet(place)
    moving = spark.read.parquet(place)
    most = moving.agg(F.max("no")).first()[0] or 0
    rest = [c for c in annots.columns if c != "ord"]
    if most > 1:
        maps = item_shifts(moving, page, most, block_moves)
        layered = shifted_items(numbered.select(*rest, "__pos"), maps, page, "__pos", first=1)
    else:
        last = F.col("n") - 1
        wanted = F.when(F.col("dir") == "backward", F.col("src") - 1).when(F.col("dir") == "forward", F.col("src") + 1).when(F.col("dir") == "back", 0).otherwise(last)
        single = moving.select(*page, (F.col("src") + 1).alias("__src"), (F.least(F.greatest(wanted, F.lit(0)), last) + 1).alias("__dst"))
        at = F.when(F.col("__src").isNull(), F.col("__pos")).otherwise(shifted(F.col("__pos"), F.col("__src"), F.col("__dst")))
        layered = numbered.join(single, page, "left").select(*rest, at.alias("__pos"))
    return layered.select(*[c if c != "ord" else F.col("__pos").alias("ord") for c in annots.columns])


def recent_jobs(
    jobs: DataFrame, k: int = RECENT, job_id: str = "id", finished: str = "finished_at", seq: str | None = None
) -> DataFrame:
    """One row per job, the newest wins; newest first, at most ``k``."""
    when = F.struct(finished, seq) if seq else F.col(finished)
    latest = jobs.groupBy(job_id).agg(
        F.max_by(F.struct(*[c for c in jobs.columns if c != job_id]), when).alias("__job")
    )
    rows = latest.select(job_id, "__job.*")
    order = [F.col(finished).desc()] + ([F.col(seq).desc()] if seq else [])
    return rows.orderBy(*order, F.col(job_id)).limit(k)
