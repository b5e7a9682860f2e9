"""Outlines: a bookmark tree as ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.climb import climb
from quire.plans.scan import scan_numbers


def outline(
    nodes: DataFrame, page_ids: DataFrame, limit: int | None = None
) -> DataFrame:
    """(doc_id, item_no, title, page, level) in reading order, level from 0.

    ``nodes`` is (doc_id, node, parent, sibling_no, title, target), top nodes
    without parent; ``page_ids`` (doc_id, target, page). Blank titles vanish but
    their children stay; an unknown target leaves the page null. Equal sibling
    numbers are ordered by node. Nodes of a cycle, or below a missing parent, hang
    on no top node and give no rows. ``limit`` keeps the first items of each document.

    The path of a node is joined up by pointer doubling, so 130 levels take eight
    rounds, and items are numbered by a scan over ranges of paths: one document may
    hold most items.
    """
    step = F.array(F.struct(F.col("sibling_no").alias("sibling_no"), F.col("node").alias("node")))
    paths = climb(nodes, {"path": (step, lambda own, above: F.concat(above, own))})
    edge = r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$"
    title = F.regexp_replace(F.coalesce("title", F.lit("")), edge, "")
    titled = nodes.select("doc_id", "node", title.alias("title"), "target").filter(F.col("title") != "")
    placed = titled.join(paths.filter("rooted").select("doc_id", "node", "path"), ["doc_id", "node"])
    items = scan_numbers(placed, ["doc_id"], "path", "item_no")
    if limit is not None:
        items = items.filter(F.col("item_no") <= limit)
    return items.join(page_ids, ["doc_id", "target"], "left").select(
        "doc_id", F.col("item_no").cast("int").alias("item_no"), "title", "page", (F.size("path") - 1).alias("level")
    )
