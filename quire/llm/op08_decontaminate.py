"""Benchmark decontamination: a broadcast hash set of the items' word windows, probed by the windows of every text.

Words are runs of letters, digits and all characters beyond ASCII; A-Z count as a-z. A window is ``n`` consecutive
words of an item; an item with fewer words, but not none, is one window. All steps are built-in column functions:
texts are cut into words once, their windows are generated inside one code-generated stage, and only windows that hit
leave it.

Edge cases: a null or wordless text has no window and is clean; a null or wordless item has none either; repeated rows
get the same result each; an item repeated under one id counts once, items without id mark words but are not counted.
Other columns are kept; names that clash with result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most bytes of window text in one broadcast set; more items are probed in several sets, one pass over the texts each.
SET_BYTES = 48 << 20


def cut_words(text: Column) -> Column:
    """Lower-cased words of a text; null for null."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), APART), "")


def item_windows(items: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(size, words, hash, item): the windows of every item."""
    cut = items.select(F.col(item_id).cast("string").alias("item"), cut_words(F.col(text)).alias("all")).filter(
        F.size("all") > 0
    )
    size = F.least(F.lit(n), F.size("all"))
    placed = cut.select("item", "all", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("all") - size + 1)).alias("at"))
    return placed.select("item", "size", F.slice("all", F.col("at"), F.col("size")).alias("words")).withColumn(
        "hash", F.xxhash64("words")  # the same as the hash of its words in turn
    )


def _probe(cut: DataFrame, sets: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(__text, n_words, at, size, words, hash): places of windows that are in the set, and one row for each text.

    Words are generated as places only, with the array beside them, and windows are hashed where they stand, all in
    one code-generated stage; what leaves it are hits and the first place of each text.
    """
    placed = cut.select("__text", "__words", F.size("__words").alias("n_words"), F.posexplode_outer("__words").alias("at", "__word"))
    out = None
    for size in sizes or [1]:
        key = F.when(F.col("at") + size <= F.col("n_words"), F.xxhash64(*[F.get("__words", F.col("at") + k) for k in range(size)]))
        of_size = sets.filter(F.col("size") == size).select("hash", "words", F.col("size"))
        same = (F.col("__key") == F.col("hash")) & (F.slice("__words", F.col("at") + 1, size) == F.col("words"))
        found = placed.withColumn("__key", key).join(F.broadcast(of_size), same, "left")
        found = found.filter("hash IS NOT NULL OR coalesce(at, 0) = 0")
        found = found.select("__text", F.greatest("n_words", F.lit(0)).alias("n_words"), "at", "size", "words", "hash")
        out = found if out is None else out.unionByName(found)
    return out


def hits(documents: DataFrame, items: DataFrame, n: int = 10, text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """(__text, n_words, at, size, words, hash): every place where an item's window stands, and each text's first place.

    ``__text`` is the MD5 of the text. The rows are written to the shared folder once, so texts are read once.
    """
    spark = documents.sparkSession
    windows = item_windows(items, n).select("size", "words", "hash").distinct()
    bytes_of = F.sum(F.length(F.array_join("words", " ")) * 4 + 48)
    sizes = {r["size"]: r["b"] for r in windows.groupBy("size").agg(bytes_of.alias("b")).collect()}  # n rows at most
    cut = documents.select(F.md5(text).alias("__text"), cut_words(F.col(text)).alias("__words"))
    path = shared_folder(spark, "windows")
    blocks = max(1, -(-int(sum(sizes.values())) // set_bytes))
    for block in range(blocks):
        part = windows if blocks == 1 else windows.filter(F.pmod("hash", F.lit(blocks)) == block)
        _probe(cut, part, sorted(sizes)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _covered(spans: Column) -> Column:
    """Number of words below any of the sorted spans (at, size)."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        spans, start,
        lambda s, x: F.struct(
            F.greatest(s["to"], x["at"] + x["size"]).alias("to"),
            (s["sum"] + F.greatest(F.lit(0), x["at"] + x["size"] - F.greatest(s["to"], x["at"]))).alias("sum"),
        ),
        lambda s: s["sum"],
    )


def mark(documents: DataFrame, items: DataFrame, n: int = 10, text: str = "text", set_bytes: int = SET_BYTES) -> DataFrame:
    """Documents with n_words, n_hit, hit_spans (at, size in words), item_ids, n_items and contaminated."""
    seen = hits(documents, items, n, text, set_bytes)
    place = F.when(F.col("hash").isNotNull(), F.struct("at", "size"))
    spans = seen.groupBy("__text").agg(F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(place)).alias("hit_spans"))
    found = seen.filter("hash IS NOT NULL")
    owners = item_windows(items, n).select("hash", "words", "item").distinct()
    named = (
        found.select("__text", "hash", "words").distinct().join(owners, ["hash", "words"])
        .groupBy("__text").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    report = spans.join(named, "__text", "left")
    new = ["n_words", "n_hit", "hit_spans", "item_ids", "n_items", "contaminated"]
    base = documents.select(
        *[c for c in documents.columns if c not in new],
        F.md5(text).alias("__text"),
    )
    n_hit = F.coalesce(_covered(F.col("hit_spans")), F.lit(0).cast("long"))
    return base.join(report, "__text", "left").withColumns({
        "n_words": F.coalesce("n_words", F.lit(0).cast("long")),
        "n_hit": n_hit,
        "item_ids": F.coalesce("item_ids", F.array().cast("array<string>")),
        "contaminated": n_hit > 0,
    }).withColumn("n_items", F.size("item_ids").cast("long")).drop("__text")


def decontaminate(
    documents: DataFrame, items: DataFrame, n: int = 10, remove: str = "documents", text: str = "text"
) -> DataFrame:
    """Documents without contaminated ones, or, with ``remove="spans"``, all documents without the words that hit."""
    if remove == "documents":
        hit = hits(documents, items, n, text).filter("hash IS NOT NULL").select(F.col("__text").alias("__hit")).distinct()
        rows = documents.withColumn("__text", F.md5(text))
        return rows.join(hit, F.col("__text") == F.col("__hit"), "left_anti").select(*documents.columns)
    marked = mark(documents, items, n, text)
    source = F.col(text)
    words, gaps = F.array_remove(F.split(source, APART), ""), F.split(source, WORD, -1)
    at = F.sequence(F.lit(0).cast("long"), F.col("n_words") - 1)
    gone = F.flatten(F.transform("hit_spans", lambda s: F.sequence(s["at"].cast("long"), (s["at"] + s["size"] - 1).cast("long"))))
    kept = F.transform(F.array_except(at, gone), lambda i: F.concat(F.get(words, i.cast("int")), F.get(gaps, (i + 1).cast("int"))))
    cut = F.concat(F.get(gaps, F.lit(0)), F.array_join(kept, ""))
    return marked.withColumn(text, F.when(F.col("contaminated"), cut).otherwise(source)).select(*documents.columns)


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document with its words, the words below benchmark windows, and a digest of the items found."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    marked = mark(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


SQL = r"""
WITH item_words AS (
    SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
    SELECT item, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k, w FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS words FROM item_windows),
docs AS (
    SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (
    SELECT r, s.size, k, array_to_string(w[k:k + s.size - 1], ' ') AS words
    FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM docs) JOIN (SELECT DISTINCT size FROM windows) s ON k + s.size - 1 <= len(w)),
found AS (SELECT p.r, p.k, p.size, x.item FROM places p JOIN windows x ON p.size = x.size AND p.words = x.words),
hit AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS x FROM (SELECT DISTINCT r, k, size FROM found)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
