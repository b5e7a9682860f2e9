"""Whole flows, files written and read back, refused inputs, and several instructions for one document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.operators import assemble as A
from quire.operators.labels import z_order
from quire.operators.metadata import meta_edit
from quire.operators.text import export_text
from quire.plans.catalog.assembly import COMBINED, TILES_SQL, nation_files
from quire.plans.catalog.quality import GRAY_SQL, _tiles
from quire.plans.flows import remove_blank_pages, split_combined
from quire.plans.registry import query
from quire.plans.roles import ORDER_PAGES, customer_counts, lines, order_pages, part_boxes, table
from quire.plans.blocks import row_numbers
from quire.session import shared_folder
from quire.sources.files import conversions, scan_files
from quire.sources.images import image_gate
from quire.sources.sinks import read_text, write_text


@query(
    "remove_blank_pages",
    f"""
    WITH {GRAY_SQL},
    kept AS (SELECT doc_id, page FROM stats WHERE NOT (dark < 0.003 OR (std < 4 AND mean > 160)) OR page % 5 = 0)
    SELECT doc_id, 'a' AS uid, page FROM kept
    """,
)
def _remove_blank_pages(spark, sf_dir):
    """Pages without blank ones; every fifth page was spared."""
    tiles = _tiles(spark, sf_dir).withColumn("uid", F.lit("a"))
    pages = tiles.filter("tile = 0").select("doc_id", "uid", "page")
    return remove_blank_pages(pages, tiles, pages.filter(F.pmod("page", F.lit(5)) == 0))[0]


@query(
    "split_combined",
    f"""
    WITH {COMBINED}
    SELECT doc_id, pos, key, (pos - 1) // 100 + 1 AS part,
           concat('nation', doc_id, '-part', lpad(((pos - 1) // 100 + 1)::VARCHAR, 3, '0'), '.pdf') AS output
    FROM combined
    """,
)
def _split_combined(spark, sf_dir):
    stem = F.concat(F.lit("nation"), F.col("doc_id").cast("string"))
    return split_combined(nation_files(spark, sf_dir), 100, stem).select("doc_id", "pos", "key", "part", "output")


@query(
    "scan_files_listed",
    """
    SELECT source AS folder, true AS named, sum(2 * strlen(text) + 1)::BIGINT AS size, count(*)::INTEGER AS page_count, true AS is_valid
    FROM documents GROUP BY source
    """,
)
def _scan_files_listed(spark, sf_dir):
    """Whole texts written as files of each source, listed, joined with the lines counted in each, and summed."""
    root = shared_folder(spark, "listed")
    docs = table(spark, sf_dir, "documents").select("source", F.hex("text").alias("text"))
    docs.write.partitionBy("source").option("extension", "pdf").csv(root)
    local = F.regexp_replace(F.input_file_name(), "^file:/+", "file:/")
    counts = spark.read.text(root).select(local.alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("page_count"))
    found = scan_files(spark, root, counts, "*.pdf")
    return found.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("folder")).agg(
        F.bool_and(F.col("name").endswith(".pdf")).alias("named"), F.sum("size").alias("size"),
        F.sum("page_count").cast("int").alias("page_count"), F.bool_and("is_valid").alias("is_valid"),
    )


@query("write_text", "SELECT doc_id, text FROM documents")
def _write_text(spark, sf_dir):
    """Texts of all documents as files, one each, read back whole."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("int")
    text, _ = export_text(docs.select("doc_id", F.lit(1).alias("page"), "text"), docs.select("doc_id", none.alias("first"), none.alias("last")))
    root = shared_folder(spark, "texts")
    write_text(text, root, inputs=[sf_dir])
    return read_text(spark, root).select(F.col("key").cast("bigint").alias("doc_id"), "text")


@query("write_text_packed", "SELECT doc_id, text FROM documents")
def _write_text_packed(spark, sf_dir):
    """Texts of all documents, many to a file, read back whole by key."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("int")
    text, _ = export_text(docs.select("doc_id", F.lit(1).alias("page"), "text"), docs.select("doc_id", none.alias("first"), none.alias("last")))
    root = shared_folder(spark, "texts")
    write_text(text, root, inputs=[sf_dir], packed=True)
    return spark.read.parquet(root).select("doc_id", "text")


@query(
    "image_gate_heif",
    """
    SELECT p_partkey AS path, (p_partkey * 40000)::BIGINT AS length, p_size::BIGINT * 200 AS width, (p_retailprice * 4)::BIGINT AS height,
           CASE WHEN p_partkey * 40000 > 67108864 OR p_size * 200 > 8192 OR (p_retailprice * 4)::BIGINT > 8192
                     OR p_size::BIGINT * 200 * (p_retailprice * 4)::BIGINT > 32000000 OR p_size::BIGINT * p_partkey * 3000 > 134217728 THEN 'IMAGE_TOO_LARGE' END AS reason
    FROM (SELECT p_partkey, p_size, floor(p_retailprice) AS p_retailprice FROM part)
    """,
)
def _image_gate_heif(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    headers = part.select(
        F.col("p_partkey").alias("path"), (F.col("p_partkey") * 40000).cast("bigint").alias("length"), (F.col("p_size") * 200).alias("width"),
        (F.floor("p_retailprice") * 4).alias("height"), (F.col("p_size").cast("bigint") * F.col("p_partkey") * 3000).alias("decoded_bytes"),
    )
    return image_gate(headers, "heif")


@query(
    "conversions",
    """
    SELECT DISTINCT concat(source, '.', lang, CASE doc_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.heic' ELSE '.pdf' END) AS path
    FROM documents WHERE doc_id % 3 < 2
    """,
)
def _conversions(spark, sf_dir):
    end = F.expr("CASE doc_id % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.heic' ELSE '.pdf' END")
    return conversions(table(spark, sf_dir, "documents").select(F.concat("source", F.lit("."), "lang", end).alias("path")))


@query(
    "merge_docs_errors",
    f"""
    WITH {ORDER_PAGES}
    SELECT c_nationkey + 1000 * (c_custkey % 7) AS target, 'NO_INPUT' AS error FROM customer
    GROUP BY 1 HAVING count(*) FILTER (c_custkey % 7 = 3 AND c_custkey IN (SELECT doc_id FROM order_pages)) = 0
    """,
)
def _merge_docs_errors(spark, sf_dir):
    """Every nation wants seven merges, of which one has sources."""
    customer = table(spark, sf_dir, "customer").withColumn("target", F.expr("c_nationkey + 1000 * (c_custkey % 7)"))
    merges = customer.filter("c_custkey % 7 = 3").select("target", F.col("c_custkey").alias("ord"), F.col("c_custkey").alias("source"))
    pages = order_pages(spark, sf_dir).select("doc_id", "page", "o_orderkey")
    return A.merge_docs(pages, merges, customer.select("target").distinct())[1]


@query("sheet_plan_errors", "SELECT o_custkey AS doc_id, 'TOO_MANY_SHEETS' AS error FROM orders GROUP BY 1 HAVING (count(*) + 3) // 4 > 2")
def _sheet_plan_errors(spark, sf_dir):
    boxes = order_pages(spark, sf_dir).select("doc_id", "page", geo.box(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("box"), F.lit(0).alias("rotate"))
    return A.sheet_plan(customer_counts(spark, sf_dir), boxes, "4up", 842.0, 595.0, max_sheets=2)[1]


@query("tile_plan_errors", TILES_SQL.split("    r AS (SELECT")[0].rstrip().rstrip(",") + " SELECT doc_id, page, 'TOO_MANY_TILES' AS error FROM grid WHERE rows * cols > 2")
def _tile_plan_errors(spark, sf_dir):
    boxes = part_boxes(spark, sf_dir).select("doc_id", "page", geo.normalize_box("media").alias("box"), "rotate")
    return A.tile_plan(boxes, "a4", "auto", 30.0, max_tiles=2)[1]


SHIFTED = "CASE WHEN {s} = {d} OR least({s}, {d}) < 0 OR greatest({s}, {d}) >= n THEN {p} WHEN {p} = {s} THEN {d} WHEN {p} > {s} AND {p} <= {d} THEN {p} - 1 WHEN {p} < {s} AND {p} >= {d} THEN {p} + 1 ELSE {p} END"


@query(
    "move_file_twice",
    f"""
    WITH f AS (
        SELECT c_nationkey AS doc_id, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord,
               count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
    once AS (SELECT *, {SHIFTED.format(p="ord", s="0", d="(doc_id % 9)")} AS p1 FROM f),
    twice AS (SELECT *, {SHIFTED.format(p="p1", s="(doc_id % 5)", d="(n - 1)")} AS p2 FROM once)
    SELECT doc_id, c_custkey, {SHIFTED.format(p="p2", s="2", d="1")} AS ord FROM twice
    """,
)
def _move_file_twice(spark, sf_dir):
    """Three moves in every nation, handed over in another order than theirs."""
    files = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), "c_custkey")
    files = row_numbers(files, ["doc_id"], "c_custkey", "ord").withColumn("ord", F.col("ord") - 1)
    last = files.groupBy("doc_id").agg(F.max("ord").alias("last"))
    moves = last.select("doc_id", F.expr("stack(3, 3, 2L, 1L, 1, 0L, doc_id % 9L, 2, doc_id % 5L, last) AS (seq, src, dst)"))
    return A.move_file(files, moves).select("doc_id", "c_custkey", "ord")


@query(
    "z_order_twice",
    f"""
    WITH {ORDER_PAGES},
    a AS (SELECT doc_id, page AS pos, o_orderkey AS id, count(*) OVER (PARTITION BY doc_id) AS n FROM order_pages),
    front AS (SELECT *, CASE WHEN pos = 1 THEN n ELSE pos - 1 END AS p1 FROM a),
    back AS (SELECT *, CASE WHEN n = 1 THEN p1 WHEN pos = 2 THEN 1 ELSE p1 END AS p2 FROM front)
    SELECT doc_id, id, CASE WHEN n = 1 THEN p2 WHEN p2 = n THEN n - 1 WHEN p2 = n - 1 THEN n ELSE p2 END AS ord FROM back
    """,
)
def _z_order_twice(spark, sf_dir):
    """The first annotation goes to the front, the second to the back, and the first one back by one."""
    pages = order_pages(spark, sf_dir)
    annots = pages.select("doc_id", F.lit(0).alias("page_index"), F.col("o_orderkey").alias("id"), F.col("page").alias("ord"))
    first = annots.filter("ord = 1").select("doc_id", "id", F.expr("stack(2, 1, 'front', 3, 'backward') AS (seq, dir)"))
    second = annots.filter("ord = 2").select("doc_id", "id", F.lit(2).alias("seq"), F.lit("back").alias("dir"))
    return z_order(annots, first.unionByName(second)).select("doc_id", "id", "ord")


@query(
    "meta_edit_twice",
    """
    SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN concat('Author=x;Title=', c_name) ELSE concat('Author=x;Custom=c;Title=', c_name) END AS info
    FROM customer
    """,
)
def _meta_edit_twice(spark, sf_dir):
    """Every customer is edited twice; the first edit of even ones clears all."""
    customer = table(spark, sf_dir, "customer")
    docs = customer.select(F.col("c_custkey").alias("doc_id"), F.create_map(F.lit("Custom"), F.lit("c"), F.lit("Title"), F.lit("t")).alias("info"))
    none = F.lit(None).cast("string")
    edits = customer.select(
        F.col("c_custkey").alias("doc_id"), F.expr("stack(2, 2, false, c_name, 'x', 1, c_custkey % 2 = 0, 'first', 'y') AS (seq, clear_all, title, author)"),
        *[none.alias(n) for n in ("subject", "keywords", "creator", "producer")],
    )
    entries = F.sort_array(F.transform(F.map_entries("info"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return meta_edit(docs, edits).select("doc_id", F.array_join(entries, ";").alias("info"))
