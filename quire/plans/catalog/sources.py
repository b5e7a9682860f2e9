"""Source, intake and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.paths import classify_file
from quire.operators.text import cap_text, export_text, split_pages
from quire.plans.registry import query
from quire.plans.roles import LINES, lines, table
from quire.session import shared_folder
from quire.sources.files import catalogue, intake, name_outputs
from quire.sources.images import image_budget, image_gate
from quire.sources.sinks import write_docs

DOC_PATH = "concat('/', source, '/', doc_id, CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.PDF' WHEN 'es' THEN '.txt' ELSE '' END)"


@query(
    "scan_files",
    f"""
    WITH {LINES},
    counts AS (SELECT doc_id, max(page) AS n FROM lines GROUP BY 1 HAVING max(page) > 5),
    f AS (SELECT doc_id, {DOC_PATH} AS path, n_chars, lang IN ('en', 'fr') AS is_pdf, lang FROM documents)
    SELECT path, concat(doc_id, CASE lang WHEN 'en' THEN '.pdf' WHEN 'fr' THEN '.PDF' WHEN 'es' THEN '.txt' ELSE '' END) AS name,
           n_chars AS size, CASE WHEN is_pdf THEN n END AS page_count, is_pdf AND n IS NOT NULL AS is_valid
    FROM f LEFT JOIN counts USING (doc_id)
    """,
)
def _scan_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(DOC_PATH).alias("path"), F.col("n_chars").alias("length")
    )
    # short documents count as unreadable
    pages = lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("page_count")).filter(F.col("page_count") > 5)
    counts = docs.join(pages, "doc_id").select("path", "page_count")
    return catalogue(docs.select("path", "length"), counts)


NAMES = "concat(source, '/', doc_id, '.', CASE source WHEN 'src0' THEN 'Pdf' WHEN 'src1' THEN 'jpeg' WHEN 'src2' THEN 'HEIC' WHEN 'src3' THEN 'docx' WHEN 'src4' THEN 'htm' WHEN 'src5' THEN 'csv' WHEN 'src6' THEN 'pdfx' WHEN 'src7' THEN 'tif' ELSE lang END)"


@query(
    "classify_file",
    f"""
    SELECT {NAMES} AS name,
           CASE WHEN source = 'src0' THEN 'pdf' WHEN source IN ('src1', 'src2', 'src7') THEN 'image'
                WHEN source IN ('src3', 'src4', 'src5') THEN 'office' ELSE 'unsupported' END AS kind
    FROM documents
    """,
)
def _classify_file(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.expr(NAMES).alias("name")).withColumn("kind", classify_file("name"))


@query("split_pages", f"WITH {LINES} SELECT doc_id, page, text FROM lines")
def _split_pages(spark, sf_dir):
    return split_pages(table(spark, sf_dir, "documents"), sep="\n")


CAP = 1500


@query(
    "cap_text",
    f"""
    WITH {LINES},
    placed AS (
        SELECT *, strlen(text) AS size,
               coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
        FROM lines),
    kept AS (SELECT *, {CAP} - start AS room FROM placed WHERE start < {CAP}),
    trimmed AS (
        SELECT doc_id, page, text, size >= room AS limited, room,
               CASE WHEN size > room THEN
                   list_max(list_filter(range(greatest(room // 4, 0), length(text) + 1), lambda i: strlen(left(text, i)) <= room))
               END AS m
        FROM kept),
    done AS (
        SELECT doc_id, page, limited, CASE WHEN m IS NULL THEN text
               ELSE left(text, m) || CASE WHEN strlen(left(text, m)) < room THEN chr(65533) ELSE '' END END AS text
        FROM trimmed)
    SELECT doc_id, page, text FROM done WHERE NOT (limited AND NOT regexp_matches(text, '[^\\s]'))
    """,
)
def _cap_text(spark, sf_dir):
    return cap_text(lines(spark, sf_dir), CAP)


RANGES = "CAST(doc_id % 7 AS INT) AS first, CASE WHEN lang = 'de' THEN NULL ELSE CAST(doc_id % 11 AS INT) END AS last"


@query(
    "export_text",
    f"""
    WITH {LINES}, r AS (SELECT doc_id, {RANGES} FROM documents)
    SELECT doc_id, (before // 1000)::BIGINT AS part, string_agg(text, chr(12) ORDER BY page) AS text
    FROM (
        SELECT doc_id, page, text, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY doc_id ORDER BY page
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM lines JOIN r USING (doc_id)
        WHERE (last IS NULL OR first <= last) AND page >= greatest(first, 1) AND (last IS NULL OR page <= last))
    GROUP BY 1, 2
    """,
)
def _export_text(spark, sf_dir):
    ranges = table(spark, sf_dir, "documents").selectExpr("doc_id", *RANGES.split(", "))
    return export_text(lines(spark, sf_dir), ranges, part_bytes=1000)[0]


@query(
    "export_text_errors",
    f"""
    SELECT doc_id, 'INVALID_RANGE' AS error FROM (SELECT doc_id, {RANGES} FROM documents) WHERE first > last
    """,
)
def _export_text_errors(spark, sf_dir):
    ranges = table(spark, sf_dir, "documents").selectExpr("doc_id", *RANGES.split(", "))
    return export_text(lines(spark, sf_dir), ranges)[1]


# neighbours share a path, so every path comes twice
INCOMING = """
    SELECT doc_id AS seq, source, lang, doc_id / 2 AS half,
           concat('/in/', CAST(floor(doc_id / 2) AS BIGINT), CASE CAST(floor(doc_id / 2) AS BIGINT) % 6
               WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.png' WHEN 3 THEN '.docx' WHEN 4 THEN '.zip' ELSE '.pdf' END) AS path
    FROM {documents}
"""
INTAKE_SQL = f"""
    incoming AS ({INCOMING.format(documents="documents")}),
    existing AS (SELECT DISTINCT path FROM incoming WHERE lang = 'fr'),
    info AS (
        SELECT path, bool_and(lang <> 'es') AS is_valid, CASE WHEN bool_or(source = 'src3') THEN 'broken' END AS error
        FROM incoming GROUP BY path),
    judged AS (
        SELECT i.seq, i.path, CASE
            WHEN contains(path, '.zip') THEN 'unsupported'
            WHEN lower(right(path, 4)) = '.pdf' AND path IN (SELECT path FROM existing) THEN 'already_loaded'
            WHEN f.error IS NOT NULL THEN 'error'
            WHEN NOT f.is_valid THEN 'invalid'
            ELSE 'added' END AS outcome
        FROM incoming i JOIN info f USING (path))
"""


def _intake(spark, sf_dir):
    incoming = spark.sql(INCOMING, documents=table(spark, sf_dir, "documents"))
    existing = incoming.filter(F.col("lang") == "fr").select("path")
    info = incoming.groupBy("path").agg(
        F.bool_and(F.col("lang") != "es").alias("is_valid"),
        F.when(F.bool_or(F.col("source") == "src3"), "broken").alias("error"),
    )
    return intake(incoming.select("seq", "path"), existing, info)


@query(
    "intake",
    f"""
    WITH {INTAKE_SQL}
    SELECT seq, path, outcome,
           CASE WHEN outcome = 'added' THEN concat('f', row_number() OVER (PARTITION BY outcome ORDER BY seq)) END AS uid
    FROM judged
    """,
)
def _intake_rows(spark, sf_dir):
    added, _, rejected = _intake(spark, sf_dir)
    return added.select("seq", "path", F.lit("added").alias("outcome"), "uid").unionByName(
        rejected.select("seq", "path", "outcome", F.lit(None).cast("string").alias("uid"))
    )


@query(
    "intake_report",
    f"""
    WITH {INTAKE_SQL}
    SELECT count(*) FILTER (outcome = 'added') AS added, count(*) FILTER (outcome = 'invalid') AS invalid,
           count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'already_loaded') AS already_loaded,
           bool_or(outcome = 'unsupported') AS not_pdf
    FROM judged
    """,
)
def _intake_report(spark, sf_dir):
    return _intake(spark, sf_dir)[1]


# header bytes derived from parts: PNG, JPEG with a segment before the frame, and strangers
IMAGE_BYTES = """
    unhex(CASE p_type
        WHEN 'PROMO' THEN concat('47494638', lpad(hex(p_size), 4, '0'))
        WHEN 'SMALL' THEN concat('FFD8FFE00006AABBCCDD', 'FFFFC2000908', lpad(hex(cast(p_retailprice as bigint)), 4, '0'),
                                 lpad(hex(p_size * 100), 4, '0'), '0311')
        WHEN 'MEDIUM' THEN concat('FFD8FFE00004AABB', 'FFD9', lpad(hex(p_size), 4, '0'))
        WHEN 'LARGE' THEN '89504E470D0A1A0A0000'
        ELSE concat('89504E470D0A1A0A0000000D49484452', lpad(hex(p_size * 100), 8, '0'),
                    lpad(hex(cast(p_retailprice as bigint)), 8, '0')) END)
"""


@query(
    "image_gate",
    """
    WITH g AS (
        SELECT concat('/img/', p_partkey) AS path, CASE p_type WHEN 'PROMO' THEN 6 WHEN 'SMALL' THEN 22
                   WHEN 'MEDIUM' THEN 12 WHEN 'LARGE' THEN 10 ELSE 24 END::BIGINT AS length,
               p_type IN ('SMALL', 'ECONOMY', 'STANDARD') AS sized, p_type, p_size * 100 AS w, trunc(p_retailprice)::BIGINT AS h
        FROM part)
    SELECT path, length, CASE WHEN sized THEN w END::BIGINT AS width, CASE WHEN sized THEN h END AS height,
           CASE WHEN p_type = 'PROMO' THEN 'IMAGE_TYPE' WHEN NOT sized THEN 'IMAGE_BAD'
                WHEN greatest(w, h) > 4096 THEN 'IMAGE_TOO_LARGE' END AS reason
    FROM g
    """,
)
def _image_gate(spark, sf_dir):
    images = table(spark, sf_dir, "part").select(
        F.concat(F.lit("/img/"), F.col("p_partkey").cast("string")).alias("path"), F.expr(IMAGE_BYTES).alias("content")
    )
    return image_gate(images.withColumn("length", F.octet_length("content").cast("bigint")))


@query(
    "image_budget",
    """
    WITH img AS (
        SELECT p_partkey AS image, p_size * 1000 AS bytes, (p_size * 10) * trunc(p_retailprice)::BIGINT AS pixels,
               CASE WHEN p_brand = 'Brand#1' THEN 'IMAGE_BAD' END AS bad
        FROM part WHERE p_type <> 'PROMO'),
    placed AS (
        SELECT l_orderkey AS doc_id, l_partkey AS image, min(l_linenumber * 100000000 + l_partkey) AS seq
        FROM lineitem GROUP BY 1, 2),
    run AS (
        SELECT doc_id, seq, coalesce(bytes, 0) AS bytes, coalesce(pixels, 0) AS pixels,
               CASE WHEN i.image IS NULL THEN 'IMAGE_MISSING' ELSE bad END AS bad,
               sum(coalesce(bytes, 0)) OVER w AS b, sum(coalesce(pixels, 0)) OVER w AS p
        FROM placed LEFT JOIN img i USING (image) WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
    why AS (
        SELECT *, coalesce(bad, CASE WHEN b > 120000 OR p > 1500000 THEN 'IMAGE_TOO_LARGE' END) AS reason FROM run)
    SELECT doc_id, sum(bytes)::BIGINT AS unique_bytes, sum(pixels)::BIGINT AS unique_pixels,
           arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason, min(seq) FILTER (reason IS NOT NULL) AS rejected_seq
    FROM why GROUP BY 1
    """,
)
def _image_budget(spark, sf_dir):
    images = table(spark, sf_dir, "part").filter(F.col("p_type") != "PROMO").select(
        F.col("p_partkey").alias("image"),
        (F.col("p_size") * 1000).alias("bytes"),
        (F.col("p_size") * 10).alias("width"),
        F.col("p_retailprice").cast("bigint").alias("height"),
        F.when(F.col("p_brand") == "Brand#1", "IMAGE_BAD").alias("reason"),
    )
    placements = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey")).alias("seq"),
        F.col("l_partkey").alias("image"),
    )
    return image_budget(placements, images, max_bytes=120_000, max_pixels=1_500_000)


STEM = "CASE WHEN lang = 'fr' THEN concat(source, ' (', doc_id % 5 + 2, ')') ELSE source END"


@query(
    "name_outputs",
    f"""
    WITH inputs AS (SELECT doc_id AS seq, concat('/out/', substr(lang, 1, 1)) AS dir, {STEM} AS stem FROM documents
                    UNION ALL SELECT doc_id + 10000000, '/out/f', source FROM documents WHERE lang = 'en'),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY seq) AS n FROM inputs),
    tops AS (SELECT dir, stem, max(n) AS top FROM numbered GROUP BY 1, 2),
    taken AS (SELECT DISTINCT dir, stem AS name FROM inputs),
    free AS (
        SELECT dir, stem, k, row_number() OVER (PARTITION BY dir, stem ORDER BY k) + 1 AS n
        FROM (SELECT dir, stem, unnest(range(2, top + 12)) AS k FROM tops) c
        WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.dir = c.dir AND t.name = concat(c.stem, ' (', c.k, ')')))
    SELECT seq, dir, stem, concat(dir, '/', stem, CASE WHEN n = 1 THEN '' ELSE concat(' (', k, ')') END, '.pdf') AS output_path
    FROM numbered LEFT JOIN free USING (dir, stem, n)
    """,
)
def _name_outputs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = docs.select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("/out/"), F.substring("lang", 1, 1)).alias("dir"),
        F.expr(STEM).alias("stem"),
    )
    more = docs.filter(F.col("lang") == "en").select(
        (F.col("doc_id") + 10000000).alias("seq"), F.lit("/out/f").alias("dir"), F.col("source").alias("stem")
    )
    return name_outputs(own.unionByName(more))


@query("write_docs", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _write_docs(spark, sf_dir):
    out = shared_folder(spark, "written")
    docs = table(spark, sf_dir, "documents")
    write_docs(docs, out, inputs=[sf_dir], partition_by=["lang"])
    return spark.read.parquet(out).select(*docs.columns)
