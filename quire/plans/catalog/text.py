"""Text, search, outline and metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.text import FOLD_FROM, FOLD_TO, SHOWN, decode_meta, encode_meta, fold_text
from quire.operators.metadata import meta_edit, meta_read
from quire.operators.outline import outline
from quire.operators.phrase_index import search_table
from quire.operators.search import search, search_snippets
from quire.operators.text import effective_text
from quire.plans.flows import search_corpus
from quire.plans.registry import query
from quire.plans.roles import LINES, lines, table

PHRASES = [" The ", "ing on", "e", "über", "Anat", "12"]
USED = "(VALUES ('The'), ('ing on'), ('e'), ('über'), ('Anat'), ('12')) AS q(query)"


@query(
    "search",
    f"""
    WITH {LINES}
    SELECT doc_id, page, query FROM lines, {USED} WHERE contains(lower(text), lower(query))
    """,
)
def _search(spark, sf_dir):
    return search(lines(spark, sf_dir), PHRASES).select("doc_id", "page", "query")


def _snippet_sql(text: str, needle: str) -> str:
    return f"""
    WITH {LINES},
    hits AS (
        SELECT doc_id, page, text, query, instr({text}, {needle}) AS hit FROM lines, {USED} WHERE contains({text}, {needle})),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query, doc_id ORDER BY page) AS hit_no FROM hits),
    placed AS (SELECT *, greatest(hit - 40, 1) AS start FROM ranked)
    SELECT doc_id, page, query, hit_no,
           concat(CASE WHEN start > 1 THEN '…' ELSE '' END,
                  regexp_replace(substr(text, start, hit - start), '\\s+', ' ', 'g')) AS before,
           substr(text, hit, length(query)) AS match,
           regexp_replace(substr(text, hit + length(query), 60) || '…', '\\s+', ' ', 'g') AS after
    FROM placed
    """


@query("search_snippets", _snippet_sql("lower(text)", "lower(query)"))
def _search_snippets(spark, sf_dir):
    return search_snippets(lines(spark, sf_dir), PHRASES)


@query("search_snippets_case", _snippet_sql("text", "query"))
def _search_snippets_case(spark, sf_dir):
    return search_snippets(lines(spark, sf_dir), PHRASES, case_sensitive=True)


@query(
    "search_table",
    """
    SELECT doc_id, item_id, strpos(lower(text), lower(phrase)) AS at,
           concat(CASE WHEN strpos(lower(text), lower(phrase)) > 41 THEN '…' ELSE '' END,
                  regexp_replace(substr(text, greatest(strpos(lower(text), lower(phrase)) - 40, 1),
                                        least(strpos(lower(text), lower(phrase)) - 1, 40)), '\\s+', ' ', 'g')) AS before,
           substr(text, strpos(lower(text), lower(phrase)), length(phrase)) AS match,
           regexp_replace(substr(text, strpos(lower(text), lower(phrase)) + length(phrase), 60) || '…', '\\s+', ' ', 'g') AS after
    FROM documents JOIN (SELECT item_id, trim(text) AS phrase FROM benchmark) b ON contains(lower(text), lower(phrase))
    """,
)
def _search_table(spark, sf_dir):
    """The text of every benchmark item, looked for in every document."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return search_table(docs, items.select("item_id", F.col("text").alias("phrase")), ["doc_id"]).drop("phrase")


@query(
    "effective_text",
    f"""
    WITH {LINES}
    SELECT doc_id, page, CASE WHEN page % 3 <> 0 THEN text WHEN length(text) > 100 THEN concat('ocr ', text) ELSE '' END AS text
    FROM lines
    """,
)
def _effective_text(spark, sf_dir):
    """Every third page lost its text; the recogniser read the long ones."""
    pages = lines(spark, sf_dir)
    third = F.pmod(F.col("page"), F.lit(3)) == 0
    native = pages.withColumn("text", F.when(third, "").otherwise(F.col("text")))
    ocr = pages.filter(F.length("text") > 100).withColumn("text", F.concat(F.lit("ocr "), F.col("text")))
    return effective_text(native, ocr)


@query(
    "outline",
    """
    WITH n AS (
        SELECT r_regionkey AS doc_id, 0 AS level, r_name AS title, -1 AS a, -1::BIGINT AS b, NULL AS page FROM region
        UNION ALL
        SELECT n_regionkey, 1, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END, n_nationkey, -1, NULL FROM nation
        UNION ALL
        SELECT n_regionkey, 2, c_name, n_nationkey, c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey + 1 END
        FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a, b)::INTEGER AS item_no, title, page, level
    FROM n WHERE title <> ''
    """,
)
def _outline(spark, sf_dir):
    """Regions, nations and customers as bookmarks; some nations have blank titles."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    no_target = F.lit(None).cast("bigint").alias("target")
    top = region.select(
        F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"),
        F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("sibling_no"),
        F.col("r_name").alias("title"), no_target,
    )
    blank = F.pmod(F.col("n_nationkey"), F.lit(4)) == 0
    middle = nation.select(
        F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"),
        F.col("n_nationkey").cast("bigint").alias("sibling_no"),
        F.when(blank, "  ").otherwise(F.col("n_name")).alias("title"), no_target,
    )
    bottom = customer.join(nation, F.col("n_nationkey") == F.col("c_nationkey")).select(
        F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.col("c_custkey").alias("sibling_no"),
        F.concat(F.lit(" "), F.col("c_name")).alias("title"), F.col("c_custkey").alias("target"),
    )
    known = customer.filter(F.col("c_mktsegment") != "BUILDING").join(
        nation, F.col("n_nationkey") == F.col("c_nationkey")
    ).select(F.col("n_regionkey").alias("doc_id"), F.col("c_custkey").alias("target"), (F.col("c_custkey") + 1).alias("page"))
    return outline(top.unionByName(middle).unionByName(bottom), known)


def _info(spark, sf_dir):
    """Customers as documents with an information map of text."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        "c_mktsegment",
        F.create_map(
            F.lit("Title"), F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")),
            F.lit("Author"), F.when(F.col("c_acctbal") > 0, "Ağaoğlu").otherwise(" \t "),
            F.lit("Custom"), F.col("c_mktsegment"),
        ).alias("info"),
    )


@query(
    "meta_read",
    """
    SELECT c_custkey AS doc_id, c_name AS title, CASE WHEN c_acctbal > 0 THEN 'Ağaoğlu' END AS author,
           NULL::VARCHAR AS subject, NULL::VARCHAR AS keywords, NULL::VARCHAR AS creator, NULL::VARCHAR AS producer
    FROM customer
    """,
)
def _meta_read(spark, sf_dir):
    info = _info(spark, sf_dir)
    stored = F.transform_values("info", lambda _, v: encode_meta(v))
    return info.select("doc_id", meta_read(stored).alias("m")).select("doc_id", "m.*")


@query(
    "meta_read_props",
    """
    SELECT event_id, json_extract_string(props, '$.k') AS title FROM events
    """,
)
def _meta_read_props(spark, sf_dir):
    props = F.from_json("props", "map<string,string>")
    renamed = F.transform_keys(props, lambda k, _: F.when(k == "k", "Title").otherwise(k))
    events = table(spark, sf_dir, "events").select("event_id", meta_read(renamed, binary=False).alias("m"))
    return events.select("event_id", "m.title")


@query(
    "meta_edit",
    """
    SELECT c_custkey AS doc_id,
           CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'AUTOMOBILE' THEN concat('Custom=AUTOMOBILE;Title=New ', c_custkey)
               WHEN 'FURNITURE' THEN concat('Custom=FURNITURE;Keywords=k;Title=T')
               ELSE concat('Author=', CASE WHEN c_acctbal > 0 THEN 'Ağaoğlu' ELSE concat(' ', chr(9), ' ') END,
                           ';Custom=', c_mktsegment, ';Title=  ', c_name, ' ') END AS info
    FROM customer
    """,
)
def _meta_edit(spark, sf_dir):
    docs = _info(spark, sf_dir)
    seg = F.col("c_mktsegment")
    touched = docs.filter(seg.isin("BUILDING", "AUTOMOBILE", "FURNITURE"))
    none = F.lit(None).cast("string")
    edits = touched.select(
        "doc_id",
        (seg == "BUILDING").alias("clear_all"),
        F.when(seg == "AUTOMOBILE", F.concat(F.lit(" New "), F.col("doc_id").cast("string")))
        .when(seg == "FURNITURE", "T").alias("title"),
        F.lit("  ").alias("author"),
        none.alias("subject"),
        F.when(seg == "FURNITURE", "k ").alias("keywords"),
        none.alias("creator"),
        none.alias("producer"),
    )
    edited = meta_edit(docs.select("doc_id", "info"), edits)
    entries = F.sort_array(F.transform(F.map_entries("info"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return edited.select("doc_id", F.array_join(entries, ";").alias("info"))


@query("text_codec", "SELECT doc_id, text, CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 2 + 2 * length(text) ELSE length(text) END AS n_bytes FROM (SELECT doc_id, trim(text, ' ' || chr(10)) AS text FROM documents)")
def _text_codec(spark, sf_dir):
    """Texts encoded as metadata and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "^[ \n]+|[ \n]+$", "").alias("text"))
    coded = docs.select("doc_id", encode_meta("text").alias("raw"))
    return coded.select("doc_id", decode_meta("raw").alias("text"), F.octet_length("raw").cast("bigint").alias("n_bytes"))


@query(
    "fold_text",
    f"""
    SELECT doc_id, regexp_replace(
        replace(replace(translate(text, '{FOLD_FROM}', '{FOLD_TO}'), 'Ĳ', 'IJ'), 'ĳ', 'ij'),
        '[^\\x20-\\x7E\\x{{A0}}-\\x{{FF}}{SHOWN}]', '?', 'g') AS folded
    FROM (SELECT doc_id, concat('ŁódźĲ中', text) AS text FROM documents)
    """,
)
def _fold_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", fold_text(F.concat(F.lit("ŁódźĲ中"), F.col("text"))).alias("folded")
    )


@query(
    "search_corpus",
    f"""
    WITH {LINES},
    counts AS (SELECT doc_id, max(page) AS n FROM lines GROUP BY 1),
    offsets AS (
        SELECT doc_id, source, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS skip
        FROM counts JOIN documents USING (doc_id)),
    hits AS (
        SELECT doc_id, page, query, row_number() OVER (PARTITION BY query, doc_id ORDER BY page) AS hit_no,
               instr(lower(text), query) AS hit, text FROM lines, (VALUES ('the'), ('nicht')) AS q(query) WHERE contains(lower(text), query))
    SELECT doc_id, page, query, hit_no, source, concat('DOC-', lpad((skip + page)::VARCHAR, 6, '0')) AS label,
           substr(text, hit, length(query)) AS match,
           concat(CASE WHEN hit > 41 THEN '…' ELSE '' END,
                  regexp_replace(substr(text, greatest(hit - 40, 1), hit - greatest(hit - 40, 1)), '\\s+', ' ', 'g')) AS before,
           regexp_replace(substr(text, hit + length(query), 60) || '…', '\\s+', ' ', 'g') AS after
    FROM hits JOIN offsets USING (doc_id)
    """,
)
def _search_corpus(spark, sf_dir):
    return search_corpus(table(spark, sf_dir, "documents"), ["the", "nicht"], sep="\n", prefix="DOC-")
