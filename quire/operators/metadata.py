"""Document information: six named fields over an open map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import col
from quire.functions.text import EDGE_SPACE, decode_meta, encode_meta

FIELDS = ["Title", "Author", "Subject", "Keywords", "Creator", "Producer"]


def meta_read(info: Column | str, binary: bool = True) -> Column:
    """The six fields of an info map as a struct; trimmed, empty is null.

    ``binary`` maps hold encoded bytes, others hold text.
    """

    def field(name: str) -> Column:
        raw = F.try_element_at(col(info), F.lit(name))
        text = decode_meta(raw) if binary else F.regexp_replace(raw, EDGE_SPACE, "")
        return F.nullif(text, F.lit("")).alias(name.lower())

    return F.struct(*[field(n) for n in FIELDS])


def meta_edit(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply ``edits`` (doc_id, clear_all, title, ..., producer) to ``docs.info``.

    A non-blank value is set, a blank or null one removes the field, other keys
    stay; ``clear_all`` empties the map. Several edits of a document are applied in
    the order of their ``seq``. Documents without an edit are unchanged.
    """
    stored = docs.schema["info"].dataType
    binary = isinstance(stored.valueType, T.BinaryType)
    kind = T.MapType(stored.keyType, stored.valueType, True)
    seq = [c for c in ("seq",) if c in edits.columns]
    empty = F.create_map().cast(kind)

    def entry(name: str) -> Column:
        value = F.nullif(F.regexp_replace(F.col(name.lower()), EDGE_SPACE, ""), F.lit(""))
        return F.struct(F.lit(name).alias("key"), (encode_meta(value) if binary else value).alias("value"))

    entries = F.array(*[entry(n) for n in FIELDS])
    written = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    # an edit sets or removes every field, so the last one decides them and any clear_all the other keys;
    # maps cannot be ordered, so they are kept as entries
    clear = F.coalesce(F.col("clear_all"), F.lit(False))
    one = F.struct(*seq, clear.alias("clear"), F.map_entries(written).alias("set"))
    by_doc = edits.groupBy("doc_id").agg(F.max(one).alias("__last"), F.bool_or(clear).alias("__cleared"))
    before = F.when(F.col("__cleared"), empty).otherwise(F.coalesce(F.col("info").cast(kind), empty))
    kept = F.map_filter(before, lambda k, _: ~k.isin(FIELDS))
    edited = (
        F.when(F.col("__last").isNull(), F.col("info"))
        .when(F.col("__last.clear"), empty)
        .otherwise(F.map_concat(kept, F.map_from_entries("__last.set")).cast(kind))
    )
    return docs.join(by_doc, "doc_id", "left").select(
        *[c if c != "info" else edited.alias("info") for c in docs.columns]
    )
