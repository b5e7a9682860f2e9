"""Search for a table of phrases: anchors of phrases meet anchors of pages by value, and what meets is verified.

A gram is the value of up to eight bytes that begin at a character. A phrase of more than eight bytes is anchored by one of
its grams, the one that the fewest sample pages and then the fewest phrases hold; a shorter phrase is its own gram. Pages
are read once: a place whose gram may be an anchor (a bit map of fixed size says so) becomes a short row with as much of
the text around it as the longest phrase needs. These rows join the anchors on the gram. No list of phrases is in the plan,
whether there are ten of them or a billion, and page text never moves.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import INNER_SPACE
from quire.operators.search import AFTER, BEFORE
from quire.plans.bits import bit_map, holds
from quire.session import shared_folder, small_batches

GRAM = 8
#: Pages whose grams tell frequent from rare ones; they decide what a search costs, never what it finds.
SAMPLE = 500
#: Bytes of text that are worked on at once.
BLOCK = 1 << 20


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; null counts as empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    where = np.frombuffer(offsets, np.int64, len(filled) + 1 + filled.offset)[filled.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[where[0]: where[-1]], where - where[0]


def grams(data: np.ndarray, offsets: np.ndarray, size: int, lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, strings): grams of ``size`` bytes that begin at a character from ``lo`` to ``hi`` and end within their string."""
    n = max(lo, min(len(data) - size + 1, len(data) if hi is None else hi))
    place = lo + np.flatnonzero((data[lo:n] & 0xC0) != 0x80)
    of = np.searchsorted(offsets, place, "right") - 1
    fits = offsets[of + 1] - place >= size
    place, of = place[fits], of[fits]
    short = size < GRAM
    value = np.full(len(place), size - 1 if short else 0, np.uint64)
    for k in range(size):  # short grams keep their size in the first byte; what meets is verified anyway
        value |= data[place + k].astype(np.uint64) << np.uint64(8 * (k + short))
    return place, value, of


def _phrase_grams(phrases: DataFrame) -> DataFrame:
    """(phrase, gram, offset): all grams of long phrases and the one gram of short ones; offsets count characters."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, offsets = _bytes(batch.column(0))
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
            length = np.diff(offsets)
            for size in range(1, GRAM + 1):
                place, value, of = grams(data, offsets, size)
                take = (length[of] == size) | ((size == GRAM) & (length[of] > GRAM))
                place, value, of = place[take], value[take], of[take]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of)), pa.array(value.view(np.int64)), pa.array((chars[place] - chars[offsets[of]]).astype(np.int32))],
                    ["phrase", "gram", "offset"])

    return phrases.select("phrase").mapInArrow(run, "phrase string, gram bigint, offset int")


def _sample_counts(pages: DataFrame) -> DataFrame:
    """(gram, pages): in how many of the first few pages a gram of full size stands."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            data, offsets = _bytes(batch.column(0))
            place, value, of = grams(data, offsets, GRAM)
            both = np.unique(np.stack([value, of.astype(np.uint64)]), axis=1)
            value, n = np.unique(both[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["gram", "pages"])

    few = pages.sparkSession.createDataFrame(pages.limit(SAMPLE).toArrow())
    return few.mapInArrow(run, "gram bigint, pages bigint").groupBy("gram").agg(F.sum("pages").alias("pages"))


def anchors(phrases: DataFrame, sample: DataFrame) -> DataFrame:
    """(phrase, gram, offset): one anchor for each distinct phrase."""
    all_ = _phrase_grams(phrases)
    shared = all_.groupBy("gram").agg(F.count(F.lit(1)).alias("phrases"))
    rated = all_.join(shared, "gram").join(sample, "gram", "left")
    cost = F.struct(F.coalesce("pages", F.lit(0)), "phrases", "gram", "offset")
    return rated.groupBy("phrase").agg(F.min(cost).alias("a")).select("phrase", "a.gram", "a.offset")


def _places(pages: DataFrame, keys: Sequence[str], sizes: Sequence[int], wanted: np.ndarray, reach: int) -> DataFrame:
    """(keys, gram, at, back, low, own): places of grams in the map, with ``reach`` characters on both sides."""
    sent = pages.sparkSession.sparkContext.broadcast(wanted)
    around = max(BEFORE, AFTER)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _bytes(batch.column("__low"))
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])
            rows = []
            for size in sizes:
                for lo in range(0, len(data), BLOCK):
                    place, value, of = grams(data, offsets, size, lo, lo + BLOCK)
                    hit = holds(sent.value, value)
                    place, value, of = place[hit], value[hit], of[hit]
                    if size < GRAM:  # the whole phrase: only the first place on a page counts
                        order = np.lexsort((place, value, of))
                        new = np.ones(len(order), bool)
                        new[1:] = (value[order[1:]] != value[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
                        place, value, of = place[order[new]], value[order[new]], of[order[new]]
                    at = chars[place] - chars[offsets[of]]
                    rows += zip(of.tolist(), at.tolist(), value.view(np.int64).tolist(), [size] * len(at))
            seen, kept = set(), {n: [] for n in ("of", "gram", "at", "back", "low", "own", "lead")}
            low = own = None
            current = -1
            for of, at, gram, size in sorted(rows):
                if of != current:
                    current, low, own = of, batch.column("__low")[of].as_py(), batch.column("__text")[of].as_py()
                wide = reach if size == GRAM else size
                start = max(0, at - wide)
                context = low[start: at + wide]
                if (of, gram, at - start, context) in seen:  # the same surroundings once more: not the first hit of anything
                    continue
                seen.add((of, gram, at - start, context))
                front = max(0, start - around)
                for name, x in zip(kept, (of, gram, at, at - start, context, own[front: at + wide + around], at - front)):
                    kept[name].append(x)
            taken = pa.array(kept["of"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(taken) for k in keys], pa.array(kept["gram"], pa.int64()), *[pa.array(kept[n], pa.int32()) for n in ("at", "back")],
                 pa.array(kept["low"], pa.string()), pa.array(kept["own"], pa.string()), pa.array(kept["lead"], pa.int32())],
                [*keys, "__gram", "__at", "__back", "__low", "__own", "__lead"])

    fields = [pages.schema[k] for k in keys] + [
        T.StructField("__gram", T.LongType()), T.StructField("__at", T.IntegerType()), T.StructField("__back", T.IntegerType()),
        T.StructField("__low", T.StringType()), T.StructField("__own", T.StringType()), T.StructField("__lead", T.IntegerType())]
    return pages.select(*keys, "__low", "__text").mapInArrow(run, T.StructType(fields))


def search_table(
    pages: DataFrame, phrases: DataFrame, keys: Sequence[str] = ("doc_id", "page"), phrase: str = "phrase", case_sensitive: bool = False, min_chars: int = 1
) -> DataFrame:
    """First hit of every phrase on every page: (keys, the columns of ``phrases``, at, before, match, after).

    ``pages`` is (keys, text, ...). ``at`` is the 1-based place. Phrases are trimmed, those under ``min_chars`` characters find
    nothing, and equal ones are searched once. Keys should tell pages apart; pages with equal keys are one page. Null
    phrases and texts find nothing; an empty table on either side gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    keys = list(keys)

    def searched(c: Column) -> Column:
        return c if case_sensitive else F.lower(c)

    trimmed = F.trim(F.col(phrase))
    listed = phrases.withColumn("__phrase", searched(trimmed)).filter(F.length(trimmed) >= max(1, min_chars))
    place = shared_folder(spark, "anchors")
    read = pages.filter(F.col("text").isNotNull()).select(*keys, searched(F.col("text")).alias("__low"), F.col("text").alias("__text"))
    distinct = listed.select(F.col("__phrase").alias("phrase")).distinct()
    anchors(distinct, _sample_counts(read.select("__low"))).write.parquet(place)
    chosen = spark.read.parquet(place)
    length, bytes_ = F.length("phrase"), F.least(F.octet_length("phrase"), F.lit(GRAM))
    known = chosen.agg(F.max(length), F.collect_set(bytes_)).first()  # one length and at most eight sizes
    reach, sizes = known[0] or 0, sorted(known[1])

    hits = _places(read, keys, sizes, bit_map(chosen, "gram"), reach)
    matched = hits.join(chosen.withColumnsRenamed({"gram": "__gram", "phrase": "__phrase", "offset": "__offset"}), "__gram")
    start = F.col("__back") - F.col("__offset")
    matched = matched.filter((start >= 0) & (F.substring("__low", start + 1, F.length("__phrase")) == F.col("__phrase")))
    begin = F.col("__lead") - F.col("__offset")  # of the match in the piece of the page's own text, 0-based
    size = F.length("__phrase")
    shown = F.greatest(begin - BEFORE, F.lit(0))
    hit = F.struct(
        (F.col("__at") - F.col("__offset") + 1).alias("at"),
        F.substring("__own", shown + 1, begin - shown).alias("lead"),
        F.substring("__own", begin + 1, size).alias("match"),
        F.substring("__own", begin + 1 + size, F.lit(AFTER)).alias("tail"),
    )
    first = matched.groupBy(*keys, "__phrase").agg(F.min(hit).alias("__hit"))

    def squeeze(value: Column) -> Column:
        return F.regexp_replace(value, INNER_SPACE, " ")

    named = first.join(listed, "__phrase")
    return named.select(
        *keys, *phrases.columns, F.col("__hit.at").cast("bigint").alias("at"),
        F.concat(F.when(F.col("__hit.at") > BEFORE + 1, "…").otherwise(""), squeeze(F.col("__hit.lead"))).alias("before"),
        F.col("__hit.match").alias("match"), F.concat(squeeze(F.col("__hit.tail")), F.lit("…")).alias("after"))
