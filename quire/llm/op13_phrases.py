"""Phrase collocations by best-first branch and bound over prefix counts.

A phrase grows to the right from its first word. Whatever follows, its score at the first cut is at most 1000 * n / f(first
word), because the whole occurs no more often than its rest; by the last cut the same holds for the last word. Words are
therefore the roots of the frontier, rarest first, and a round expands all roots up to a frequency: it counts the phrases
that begin or end with one of them, which holds every cut of every phrase between two of them and every phrase one word
longer. Phrases grow through frequent parts only. A language is settled when its 2000th surviving score is above the bound
of the first word that was not expanded, so ties are in, or when no word is left. Otherwise the next round goes down to the
bound that the scores found so far prove to be enough, or, with too few of them, to ``STEP`` times the words.

A phrase is dropped if a longer candidate holds it and occurs as often; counts only fall as phrases grow, so it is enough to
look at phrases one word longer.

Words, pieces and counts are found over the bytes of a batch of texts; a language's words have hashes of their own, 64 bits
wide. What a task must know of the frontier is bit maps of ``2**BITS`` hashed places: a wrong bit costs rows, never a
result. Counts, cuts and ranks are tables; nothing of the corpus is gathered, and the driver sees one row of totals a round.

Edge cases: a null text has no words, a null language is ``und``; a text is read whole, however long; repeated rows count
again; equal scores rank by a, then by the bytes of the phrase; an empty table gives no rows. Only the text and the language
are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.session import shared_folder

LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: The first round expands the rarest words that hold this share of all occurrences, later ones so many times more.
SHARE, STEP = 1 / 8, 8
BITS = 25
#: Distinct phrases a task holds before it hands them on.
HELD = 1 << 19

CUT = b".,;:!?\n\x0b\x0c\r"
APART, ENDS = np.zeros(256, bool), np.zeros(256, bool)
APART[[0x20, 0x09, *CUT]] = True
ENDS[list(CUT)] = True

COUNTS = "size int, phrase bigint, head bigint, tail bigint, inner boolean, n bigint"


class Tokens:
    """Words of a batch: a hash for each, seeded by its language, and the piece it is in."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = W.texts(batch.column("text"))
        data = W.LOWER[data]
        self.words = W.split(data, offsets, APART)
        cuts = np.zeros(len(data) + 1, np.int64)
        np.cumsum(ENDS[data], out=cuts[1:])
        text = self.words.text()
        self.piece = cuts[self.words.start] + text
        self.langs = batch.column("lang").to_pylist()
        seeds = np.array([zlib.crc32(x.encode()) << 32 | len(x) for x in self.langs], np.uint64)
        self.text = text
        self.hashes = W.mixed(W.word_hashes(self.words) ^ W.mixed(seeds)[text])

    def windows(self, k: int) -> np.ndarray:
        return W.windows(self.hashes, k)

    def whole(self, k: int) -> np.ndarray:
        """Places where k words stand in one piece."""
        n = max(0, len(self.piece) - k + 1)
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1: k - 1 + n])


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = _slot(hashes)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def bit_map(hashes: DataFrame, column: str = "phrase") -> np.ndarray:
    """The hashed places of a table of hashes; its size is fixed."""
    slot = F.shiftrightunsigned(F.col(column), 64 - BITS)
    rows = hashes.groupBy(F.bitmap_bucket_number(slot + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits")).collect()
    bits = np.zeros((1 << BITS) // 8, np.uint8)
    for bucket, raw in rows:  # buckets count from 1
        part = np.frombuffer(raw, np.uint8)
        bits[(bucket - 1) * len(part): bucket * len(part)] = part[: len(bits) - (bucket - 1) * len(part)]
    return bits


def chosen(documents: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    W.arrow_batches(documents.sparkSession)
    return documents.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))


def word_counts(docs: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, n) of frequent words, and of all words together with a null phrase."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = Tokens(batch)
            hashes = tokens.windows(1)
            value, first, n = np.unique(hashes, return_index=True, return_counts=True)
            langs = np.array(tokens.langs, object)
            names, of = np.unique(langs.astype(str), return_inverse=True)
            total = np.bincount(of[tokens.text], minlength=len(names))
            lang = langs[tokens.text[first]].tolist() + names.tolist()
            phrase = pa.array(np.concatenate([value.view(np.int64), np.zeros(len(names), np.int64)]),
                              mask=np.arange(len(value) + len(names)) >= len(value))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), phrase, pa.array(np.concatenate([n, total]).astype(np.int64))], ["lang", "phrase", "n"])

    counts = docs.mapInArrow(run, "lang string, phrase bigint, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("phrase").isNull() | (F.col("n") >= min_count))


def _merged(held: list[np.ndarray]) -> np.ndarray:
    """Rows (size, phrase, head, tail, inner, n) with equal phrases added up."""
    table = np.concatenate(held, axis=1)
    _, first, of = np.unique(table[1], return_index=True, return_inverse=True)
    out = table[:, first]
    out[5] = np.bincount(of, weights=table[5].astype(np.float64), minlength=len(first)).astype(np.uint64)
    return out


def _batch(table: np.ndarray) -> pa.RecordBatch:
    size, phrase, head, tail, inner, n = table
    return pa.RecordBatch.from_arrays(
        [pa.array(size.astype(np.int32)), pa.array(phrase.view(np.int64)), pa.array(head.view(np.int64)), pa.array(tail.view(np.int64)),
         pa.array(inner.astype(bool)), pa.array(n.astype(np.int64))], ["size", "phrase", "head", "tail", "inner", "n"])


def phrase_counts(docs: DataFrame, sizes: range, frequent, frontier, pairs, min_count: int) -> DataFrame:
    """Frequent phrases of the sizes that begin or end with a word of the frontier.

    ``inner`` says that both ends are of the frontier. ``head`` and ``tail`` are the phrase without its last and its first
    word. With ``pairs``, the frequent pairs of the frontier, only phrases whose pairs are frequent or unknown are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = Tokens(batch)
            w1 = tokens.windows(1)
            known, near = _has(frequent.value, w1), _has(frontier.value, w1)
            passes = known[:-1] & known[1:]
            if pairs is not None:
                w2 = tokens.windows(2)
                passes[passes] &= ~(near[:-1] | near[1:])[passes] | _has(pairs.value, w2[passes])
            for k in sizes:
                at = tokens.whole(k)
                at = at[near[at] | near[at + k - 1]]
                for step in range(k - 1):
                    at = at[passes[at + step]]
                if not len(at):
                    continue
                whole, part = tokens.windows(k)[at], tokens.windows(k - 1)
                value, first, n = np.unique(whole, return_index=True, return_counts=True)
                at = at[first]
                held.append(np.stack([np.full(len(at), k, np.uint64), value, part[at], part[at + 1],
                                      (near[at] & near[at + k - 1]).astype(np.uint64), n.astype(np.uint64)]))
                rows += len(at)
            if rows >= HELD:
                yield _batch(_merged(held))
                held, rows = [], 0
        if held:
            yield _batch(_merged(held))

    key = ["size", "phrase", "head", "tail", "inner"]
    return docs.mapInArrow(run, COUNTS).groupBy(*key).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def with_cuts(words: DataFrame, counts: DataFrame, longest: int) -> DataFrame:
    """(lang, total, size, phrase, inner, a, dropped, cuts): cuts is an array of (k, l, r); phrases with an unknown part are left out."""
    level = words.select("lang", "total", "phrase", F.col("n").alias("a"), F.array().cast("array<bigint>").alias("heads"), F.array().cast("array<bigint>").alias("tails"))
    out = None
    for size in range(2, longest + 1):
        here = counts.filter(F.col("size") == size)
        head = level.select("lang", "total", F.col("phrase").alias("head"), F.concat("heads", F.array("a")).alias("heads"))
        tail = level.select(F.col("phrase").alias("tail"), F.concat("tails", F.array("a")).alias("tails"))
        # each level is read by both ends of the next one, so it is written
        level = _saved(here.join(head, "head").join(tail, "tail").select(
            "lang", "total", "size", "phrase", "inner", F.col("n").alias("a"), "heads", "tails"), "cuts")
        out = level if out is None else out.unionByName(level)
    longer = counts.filter(F.col("size") > 2).select(F.explode(F.array("head", "tail")).alias("phrase"), "n")
    longer = longer.groupBy("phrase").agg(F.max("n").alias("__longer"))
    return out.join(longer, "phrase", "left").select(
        "lang", "total", "size", "phrase", "inner", "a", F.coalesce(F.col("__longer") >= F.col("a"), F.lit(False)).alias("dropped"),
        F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(
            k.alias("k"), F.get("heads", k - 1).alias("l"), F.get("tails", F.col("size") - k - 1).alias("r"))).alias("cuts"))


def scored(candidates: DataFrame) -> DataFrame:
    """Add score, l and r of the lowest-scoring cut, the first of equals; exact in decimals."""
    def wide(c: Column) -> Column:
        return c.cast("decimal(18,0)")

    def cut(c: Column) -> Column:
        above = (wide(F.col("a")) * wide(F.col("total"))).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
        return F.struct(F.call_function("div", above, (wide(c["l"]) * wide(c["r"])).cast("decimal(38,0)")).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))

    least = candidates.withColumn("__cut", F.array_min(F.transform("cuts", cut)))
    return least.select(*[c for c in candidates.columns if c != "cuts"], "__cut.score", "__cut.l", "__cut.r")


def first_frontier(words: DataFrame, totals: DataFrame, share: Column) -> DataFrame:
    """(lang, upto): the greatest power of two up to which words hold no more than the share, at least that of the rarest."""
    steps = words.groupBy("lang", F.ceil(F.log2(F.col("n").cast("double"))).alias("step")).agg(F.sum("n").alias("held"), F.max("n").alias("most"))
    along = Window.partitionBy("lang").orderBy("step")  # one row for each power of two
    steps = steps.withColumn("sum", F.sum("held").over(along)).withColumn("place", F.row_number().over(along))
    steps = steps.join(totals, "lang").filter((F.col("sum") <= share * F.col("total")) | (F.col("place") == 1))
    return steps.groupBy("lang").agg(F.max("most").alias("upto"))


def names(docs: DataFrame, finalists: DataFrame, longest: int) -> DataFrame:
    """(phrase, words): the words of the phrases, read from the texts."""
    wanted = docs.sparkSession.sparkContext.broadcast(bit_map(finalists))

    def run(batches):
        seen = set()
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = Tokens(batch)
            raw = tokens.words.data.tobytes()
            out = {}
            for k in range(2, longest + 1):
                at = tokens.whole(k)
                hashes = tokens.windows(k)[at]
                take = _has(wanted.value, hashes)
                value, first = np.unique(hashes[take], return_index=True)
                for h, i in zip(value.view(np.int64).tolist(), at[take][first].tolist()):
                    if h not in seen:
                        s, e = tokens.words.start[i: i + k].tolist(), tokens.words.end[i: i + k].tolist()
                        out[h] = " ".join(raw[a:b].decode("utf-8", "replace") for a, b in zip(s, e))
            if len(seen) < HELD:  # a task may name a phrase again, which costs a row
                seen.update(out)
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.string())], ["phrase", "words"])

    return docs.mapInArrow(run, "phrase bigint, words string").join(finalists.select("phrase"), "phrase", "left_semi").groupBy("phrase").agg(
        F.min("words").alias("words"))


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collocations(
    documents: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, longest: int = LONGEST, share: float = SHARE
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    spark = documents.sparkSession
    send = spark.sparkContext.broadcast
    docs = chosen(documents, text, lang)
    counted = _saved(word_counts(docs, min_count), "words")
    totals = counted.filter(F.col("phrase").isNull()).select("lang", F.col("n").alias("total"))
    words = counted.filter(F.col("phrase").isNotNull())
    frequent = send(bit_map(words))
    finals = []
    state = _saved(first_frontier(words, totals, F.lit(share)), "frontier")
    while True:
        share *= STEP
        open_ = words.join(totals, "lang").join(state, "lang")
        frontier = send(bit_map(open_.filter(F.col("n") <= F.col("upto"))))
        two = _saved(phrase_counts(docs, range(2, 3), frequent, frontier, None, min_count), "pairs")
        more = _saved(phrase_counts(docs, range(3, longest + 1), frequent, frontier, send(bit_map(two)), min_count), "phrases") if longest > 2 else two.limit(0)
        found = scored(with_cuts(open_, two.unionByName(more), longest)).filter(F.col("inner") & ~F.col("dropped"))
        place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
        best = _saved(found.withColumn("place", place).filter(F.col("place") <= top), "best")
        ends = best.groupBy("lang").agg(F.count(F.lit(1)).alias("held"), F.min("score").alias("last"))
        beyond = words.join(state, "lang").filter(F.col("n") > F.col("upto")).groupBy("lang").agg(F.min("n").alias("next"))
        held = F.coalesce("held", F.lit(0)) >= top
        status = _saved(
            state.join(totals, "lang").join(ends, "lang", "left").join(beyond, "lang", "left").join(
                first_frontier(words, totals, F.lit(share)).withColumnRenamed("upto", "wider"), "lang"
            ).select(
                "lang",
                (F.col("next").isNull() | (held & (F.col("last") > F.expr("1000 * total div next")))).alias("settled"),
                # enough for the scores found, or so many words more
                F.when(held, F.expr("1000 * total div greatest(last, 1)")).otherwise(F.greatest("wider", F.col("upto") * 2)).alias("upto"),
            ), "status")
        finals.append(best.join(status.filter("settled"), "lang", "left_semi"))
        state = status.filter(~F.col("settled")).select("lang", "upto")
        if state.isEmpty():
            break
    finalists = finals[0]
    for other in finals[1:]:
        finalists = finalists.unionByName(other)
    named = finalists.join(names(docs, finalists, longest), "phrase").drop("phrase").withColumnRenamed("words", "phrase")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return named.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    """The best phrases of two to five words of every language."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = r"""
    WITH RECURSIVE pieces AS (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    listed AS MATERIALIZED (
        SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    tokens AS MATERIALIZED (SELECT id, lang, len(w) AS size, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
    totals AS (SELECT lang, count(*)::BIGINT AS n FROM tokens GROUP BY lang),
    grams AS (
        SELECT lang, k, w[i : i + k - 1] AS p, count(*)::BIGINT AS f
        FROM tokens, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= size
        GROUP BY ALL HAVING count(*) >= 100),
    cuts AS (
        SELECT c.lang, c.p, c.k, c.f AS a, l.k AS cut, l.f AS l, r.f AS r, t.n,
               ((1000::HUGEINT * c.f * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
        FROM grams c JOIN grams l ON c.lang = l.lang AND l.k < c.k AND l.p = c.p[1 : l.k]
        JOIN grams r ON c.lang = r.lang AND r.p = c.p[l.k + 1 :] JOIN totals t ON c.lang = t.lang),
    least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
    kept AS (
        SELECT * FROM least c WHERE NOT EXISTS (
            SELECT 1 FROM grams g WHERE g.lang = c.lang AND g.k = c.k + 1 AND g.f >= c.a AND (g.p[1 : c.k] = c.p OR g.p[2 :] = c.p))),
    ranked AS (
        SELECT *, array_to_string(p, ' ') AS phrase FROM kept)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM ranked QUALIFY rank <= 2000
"""
