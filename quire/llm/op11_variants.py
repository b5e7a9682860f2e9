"""Spelling variants grouped over a reduced alphabet.

Words that occur often enough are written in a reduced alphabet: every letter becomes one of ``SYMBOLS`` symbols. Two words
one edit apart are equal or one edit apart in reduced form too, so each word generates the full one-edit neighbourhood of
its reduced form (itself, every deletion, replacement and insertion of a symbol, as 64-bit codes), the neighbourhoods meet
the reduced vocabulary in an equi-join, and what meets is verified on the original strings. A word's form is the near word that occurs
most, if it occurs ``ratio`` times as often; forms lead to a root. Counts at least double from form to form, so pointer
doubling ends after a few rounds.

Occurrences are found over the bytes of a batch of texts and counted there, so a frequent word is one row a batch. The
vocabulary is a table in the shared folder and is never gathered: what is as long as it, or its many times longer
neighbourhoods, joins by merging. Left to choose, Spark sizes them by their compressed files, the neighbourhoods by the file
of the words they were made of, and sends them through the driver.

Edge cases: a null or letterless text has no words; a null id counts as an empty id; a text is read whole, however long;
repeated rows count again; of near words with equal counts the smallest by code points is the form; an empty table gives no
rows. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.plans.bits import bit_map, holds
from quire.session import shared_folder

SYMBOLS = 8
MIN_CHARS, MIN_COUNT, RATIO = 5, 3, 2
#: One run in so many loses a letter before it is counted; 0 leaves all runs as they are.
SLIP = 97
#: Runs of more bytes than this get their checksum one by one.
LONG_RUN = 64
#: Words of one length whose neighbourhoods are made at once.
AT_ONCE = 1 << 14

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), 0xC3]] = True  # 0xC3 leads U+00C0 to U+00FF


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    """Maximal runs of Latin letters, a to z in lower case."""
    inside = LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    marks = np.where(inside, np.uint8(97), np.uint8(32))
    return W.split(marks, offsets)._replace(data=W.LOWER[data])


def continued_crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """CRC-32 of each span after a prefix whose CRC-32 is ``seed``."""
    size = end - start
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(-size, kind="stable")
    for i in order[: np.count_nonzero(size > LONG_RUN)]:
        out[i] = zlib.crc32(data[start[i]: end[i]].tobytes(), int(seed[i]))
    order = order[np.count_nonzero(size > LONG_RUN):]
    state, at, left = ~seed[order], start[order], size[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k, "left"))  # spans with more than k bytes stand first
        state[:n] = CRC[(state[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
    out[order] = ~state
    return out


def _counted(batch: pa.RecordBatch, min_chars: int, slip: int) -> tuple[list[str], list[int]]:
    data, offsets = W.texts(batch.column("text"))
    runs = letter_runs(data, offsets)
    wide = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) == 0x80, out=wide[1:])
    chars = runs.end - runs.start - (wide[runs.end] - wide[runs.start])
    take = np.flatnonzero(chars >= min_chars)
    start, end, chars = runs.start[take], runs.end[take], chars[take]
    slipped = Counter()
    if slip and len(take):
        seeds = np.array([zlib.crc32(f"{key or ''}:".encode()) for key in batch.column("key").to_pylist()], np.uint32)
        h = continued_crc(runs.data, start, end, seeds[runs.text()[take]])
        hit = h % np.uint32(slip) == 0
        for i in np.flatnonzero(hit).tolist():
            word, drop = runs.data[start[i]: end[i]].tobytes().decode(), int(h[i]) % int(chars[i])
            if len(word) > min_chars:
                slipped[word[:drop] + word[drop + 1:]] += 1
        start, end = start[~hit], end[~hit]
    _, first, n = np.unique(W.span_hashes(runs.data, start, end), return_index=True, return_counts=True)
    raw = runs.data.tobytes()
    found = [raw[s:e].decode() for s, e in zip(start[first].tolist(), end[first].tolist())]
    return found + list(slipped), n.tolist() + list(slipped.values())


def word_counts(
    documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int = SLIP
) -> DataFrame:
    """(word, n) of every word with enough letters and occurrences."""
    W.arrow_batches(documents.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found, n = _counted(batch, min_chars, slip)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    chosen = documents.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def symbol_table(symbols: int) -> np.ndarray:
    """The symbol of each code point up to U+00FF, from 1: the code point modulo the number of symbols."""
    return (np.arange(256) % symbols + 1).astype(np.uint64)


def _code(total: np.ndarray, length: int) -> np.ndarray:
    return W.mixed(total + np.uint64(length) * W.OF_BYTE[11])


def reduced_codes(forms: np.ndarray) -> np.ndarray:
    """64-bit codes of reduced words of one length, one in a row."""
    total = np.zeros(len(forms), np.uint64)
    for k in range(forms.shape[1]):
        total = total * W.BASE + forms[:, k]
    return _code(total, forms.shape[1])


def neighbourhood(forms: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """Codes of the reduced words themselves and of all that are one edit from them; some come more than once."""
    n, size = forms.shape
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size + 1, W.BASE, np.uint64), dtype=np.uint64)])
    front = [np.zeros(n, np.uint64)]
    for k in range(size):
        front.append(front[-1] * W.BASE + forms[:, k])
    back = [front[size] - front[k] * power[size - k] for k in range(size + 1)]
    yield _code(front[size], size)
    for k in range(size):
        yield _code(front[k] * power[size - 1 - k] + back[k + 1], size - 1)
        for s in range(1, symbols + 1):
            yield _code(front[k] * power[size - k] + np.uint64(s) * power[size - 1 - k] + back[k + 1], size)
    for k in range(size + 1):
        for s in range(1, symbols + 1):
            yield _code(front[k] * power[size + 1 - k] + np.uint64(s) * power[size - k] + back[k], size + 1)


def _by_length(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[tuple[list[str], list[int], np.ndarray]]:
    """(words, their counts, reduced words as rows of symbols) in portions of one length."""
    table, held, count = symbol_table(symbols), {}, 0

    def portions():
        for size, (words, numbers) in held.items():
            letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, size)
            for a in range(0, len(words), AT_ONCE):
                yield words[a: a + AT_ONCE], numbers[a: a + AT_ONCE], table[letters[a: a + AT_ONCE]]

    for batch in batches:
        for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, numbers = held.setdefault(len(word), ([], []))
            words.append(word)
            numbers.append(n)
            count += 1
        if count >= AT_ONCE:
            yield from portions()
            held, count = {}, 0
    yield from portions()


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of (word, n) exactly one edit apart.

    A generated code that the bit map of the reduced vocabulary lacks is dropped where it was made; the map has a fixed size.
    """
    spark = words.sparkSession

    def codes(batches):
        for found, n, forms in _by_length(batches, symbols):
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), pa.array(n, pa.int64()), pa.array(reduced_codes(forms).view(np.int64))], ["near", "near_n", "code"])

    place, counted = shared_folder(spark, "reduced"), words.select("word", "n")
    counted.mapInArrow(codes, "near string, near_n bigint, code bigint").write.parquet(place)
    vocabulary = spark.read.parquet(place)
    sent = spark.sparkContext.broadcast(bit_map(vocabulary, "code"))

    def generate(batches):
        for found, _, forms in _by_length(batches, symbols):
            at, code = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for near in neighbourhood(forms, symbols):
                hit = np.flatnonzero(holds(sent.value, near))
                at.append(hit)
                code.append(near[hit])
            at, code = np.concatenate(at), np.concatenate(code)
            order = np.lexsort((code, at))
            at, code = at[order], code[order]
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()).take(pa.array(at[new])), pa.array(code[new].view(np.int64))], ["word", "code"])

    left = counted.mapInArrow(generate, "word string, code bigint")
    return left.join(vocabulary.hint("merge"), "code").filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def roots(forms: DataFrame, most: int, least: int = MIN_COUNT, ratio: float = RATIO) -> DataFrame:
    """(word, root) of every (word, form): counts rise from ``least`` to ``most`` by ``ratio`` a step, which bounds the chain."""
    spark = forms.sparkSession
    longest = 1 + max(0, math.ceil(math.log(max(most, least) / least) / math.log(ratio)))
    table = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = table.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        path = shared_folder(spark, "roots")
        table.join(further.hint("merge"), "root", "left").select("word", F.coalesce("__next", "root").alias("root")).write.parquet(path)
        table = spark.read.parquet(path)
    return table


def variants(
    documents: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
    ratio: int = RATIO, symbols: int = SYMBOLS, slip: int = SLIP,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    spark = documents.sparkSession
    place, chosen = shared_folder(spark, "vocabulary"), shared_folder(spark, "forms")
    word_counts(documents, key, text, min_chars, min_count, slip).write.parquet(place)
    words = spark.read.parquet(place)
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near"))
    near = near_pairs(words, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("__best"))
    known = words.join(near.hint("merge"), "word", "left")
    strong = -F.col("__best.minus_n") >= ratio * F.col("n")
    known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("__best.near")).alias("form"),
        F.when(strong, -F.col("__best.minus_n")).alias("form_n"),
    ).write.parquet(chosen)
    table = spark.read.parquet(chosen)
    most = table.agg(F.max("n")).first()[0] or 0
    ends = roots(table.filter(F.col("form").isNotNull()), most, min_count, ratio)
    return table.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of all documents."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a Latin text in SQL; a byte's table entry is the sum of those of its bits."""
    entry = "0"
    for bit in range(8):
        entry = f"xor({entry}, ((xor(c, b) >> {bit}) & 1) * {int(CRC[1 << bit])})"
    code = "unicode(ch)::BIGINT"
    octets = f"flatten(list_transform(string_split({text}, ''), lambda ch: CASE WHEN {code} < 128 THEN [{code}] ELSE [192 + ({code} >> 6), 128 + ({code} & 63)] END))"
    return f"xor(list_reduce({octets}, lambda c, b: xor(c >> 8, {entry}), 4294967295::BIGINT), 4294967295)"


SQL = rf"""
    WITH RECURSIVE runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w
        FROM documents),
    counted AS (SELECT d, w, count(*) AS n FROM runs GROUP BY ALL),
    hashed AS (SELECT w, n, {_crc_sql("concat(d, ':', w)")} AS h FROM counted WHERE length(w) >= {MIN_CHARS}),
    slipped AS (
        SELECT CASE WHEN h % {SLIP} = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, n FROM hashed),
    words AS MATERIALIZED (
        SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
    cuts AS MATERIALIZED (
        SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
    best AS (
        SELECT word, near, n AS near_n, count(*) OVER (PARTITION BY word) AS n_near FROM pairs
        QUALIFY row_number() OVER (PARTITION BY word ORDER BY n DESC, near) = 1),
    forms AS MATERIALIZED (
        SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= {RATIO} * w.n THEN near END AS form,
               CASE WHEN near_n >= {RATIO} * w.n THEN near_n END AS form_n
        FROM words w LEFT JOIN best USING (word)),
    climb AS (
        SELECT word, word AS top, 0 AS steps FROM forms
        UNION ALL SELECT c.word, f.form, steps + 1 FROM climb c JOIN forms f ON c.top = f.word WHERE f.form IS NOT NULL)
    SELECT word, any_value(form) AS form, arg_max(top, steps) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
    FROM climb JOIN forms USING (word) GROUP BY word
"""
