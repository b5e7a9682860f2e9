"""Quality rules, lines first: bad lines go, then documents that lost too much.

A line fails if it reads as navigation (a separator stands among every five words), as boilerplate (it holds a phrase of
``PHRASES``), as noise (over a symbol in every four words), as shouting (ten letters or more, over half of them A-Z),
or as a fragment without punctuation (no closing mark at its end and under eight words). A document is kept if it passes the
base rules and if at least ``min_share`` of its words stand in lines that passed.

All of it is counted over the bytes of many texts at once; words are hashed to 64 bits for the repeats.

Edge cases: a null text has no words, and a text without words fails the base rules; lines without a word neither pass nor
fail; a text is judged whole, however long; repeated rows are judged alike; an empty table gives no rows. Other columns
are kept; names that clash with result columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import words as W

# fixed values: phrases of page furniture, lower case
PHRASES = [
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "click here", "sign in", "log in", "subscribe to", "share this", "powered by", "skip to content",
]
CLOSING = b".!?:;\"')]"
CLOSING_WIDE = [b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xc2\xbb"]  # … ” »
MIN_SHARE = 0.5
NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "base_failed", "kept", "clean_text"]


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


SYMBOL, UPPER, LOWER_CASE = _flags(b"#*$%&|<>"), _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
CHAR = np.array([(b & 0xC0) != 0x80 and b not in (32, 9, 10, 11, 12, 13) for b in range(256)], np.int64)
CLOSES = _flags(CLOSING).astype(bool)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of the values between neighbouring bounds."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def repeated_words(words: W.Words, n: int = 5) -> np.ndarray:
    """For each text, words in windows of n words that stand in it twice or more."""
    text = words.text()
    key = W.windows(W.word_hashes(words), n)
    ok = np.flatnonzero(W.fits(words.first, n)[: len(key)])
    codes, _ = pd.factorize(W.mixed(key[ok] + text[ok].astype(np.uint64) * W.BASE))
    twice = ok[np.bincount(codes)[codes] > 1] if len(ok) else ok
    change = np.zeros(len(text) + n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + n, -1)
    return _sums(np.cumsum(change)[: len(text)] > 0, words.first)


def judge(words: W.Words, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(counts of each text, bounds of all lines, whether each line passed)."""
    data, n = words.data, len(offsets) - 1
    breaks = np.flatnonzero(data == 10) + 1
    bounds = np.unique(np.concatenate([breaks, offsets]))  # a line is between two bounds, its newline included
    if len(bounds) < 2:
        bounds = np.array([0, len(data)])
    start, end = bounds[:-1], bounds[1:]
    of = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(words.start, bounds)
    n_words = np.diff(first)
    full = n_words > 0

    size = words.end - words.start
    # the separators | > » ·, alone as a word
    one = (size == 1) & np.isin(data[words.start], [ord("|"), ord(">")]) if len(size) else np.zeros(0, bool)
    two = np.flatnonzero(size == 2)
    one[two] |= (data[words.start[two]] == 0xC2) & np.isin(data[words.start[two] + 1], [0xBB, 0xB7])
    upper, lower = _sums(UPPER[data], bounds), _sums(LOWER_CASE[data], bounds)
    tail = np.zeros(len(start), np.int64)
    tail[full] = words.end[first[1:][full] - 1]
    closed = np.zeros(len(start), bool)
    closed[full] = CLOSES[data[tail[full] - 1]]
    for mark in CLOSING_WIDE:
        k = len(mark)
        fit = np.flatnonzero(full & (tail - start >= k))
        same = np.ones(len(fit), bool)
        for i, b in enumerate(mark):
            same &= data[tail[fit] - k + i] == b
        closed[fit] |= same
    bad = 5 * _sums(one, first) >= n_words
    bad |= 4 * _sums(SYMBOL[data], bounds) > n_words
    bad |= (upper + lower >= 10) & (2 * upper > upper + lower)
    bad |= ~closed & (n_words < 8)
    raw = W.LOWER[data].tobytes()
    for phrase in PHRASES:
        at = raw.find(phrase.encode())
        while at >= 0:
            line = int(np.searchsorted(bounds, at, "right")) - 1
            bad[line] |= at + len(phrase) <= end[line]
            at = raw.find(phrase.encode(), at + 1)
    passed = full & ~bad

    stop = end - (data[np.maximum(end - 1, 0)] == 10) if len(data) else end
    hashes = W.span_hashes(data, start[full], stop[full])
    codes, _ = pd.factorize(W.mixed(hashes + of[full].astype(np.uint64) * W.BASE))
    again = np.ones(len(codes), bool)
    again[np.unique(codes, return_index=True)[1]] = False
    counts = {
        "n_words": np.diff(words.first),
        "word_chars": _sums(CHAR[data], offsets),
        "n_symbols": _sums(SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(of[full][again], minlength=n),
        "n_repeat_words": repeated_words(words),
        "n_kept_words": np.bincount(of[passed], n_words[passed], n).astype(np.int64),
    }
    return counts, bounds, passed


def quality(documents: DataFrame, min_share: float = MIN_SHARE, text: str = "text", with_text: bool = True) -> DataFrame:
    """Documents with the counts, base_failed, kept and, if asked for, clean_text: the lines that passed."""
    kept_columns = documents.select(*[c for c in documents.columns if c not in NEW])
    place = kept_columns.columns.index(text)

    def run(batch: pa.RecordBatch, words: W.Words):
        _, offsets = W.texts(batch.column(place))
        counts, bounds, passed = judge(words, offsets)
        failed = (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])
        kept = ~failed & (counts["n_kept_words"] >= min_share * counts["n_words"])
        out = [pa.array(v.astype(np.int64)) for v in counts.values()] + [pa.array(failed), pa.array(kept)]
        if with_text:
            lines = np.searchsorted(bounds, offsets)
            raw, clean = words.data.tobytes(), []
            for a, b in zip(lines, lines[1:]):
                clean.append("".join(raw[bounds[k]: bounds[k + 1]].decode() for k in range(a, b) if passed[k]))
            out.append(pa.array(clean, pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, *NEW[: len(out)]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_columns.schema)
    new = ", ".join(f"{c} {'bigint' if c[:2] in ('n_', 'wo') else 'boolean'}" for c in NEW[:-1]) + ", clean_text string" * with_text
    return W.per_text(kept_columns, run, f"{schema}, {new}", text)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """The base counts and the verdict on every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(documents, with_text=False).drop("text")


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
                     regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line FROM (SELECT r, string_split(text, chr(10)) AS l FROM docs)),
counted AS (
    SELECT r, k, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w,
           len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
           len(regexp_extract_all(line, '[A-Z]')) AS upper, len(regexp_extract_all(line, '[A-Za-z]')) AS letters,
           lower(line) AS low FROM lines),
judged AS (
    SELECT r, k, line, len(w) AS n,
           NOT (5 * len(list_filter(w, lambda x: x IN ('|', '>', '»', '·'))) >= len(w) OR 4 * symbols > len(w)
                OR (letters >= 10 AND 2 * upper > letters)
                OR (len(w) < 8 AND NOT regexp_matches(w[len(w)], '[.!?:;"'')\]…”»]$'))
                OR regexp_matches(low, 'all rights reserved|accept cookies|cookie policy|privacy policy|terms of use|terms of service|enable javascript|click here|sign in|log in|subscribe to|share this|powered by|skip to content')) AS passed
    FROM counted WHERE len(w) > 0),
by_line AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE passed), 0) AS n_kept_words FROM judged GROUP BY r),
windows AS (SELECT r, k, array_to_string(w[k:k + 4], ' ') AS v FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS k FROM docs)),
twice AS (SELECT r, k, count(*) OVER (PARTITION BY r, v) AS n FROM windows),
repeats AS (SELECT r, count(DISTINCT x) AS n_repeat_words FROM (SELECT r, unnest(range(k, k + 5)) AS x FROM twice WHERE n > 1) GROUP BY r),
base AS (
    SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
           coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_kept_words, 0)::BIGINT AS n_kept_words
    FROM docs LEFT JOIN by_line USING (r) LEFT JOIN repeats USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_kept_words >= 0.5 * n_words AS kept FROM base
"""
