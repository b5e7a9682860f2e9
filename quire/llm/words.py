"""Words of a column of texts, found and hashed with numpy.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``), so words of UTF-8 text need no
decoding. Work arrays are bounded by ``BLOCK`` bytes or one word, whatever the length of a text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

BLOCK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"): ord("Z") + 1] += 32

# an odd base, its inverse modulo 2**64 and a random number for each byte
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
OF_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def arrow_batches(spark: SparkSession) -> None:
    """Small batches for tasks with Python: a batch holds at most 256 texts, or about 8 MB where Spark can cut by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class Words(NamedTuple):
    """Spans of all words in ``data``; those of text i are ``first[i]:first[i + 1]``, its bytes start at ``begin[i]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    begin: np.ndarray

    def text(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def strings(self, at: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[s:e].decode("utf-8", "replace") for s, e in zip(self.start[at].tolist(), self.end[at].tolist())]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; null counts as empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    where = np.frombuffer(offsets, np.int64, len(filled) + 1 + filled.offset)[filled.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[where[0]: where[-1]], where - where[0]


def split(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> Words:
    """Words are runs of bytes that ``apart`` does not hold."""
    inside = ~apart[data]
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = False
    after[edge - 1] = False
    start = np.flatnonzero(inside & ~before)
    return Words(data, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, offsets), offsets[:-1])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    if n:
        steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; the spans are in order and do not overlap."""
    out = np.zeros(len(start), np.uint64)
    cuts = [0]
    while cuts[-1] < len(start):  # spans that begin within one block, and its last one whole
        cuts.append(int(np.searchsorted(start, start[cuts[-1]] + BLOCK)))
    up, down = _powers(BASE, 0), _powers(INVERSE, 0)
    for a, b in zip(cuts, cuts[1:]):
        lo, hi = int(start[a]), int(end[b - 1])
        if hi - lo > len(up):
            up, down = _powers(BASE, hi - lo), _powers(INVERSE, hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(OF_BYTE[data[lo:hi]] * up[: hi - lo], out=sums[1:], dtype=np.uint64)
        s, e = start[a:b] - lo, end[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * OF_BYTE[7]
    return mixed(out)


def word_hashes(words: Words) -> np.ndarray:
    return span_hashes(words.data, words.start, words.end)


def fits(first: np.ndarray, n: int) -> np.ndarray:
    """Whether n words from a place on lie within one text, for each place."""
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(len(last)) + n <= last


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none and are left out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xFF51AFD7ED558CCD) + hashes[k: k + size]
    return mixed(total)


def per_text(df: DataFrame, function, schema: str, column: str = "text") -> DataFrame:
    """``function(batch, words)`` on every Arrow batch, ``words`` being those of ``column``."""
    arrow_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch, split(*texts(batch.column(column))))

    return df.mapInArrow(run, schema)
