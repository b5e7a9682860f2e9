"""Long lists of moves as maps of whole stretches.

A permutation of places is a piecewise shift: rows (lo, by) say that the places from ``lo`` up to the next ``lo`` go ``by``
places on. A block of moves is one such map with at most three pieces a move. Maps of neighbouring blocks are composed pair
by pair: the pieces of the first, where they end up, and those of the second are laid over each other by a scan, so a map of
any size is spread over ranges. Items take the shift of their piece by one more scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.plans.scan import scan_lasts, scan_numbers
from quire.session import shared_folder

#: Moves that one task replays.
BLOCK_MOVES = 2048


class Pieces:
    """Stretches of places in their present order."""

    def __init__(self, n: int):
        self.start, self.size = np.array([0], np.int64), np.array([n], np.int64)

    def _cut(self, place: int) -> int:
        """Index of the piece that begins at a place, cut if need be."""
        ends = np.cumsum(self.size)
        i = int(np.searchsorted(ends, place, "right"))
        inside = place - (int(ends[i - 1]) if i else 0)
        if i == len(ends) or not inside:
            return i
        self.start = np.insert(self.start, i + 1, self.start[i] + inside)
        self.size = np.insert(self.size, i + 1, self.size[i] - inside)
        self.size[i] = inside
        return i + 1

    def move(self, src: int, dst: int) -> None:
        i = self._cut(src)
        self._cut(src + 1)
        moved = self.start[i]
        self.start, self.size = np.delete(self.start, i), np.delete(self.size, i)
        j = self._cut(dst)
        self.start, self.size = np.insert(self.start, j, moved), np.insert(self.size, j, 1)

    def place(self, was: int) -> int:
        """Where the item now is that was at a place in the beginning."""
        i = int(np.flatnonzero((self.start <= was) & (was < self.start + self.size))[0])
        return int(self.size[:i].sum()) + was - int(self.start[i])

    def shifts(self) -> tuple[np.ndarray, np.ndarray]:
        """(lo, by) of every piece."""
        return self.start, np.cumsum(self.size) - self.size - self.start


def by_place(pieces: Pieces, src: int, dst: int) -> None:
    """A move from one place to another."""
    pieces.move(src, dst)


def by_item(pieces: Pieces, was: int, way: str | None) -> None:
    """A move of the item that was at a place when the block began."""
    last, now = int(pieces.size.sum()) - 1, pieces.place(was)
    dst = {"backward": now - 1, "forward": now + 1, "back": 0}.get(way, last)
    pieces.move(now, min(max(dst, 0), last))


def replayed(moves: DataFrame, keys: Sequence[str], to: str = "dst", replay: Callable = by_place) -> DataFrame:
    """(keys, block, lo, by) of (keys, block, no, src, to, n): one map for each block of moves; places count from 0."""
    group = [*keys, "block"]

    def run(batches: Iterator[pa.RecordBatch]):
        held, pieces, out, rows, kinds = None, None, [], 0, None

        def table() -> pa.RecordBatch:
            sizes = [len(lo) for _, lo, _ in out]
            columns = [pa.array([k[i] for k, _, _ in out], kinds[i]).take(pa.array(np.repeat(np.arange(len(out)), sizes))) for i in range(len(group))]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate([lo for _, lo, _ in out])), pa.array(np.concatenate([by for _, _, by in out]))], [*group, "lo", "by"])

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(group))]
            for *key, src, dst, n in zip(*[c.to_pylist() for c in batch.columns]):
                if key != held:
                    if held is not None:
                        out.append((held, *pieces.shifts()))
                        rows += len(out[-1][1])
                    held, pieces = key, Pieces(n)
                    if rows > 1 << 16:
                        yield table()
                        out, rows = [], 0
                replay(pieces, src, dst)
        if held is not None:
            out.append((held, *pieces.shifts()))
            yield table()

    dealt = moves.repartition(*group).sortWithinPartitions(*group, "no").select(*group, "src", to, "n")
    fields = [dealt.schema[k] for k in group] + [T.StructField("lo", T.LongType()), T.StructField("by", T.LongType())]
    return dealt.mapInArrow(run, T.StructType(fields))


def composed(maps: DataFrame, keys: Sequence[str], blocks: int) -> DataFrame:
    """(keys, lo, by): the maps of blocks 0, 1, ... of each key, one after another, as one map."""
    spark, keys = maps.sparkSession, list(keys)
    while blocks > 1:
        first = F.col("block") % 2 == 0
        laid = maps.select(
            *keys, F.shiftright("block", 1).alias("block"), F.when(first, F.col("lo") + F.col("by")).otherwise(F.col("lo")).alias("at"),
            F.when(first, F.col("by")).alias("a"), F.when(~first, F.col("by")).alias("b"),
        ).groupBy(*keys, "block", "at").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        filled = scan_lasts(laid, [*keys, "block"], "at", {"a": F.col("a"), "b": F.col("b")})
        maps = filled.select(*keys, "block", (F.col("at") - F.col("a")).alias("lo"), (F.col("a") + F.coalesce("b", F.lit(0))).alias("by"))
        blocks = (blocks + 1) // 2
    return maps.select(*keys, "lo", "by")


def shifts(moves: DataFrame, keys: Sequence[str], order: str, block_moves: int | None = None) -> DataFrame:
    """(keys, lo, by) of all moves (keys, order, src, dst, n) of each key in their order."""
    size = block_moves or BLOCK_MOVES
    numbered = scan_numbers(moves, keys, order, "no").withColumn("block", F.expr(f"(no - 1) div {size}"))
    place = shared_folder(moves.sparkSession, "maps")
    replayed(numbered.select(*keys, "block", "no", "src", "dst", "n"), keys).write.parquet(place)
    maps = moves.sparkSession.read.parquet(place)
    return composed(maps, keys, (maps.agg(F.max("block")).first()[0] or 0) + 1)


def item_shifts(moves: DataFrame, keys: Sequence[str], most: int, block_moves: int | None = None) -> DataFrame:
    """(keys, lo, by) of moves (keys, no, src, dir, n) of items: ``src`` is where an item is before all moves.

    Where an item is depends on all moves before, so blocks follow one another: the map of a block moves on the items of
    later blocks. ``most`` is the greatest ``no``, which counts from 1 in each key.
    """
    spark, keys = moves.sparkSession, list(keys)
    size = block_moves or BLOCK_MOVES
    blocks = (most + size - 1) // size
    place, waiting = shared_folder(spark, "maps"), moves.withColumn("block", F.expr(f"(no - 1) div {size}"))
    for block in range(blocks):
        here = replayed(waiting.filter(F.col("block") == block), keys, "dir", by_item)
        here.write.mode("append").parquet(place)
        if block + 1 < blocks:
            done = spark.read.parquet(place).filter(F.col("block") == block)
            waiting = shifted(waiting.filter(F.col("block") > block), done.select(*keys, "lo", "by"), keys, "src")
    return composed(spark.read.parquet(place), keys, blocks)


def shifted(items: DataFrame, maps: DataFrame, keys: Sequence[str], at: str, first: int = 0) -> DataFrame:
    """``items`` with their place ``at`` shifted by the map of their key; keys without a map stay as they are.

    Several items may be at one place.
    """
    keys = list(keys)
    pieces = maps.select(*keys, ((F.col("lo") + first) * 2).alias("__order"), F.col("by").alias("__by"))
    rows = items.withColumn("__order", F.col(at).cast("bigint") * 2 + 1).withColumn("__item", F.lit(True))
    both = rows.unionByName(pieces, allowMissingColumns=True)
    kind = items.schema[at].dataType
    placed = scan_lasts(both, keys, "__order", {"__by": F.col("__by")}).filter("__item")
    return placed.select(*[c if c != at else (F.col(at) + F.coalesce("__by", F.lit(0))).cast(kind).alias(at) for c in items.columns])
