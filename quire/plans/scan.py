"""Running sums and last known values by a parallel scan in two passes.

The rows are written once, dealt into ranges of (key, order) and scanned within each range, in order; a range knows only its
own rows. What the ranges before it add to its first key is found from one row a range, so neither a key that holds most
rows nor orders that are hashes make anything but more ranges. The input is evaluated once, rows are shuffled once, and
nothing is windowed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import drop_folder, shared_folder


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    after, before = column.slice(1), column.slice(0, len(column) - 1)
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values[1:], values)], bool)
    same = pc.or_(pc.fill_null(pc.equal(after, before), False), pc.and_(pc.is_null(after), pc.is_null(before)))
    return ~same.to_numpy(zero_copy_only=False)


def _sums(value: pa.Array, starts: np.ndarray, stretch: np.ndarray, held: int | None) -> tuple[pa.Array, int]:
    """Sums of earlier rows of the key, and the sum after the last row."""
    v = pc.fill_null(value, 0).to_numpy()
    ahead = np.cumsum(v) - v
    local = ahead - np.concatenate([[-(held or 0)], ahead[starts]])[stretch]
    return pa.array(local), int(local[-1] + v[-1])


def _lasts(value: pa.Array, starts: np.ndarray, stretch: np.ndarray, held: int | None) -> tuple[pa.Array, int | None]:
    """The last value of the key that is not null, this row's included, and that of the last row."""
    there = value.is_valid().to_numpy(zero_copy_only=False)
    place = np.maximum.accumulate(np.where(there, np.arange(len(there)), -1))
    inside = place >= np.concatenate([[0], starts])[stretch]
    v = pc.fill_null(value, 0).to_numpy()[np.maximum(place, 0)]
    waits = ~inside & (stretch == 0)
    if held is not None:
        v = np.where(waits, held, v)
        inside = inside | waits
    return pa.array(v, mask=~inside), int(v[-1]) if inside[-1] else None


def _scanned(n_keys: int, n_values: int, within: Callable):
    """A function over the sorted batches of one range: columns are keys first, values last."""

    def run(batches: Iterator[pa.RecordBatch]):
        part = TaskContext.get().partitionId()
        last, runs, row, held = None, -1, 0, [None] * n_values
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.columns[:n_keys]
            new = np.zeros(n, bool)
            for key in keys:
                new[1:] |= _changes(key)
            new[0] = last is None or [k[0].as_py() for k in keys] != last
            starts, stretch = np.flatnonzero(new), np.cumsum(new)
            out = list(batch.columns)
            for k in range(n_values):
                local, held[k] = within(batch.column(batch.num_columns - n_values + k), starts, stretch, held[k])
                out.append(local)
            out += [pa.array(np.full(n, part, np.int32)), pa.array(runs + stretch), pa.array(row + np.arange(n))]
            last, runs, row = [k[n - 1].as_py() for k in keys], runs + len(starts), row + n
            names = [*batch.schema.names, *[f"__l{k}" for k in range(n_values)], "__part", "__run", "__row"]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _scan(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], last: bool) -> DataFrame:
    spark, keys, n = df.sparkSession, list(keys), len(values)
    named = [value.cast("bigint").alias(f"__v{k}") for k, value in enumerate(values.values())]
    rest = [c for c in df.columns if c not in keys]
    waiting, done = shared_folder(spark, "scan-rows"), shared_folder(spark, "scan")
    df.select(*keys, *rest, *named).write.parquet(waiting)
    rows = spark.read.parquet(waiting)
    along = [F.col(c).asc_nulls_first() for c in [*keys, order]]
    dealt = rows.repartitionByRange(*along).sortWithinPartitions(*along)
    fields = [T.StructField(f"__l{k}", T.LongType()) for k in range(n)]
    fields += [T.StructField("__part", T.IntegerType()), T.StructField("__run", T.LongType()), T.StructField("__row", T.LongType())]
    dealt.mapInArrow(_scanned(len(keys), n, _lasts if last else _sums), T.StructType([*rows.schema.fields, *fields])).write.parquet(done)
    drop_folder(spark, waiting)

    scanned = spark.read.parquet(done)
    key = F.struct(*keys, F.lit(0).alias("__k"))
    ends = F.struct(*[(F.col(f"__l{k}") if last else F.col(f"__l{k}") + F.coalesce(f"__v{k}", F.lit(0))).alias(f"e{k}") for k in range(n)])
    ranges = scanned.groupBy("__part").agg(
        F.min_by(key, "__row").alias("first"), F.max_by(key, "__row").alias("last"), F.max_by(ends, "__row").alias("ends"), F.max("__run").alias("runs"))
    none = None if last else 0
    before, carry, carried = None, [none] * n, []
    for part in sorted(ranges.collect(), key=lambda r: r["__part"]):  # one row a range
        here = carry if before is not None and part["first"] == before else [none] * n
        if any(x != none for x in here):
            carried.append((part["__part"], *here))
        on = part["runs"] == 0  # the range holds one key, so what came in goes out again
        carry = [(here[k] if on and end is None else end) if last else end + (here[k] if on else 0) for k, end in enumerate(part["ends"])]
        before = part["last"]
    found = {name: F.col(f"__l{k}") for k, name in enumerate(values)}
    if carried:
        schema = "__part int, " + ", ".join(f"__c{k} bigint" for k in range(n))
        scanned = scanned.join(F.broadcast(spark.createDataFrame(carried, schema)), "__part", "left")
        for k, name in enumerate(values):
            came = F.when(F.col("__run") == 0, F.col(f"__c{k}"))
            found[name] = F.coalesce(f"__l{k}", came) if last else F.col(f"__l{k}") + F.coalesce(came, F.lit(0))
    return scanned.select(*[c for c in df.columns if c not in found], *[c.alias(name) for name, c in found.items()])


def scan_lasts(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column]) -> DataFrame:
    """Add the last whole number that is not null up to each row of the key, in order, this row's included."""
    return _scan(df, keys, order, values, last=True)


def scan_sums(df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, Column]) -> DataFrame:
    """Add the sum of each whole-number value over all earlier rows of the key, 0 at its start.

    Rows without a key are one more key; rows without an order come first. ``order`` is unique within its key.
    """
    return _scan(df, keys, order, sums, last=False)


def scan_numbers(df: DataFrame, keys: Sequence[str], order: str, out: str) -> DataFrame:
    """1-based number of each row within its key."""
    return scan_sums(df, keys, order, {out: F.lit(1)}).withColumn(out, F.col(out) + 1)
