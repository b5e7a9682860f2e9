"""Sharding by a hypergeometric communication matrix: a uniform shuffle with exact shard sizes.

The rows of each input partition are permuted where they are and written with their place. How many rows of a partition go
to a shard is drawn, for all partitions and shards at once, from the multivariate hypergeometric distribution that a
uniform permutation of all rows would give: rows of the matrix sum to the partitions, columns to the shards, exactly. The
first so many permuted rows of a partition go to shard 0, the next to shard 1 and so on. After the exchange a shard is
permuted again, in cells of hashed keys, so that no shard has to fit one task. Shards differ by one row at most (law
``rows``). Equal texts are documents like others, as a uniform shuffle asks.

Everything after the first write is a function of the written table and the seed, so a task that is run again after a lost
executor gives the same rows. The matrix has at most ``ENTRIES`` entries: an input with more partitions is merged to fewer,
larger ones, without a shuffle. It is broadcast.

Edge cases: null ids, null, empty and very long texts, repeated rows are rows like others; more shards than rows leave
shards empty; an empty table gives no rows. Other columns are kept; an own column named shard or slot, in any case, comes
back with ``_in`` behind its name.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from quire.session import shared_folder

SHARDS, SEED = 16, 12
#: Most entries of the matrix, eight bytes each.
ENTRIES = 1 << 20
#: Rows of a cell of a shard, on average.
CELL_ROWS = 1 << 14
#: Spark's row numbers hold the partition above these bits.
ROW_BITS = 33
#: numpy draws from urns of fewer marbles than this.
URN = 10**9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Rows of each shard, one apart at most."""
    return np.array([rows // shards + (s < rows % shards) for s in range(shards)], np.int64)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good marbles among ``drawn`` ones; large urns by inversion of the probabilities around the mean."""
    if good + bad < URN:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    total = good + bad
    mean = drawn * (good / total)
    spread = math.sqrt(max(mean * (bad / total) * ((total - drawn) / total), 1.0))
    low, high = max(0, drawn - bad, math.floor(mean - 40 * spread)), min(drawn, good, math.ceil(mean + 40 * spread))
    x = np.arange(low, high, dtype=np.float64)
    # logarithm of p(x + 1) / p(x), summed: no factorials of large numbers
    ratio = np.log(good - x) + np.log(drawn - x) - np.log(x + 1) - np.log(bad - drawn + x + 1)
    weight = np.concatenate([[0.0], np.cumsum(ratio)])
    share = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(share, rng.random() * share[-1], "right"))


def communication_matrix(parts: list[int], shards: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows that each partition sends to each shard."""
    rng, left = np.random.default_rng(seed), shards.astype(object)
    matrix = np.zeros((len(parts), len(shards)), np.int64)
    for i, size in enumerate(parts):
        rest, open_ = int(size), int(left.sum())
        for s in range(len(shards)):
            open_ -= int(left[s])
            matrix[i, s] = hypergeometric(rng, int(left[s]), open_, rest) if open_ else rest
            rest -= int(matrix[i, s])
        left -= matrix[i]
    return matrix


def _aside(documents: DataFrame) -> DataFrame:
    taken, names = {c.lower() for c in documents.columns} | {"shard", "slot"}, {}
    for c in documents.columns:
        if c.lower() in ("shard", "slot"):
            name = f"{c}_in"
            while name.lower() in taken:
                name += "_in"
            taken.add(name.lower())
            names[c] = name
    return documents.withColumnsRenamed(names)


def shuffled(documents: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The rows with ``shard`` and ``slot``, the place in the shard from 0."""
    spark = documents.sparkSession
    docs = _aside(documents)
    place = shared_folder(spark, "permuted")
    first = docs.coalesce(max(1, ENTRIES // shards)).withColumn("__u", F.rand(seed)).sortWithinPartitions("__u").drop("__u")
    first.withColumn("__at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(place)
    table = spark.read.parquet(place)

    part = F.shiftright("__at", ROW_BITS)
    sizes = sorted(tuple(r) for r in table.groupBy(part.alias("part")).agg(F.count(F.lit(1))).collect())
    total = sum(n for _, n in sizes)
    matrix = communication_matrix([n for _, n in sizes], shard_sizes(total, shards), seed)
    ends = pd.DataFrame({"__part": [p for p, _ in sizes], "__ends": np.cumsum(matrix, axis=1).tolist()})
    sent = F.broadcast(spark.createDataFrame(ends, "__part bigint, __ends array<bigint>"))

    def dealt(rows: DataFrame) -> DataFrame:
        place = F.col("__at").bitwiseAND((1 << ROW_BITS) - 1)
        return rows.withColumn("__part", part).join(sent, "__part").select(
            *rows.columns, F.size(F.filter("__ends", lambda end: end <= place)).alias("shard"), *_cell())

    def _cell() -> list[Column]:
        cells = max(1, -(-total // (shards * cell_rows)))
        return [F.xxhash64(F.lit(seed), "__at").alias("__key"), F.pmod(F.xxhash64(F.lit(seed + 1), "__at"), F.lit(cells)).alias("__cell")]

    cell = ["shard", "__cell"]
    counts = dealt(table.select("__at")).groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*cell, F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*cell).orderBy("__key", "__at"))
    again = dealt(table).withColumn("__row", inside)
    return again.join(before, cell).select(*docs.columns, "shard", (F.col("__before") + F.col("__row") - 1).alias("slot"))


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Write a folder of Parquet files for each shard; returns the files as a table."""
    rows = shuffled(documents, shards, seed, cell_rows)
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    fields = [f for f in rows.schema if f.name != "shard"]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField("shard", T.IntegerType())])
    return documents.sparkSession.read.schema(schema).parquet(path)


def op12_shards(spark, sf_dir: str) -> DataFrame:
    """All documents written into shards and read back: size, checksum, shard and slot of each."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = write_shards(documents, shared_folder(spark, "shards"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return rows.select(
        "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
