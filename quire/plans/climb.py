"""Walks up parent links by pointer doubling.

After a round every node points twice as far up and holds what lies on the way, so a walk of any length is over after as
many rounds as its length has bits. Each round is one join of the unfinished nodes with all nodes, read from a written
table. A walk longer than its tree has nodes goes round a cycle and is left off there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import drop_folder, shared_folder

#: What a node holds of the way up: its own value, and how that joins the value from where it points.
Carried = dict[str, tuple[Column, Callable[[Column, Column], Column]]]


def climb(nodes: DataFrame, carried: Carried, known: Column | None = None, key: str = "doc_id", node: str = "node", parent: str = "parent") -> DataFrame:
    """(key, node, up, steps, rooted, ``carried``) for every node, its walk done.

    ``rooted`` says that the walk came to a node without a parent; it is false where a parent is missing, and ``up`` is left
    where the walk goes round a cycle. A node with ``known`` true needs no more. A node is unique within its key.
    """
    spark = nodes.sparkSession
    sizes = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("__size"))
    start = nodes.select(
        key, F.col(node).alias("node"), F.col(parent).alias("up"), F.lit(1).cast("bigint").alias("steps"), F.col(parent).isNull().alias("rooted"),
        *[value.alias(name) for name, (value, _) in carried.items()],
    )
    # rows without a key are a tree like others
    first = start.join(sizes.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    place = shared_folder(spark, "climb")
    first.write.parquet(place)
    state = spark.read.parquet(place)
    while True:
        on_the_way = F.col("up").isNotNull() & (F.col("steps") <= F.col("__size"))
        if known is not None:
            on_the_way &= ~F.coalesce(known, F.lit(False))
        walking = state.filter(on_the_way)
        if walking.isEmpty():
            return state.drop("__size")
        low, high = walking.alias("l"), state.alias("h")
        found = F.col("h.node").isNotNull()
        met = low.join(high, F.col(f"l.{key}").eqNullSafe(F.col(f"h.{key}")) & (F.col("l.up") == F.col("h.node")), "left")
        further = met.select(
            F.col(f"l.{key}").alias(key), F.col("l.node").alias("node"), F.col("h.up").alias("up"),
            (F.col("l.steps") + F.coalesce("h.steps", F.lit(0))).alias("steps"), F.coalesce("h.rooted", F.lit(False)).alias("rooted"),
            *[F.when(found, join(F.col(f"l.{name}"), F.col(f"h.{name}"))).otherwise(F.col(f"l.{name}")).alias(name) for name, (_, join) in carried.items()],
            F.col("l.__size").alias("__size"),
        )
        below = shared_folder(spark, "climb")
        state.filter(~on_the_way).unionByName(further).write.parquet(below)
        drop_folder(spark, place)
        place, state = below, spark.read.parquet(below)
