"""Ordered work on keys of any size.

A window partitioned by document puts one document into one task. A document
may hold a third of all pages, so nothing here does that. The ordering column
is an integer (page, position, sequence number), unique within its key, and its
high bits name a *block*: at most ``2**bits`` rows of one key. Row-level windows
run per (key, block); one summary row per block carries the result of earlier
blocks, and only those summaries are windowed per key. Rows without a key are
one more key, and rows without an order come first; none is lost.

The same block number turns "position lies in lo..hi" into an equi-join with a
residual filter, which a plain between-join would plan as a nested loop.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER_BITS = 16
RANGE_BITS = 10
BLOCK = "__block"


def block(position: str | Column, bits: int = ORDER_BITS) -> Column:
    col = F.col(position) if isinstance(position, str) else position
    return F.shiftright(col.cast("bigint"), bits)


NO_ORDER = -(1 << 62)
KEY = "__key"


def cells(keys: Sequence[str], order: str, bits: int) -> dict[str, Column]:
    """The key as one struct, which equals itself also where it holds nulls, and the block, least without order."""
    return {KEY: F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("k")), BLOCK: F.coalesce(block(order, bits), F.lit(NO_ORDER))}


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash rows over all shuffle partitions; used before rows that multiply."""
    return df.repartition(shuffle_width(df), *cols)


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    bits: int = ORDER_BITS,
) -> DataFrame:
    """Add the sum of each value over all earlier rows of the key (0 at the start)."""
    values = {f"__v_{name}": value for name, value in sums.items()}
    src = df.withColumns({**cells(keys, order, bits), **values})

    group = [KEY, BLOCK]
    totals = src.groupBy(*group).agg(*[F.sum(v).alias(f"__t{v}") for v in values])
    ahead = Window.partitionBy(KEY).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        *[F.coalesce(F.sum(f"__t{v}").over(ahead), F.lit(0)).alias(f"__o{v}") for v in values],
    )

    within = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = src.withColumns(
        {f"__l{v}": F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values}
    )
    joined = local.join(offsets, group)
    return joined.select(
        *df.columns,
        *[(F.col(f"__o__v_{n}") + F.col(f"__l__v_{n}")).alias(n) for n in sums],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: str, out: str, bits: int = ORDER_BITS
) -> DataFrame:
    """1-based number of each row within its key."""
    return prefix_sums(df, keys, order, {out: F.lit(1).cast("bigint")}, bits).withColumn(
        out, F.col(out) + 1
    )


def run_numbers(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Sequence[str],
    starts_run: Callable[[Column, Column], Column],
    out: str,
    bits: int = ORDER_BITS,
) -> DataFrame:
    """Number the runs of each key from 1.

    ``starts_run(previous, current)`` gets two structs of ``cols`` from
    neighbouring rows and says whether the second one opens a new run.
    """
    group = [KEY, BLOCK]
    src = df.withColumns({**cells(keys, order, bits), "__cur": F.struct(*cols)})
    within = Window.partitionBy(*group).orderBy(order)
    src = src.withColumn("__prev", F.lag("__cur").over(within))
    opens = F.when(F.col("__prev").isNull(), F.lit(0)).otherwise(
        starts_run(F.col("__prev"), F.col("__cur")).cast("int")
    )
    src = src.withColumn("__opens", opens.cast("bigint"))
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    src = src.withColumn("__local", F.sum("__opens").over(running))

    edges = src.groupBy(*group).agg(
        F.min_by("__cur", F.struct(F.col(order).isNotNull(), order)).alias("__first"),
        F.max_by("__cur", F.struct(F.col(order).isNotNull(), order)).alias("__last"),
        F.sum("__opens").alias("__inner"),
    )
    by_key = Window.partitionBy(KEY).orderBy(BLOCK)
    edges = edges.withColumn("__before", F.lag("__last").over(by_key))
    edges = edges.withColumn(
        "__fresh",
        F.when(F.col("__before").isNull(), F.lit(1))
        .otherwise(starts_run(F.col("__before"), F.col("__first")).cast("int"))
        .cast("bigint"),
    )
    ahead = by_key.rowsBetween(Window.unboundedPreceding, -1)
    bases = edges.select(
        *group,
        (
            F.coalesce(F.sum(F.col("__fresh") + F.col("__inner")).over(ahead), F.lit(0))
            + F.col("__fresh")
        ).alias("__base"),
    )
    return src.join(bases, group).select(
        *df.columns, (F.col("__base") + F.col("__local")).alias(out)
    )


def clip(
    ranges: DataFrame, rows: DataFrame, keys: Sequence[str], position: str, hi: str
) -> DataFrame:
    """Cut ranges at the last position of their key, so a wild bound stays cheap."""
    tops = rows.groupBy(*keys).agg(F.max(position).cast("bigint").alias("__top"))
    return (
        ranges.join(tops, list(keys)).withColumn(hi, F.least(hi, "__top")).drop("__top")
    )


def cover(ranges: DataFrame, lo: str, hi: str, bits: int = RANGE_BITS) -> DataFrame:
    """One row per block that lo..hi touches."""
    return ranges.filter(F.col(lo) <= F.col(hi)).withColumn(
        BLOCK, F.explode(F.sequence(block(lo, bits), block(hi, bits)))
    )


def range_join(
    rows: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    position: str,
    lo: str,
    hi: str,
    how: str = "inner",
    bits: int = RANGE_BITS,
) -> DataFrame:
    """Join rows to every range of the same key that holds their position.

    ``ranges`` must not share non-key column names with ``rows``. Works for
    inner, left, left_semi and left_anti joins.
    """
    left = rows.withColumn(BLOCK, block(position, bits)).alias("l")
    right = cover(ranges, lo, hi, bits).alias("r")
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, BLOCK]]
    on.append(F.col(f"l.{position}").between(F.col(f"r.{lo}"), F.col(f"r.{hi}")))
    cond = on[0]
    for part in on[1:]:
        cond = cond & part
    joined = left.join(right, cond, how)
    kept = [F.col(f"l.{c}") for c in rows.columns]
    if how in ("left_semi", "left_anti"):
        return joined.select(*kept)
    extra = [F.col(f"r.{c}") for c in ranges.columns if c not in keys]
    return joined.select(*kept, *extra)


def number_units(
    df: DataFrame, keys: Sequence[str], count: str, out: str, bits: int = ORDER_BITS
) -> DataFrame:
    """One row per 1..count for each input row; null or 0 gives none.

    Rows multiply in two steps with a shuffle between, so that one huge count is
    generated by many tasks.
    """
    wide = df.filter(F.col(count) >= 1).withColumn(
        BLOCK, F.explode(F.sequence(F.lit(0).cast("bigint"), block(F.col(count) - 1, bits)))
    )
    wide = spread(wide, *keys, BLOCK)
    first = F.shiftleft(F.col(BLOCK), bits) + 1
    last = F.least(F.col(count).cast("bigint"), F.shiftleft(F.col(BLOCK) + 1, bits))
    return wide.withColumn(out, F.explode(F.sequence(first, last))).drop(BLOCK)
