"""Numbers, sizes, times and colours for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import col, let

UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
LARGE = 500 * 1024 * 1024
VERY_LARGE = 2 * 1024 * 1024 * 1024


def format_bytes(n: Column | str, decimals: int = 2) -> Column:
    """2500000000 to "2.33 GB", base 1024; negative or non-finite is a dash.

    The exact value is rounded, and an exact half goes to the even digit, as SQL's printf has it.
    """
    value = col(n).cast("double")
    tier = F.lit(0)
    for i in range(1, len(UNITS)):
        tier = tier + F.when(value >= float(1024**i), 1).otherwise(0)
    scaled = value / F.pow(F.lit(1024.0), tier)
    unit = F.get(F.array(*[F.lit(u) for u in UNITS]), tier)
    text = F.when(tier == 0, F.format_string("%.0f", scaled)).otherwise(
        # a pattern rounds the binary value itself; "%.2f" would round up its shortest decimal form
        F.call_function("format_number", scaled, F.lit("0." + "0" * decimals if decimals else "0"))
    )
    finite = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf"))
    return F.when(finite, F.concat_ws(" ", text, unit)).otherwise("—")


def size_tier(n: Column | str) -> Column:
    """normal, large (500 MiB) or veryLarge (2 GiB)."""
    value = col(n)
    return (
        F.when(value >= VERY_LARGE, "veryLarge").when(value >= LARGE, "large").otherwise("normal")
    )


def highest_tier(n: Column | str) -> Column:
    """Aggregate: the highest tier of a set of files is that of its largest file."""
    return size_tier(F.max(col(n)))


def format_count(n: Column | str) -> Column:
    """1234 to "1,234"."""
    return F.format_number(col(n), 0)


def relative_time(ts: Column | str, now: Column) -> Column:
    """"just now", "5 min ago", "2 hours ago", "3 days ago", else the date."""

    def build(sec: Column) -> Column:
        minutes = F.greatest(F.lit(1), F.floor(sec / 60))
        hours = F.floor(F.floor(sec / 60) / 60)
        days = F.floor(hours / 24)

        def plural(n: Column, unit: str) -> Column:
            return F.concat(
                n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago")
            )

        return (
            F.when(sec < 45, "just now")
            .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
            .when(hours < 24, plural(hours, "hour"))
            .when(days < 30, plural(days, "day"))
        )

    millis = F.unix_millis(now.cast("timestamp")) - F.unix_millis(col(ts).cast("timestamp"))
    seconds = F.floor(F.greatest(F.lit(0), millis) / 1000)
    return F.coalesce(
        let(seconds, build), F.date_format(col(ts).cast("timestamp"), "M/d/yyyy")
    )


def parse_hex(color: Column | str, fallback: tuple[float, float, float] = (0.067, 0.094, 0.153)) -> Column:
    """#rgb or #rrggbb to struct(r, g, b) in 0..1; anything else is the fallback."""

    def build(t: Column) -> Column:
        short = F.regexp_replace(t, "^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
        digits = F.regexp_extract(short, "^#?([0-9a-f]{6})$", 1)

        def channel(at: int, other: float) -> Column:
            pair = F.conv(F.substring(digits, at, 2), 16, 10).cast("double")
            return F.when(digits != "", pair / 255.0).otherwise(F.lit(other))

        return F.struct(
            channel(1, fallback[0]).alias("r"),
            channel(3, fallback[1]).alias("g"),
            channel(5, fallback[2]).alias("b"),
        )

    return let(F.lower(F.trim(F.coalesce(col(color), F.lit("")))), build)
