"""Page-range text: three grammars that differ on purpose.

Each parser returns a struct with an ``error`` code. The first broken rule in
reading order wins. ``*_segments`` keep ranges folded as (lo, hi) and never
grow with the document, ``page_set`` merges them into sorted, disjoint and
counted ones, and ``quire.operators.select.listed_pages`` makes rows of either
at any size. The expanding parsers make one array: more than ``max_pages``, or
pages no integer holds, are refused with TOO_MANY_PAGES or TOO_LARGE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import col, let
from quire.functions.text import INNER_SPACE, WHITE

# an array is one value of a row, and a row is bound to 2 GiB: four bytes and a bit for each integer
ARRAY_LIMIT = 520_000_000
#: Pages in one array unless a caller says otherwise; more of them are rows (``listed_pages``), not an array.
MAX_PAGES = 1 << 26
INT_MAX = 2_147_483_647
# stands for every number of more than 18 digits, which gets an error code
HUGE = 10**18
U32_MAX = 4_294_967_295

PAGES = "struct<pages:array<int>,error:string>"
SEGMENTS = "struct<segments:array<struct<lo:bigint,hi:bigint>>,error:string>"
NO_SEGMENTS = "array<struct<lo:bigint,hi:bigint>>"


def _digits(token: Column) -> Column:
    """Value of an all-digit token, ``HUGE`` beyond 18 digits; null for anything else."""
    short = token.try_cast("bigint")
    bare = F.ltrim(token, F.lit("0"))
    long = F.when(F.length(bare) > 18, F.lit(HUGE)).otherwise(
        F.coalesce(bare.try_cast("bigint"), F.lit(0))
    )
    return F.when(
        token.rlike("^[0-9]+$"), F.when(F.length(token) <= 18, short).otherwise(long)
    )


def _u32(token: Column) -> Column:
    """Value of an unsigned 32-bit number with an optional plus sign, else null."""
    bare = F.regexp_replace(token, r"^\+(?=[0-9])", "")
    return let(_digits(bare), lambda v: F.when(v <= U32_MAX, v))


def _trim(token: Column) -> Column:
    return F.trim(token, F.lit(WHITE))


def _ends(token: Column, number: Callable[[Column], Column]) -> Column:
    """struct(lo, hi) of "a-b" or "a"; what follows the first dash is the end."""

    def cut(dash: Column) -> Column:
        head = F.when(dash > 0, F.substring(token, F.lit(1), dash - 1)).otherwise(token)
        lo = number(head)
        hi = number(F.substring(token, dash + 1, F.length(token)))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    single = let(number(token), lambda v: F.struct(v.alias("lo"), v.alias("hi")))
    return F.when(F.contains(token, F.lit("-")), let(F.instr(token, "-"), cut)).otherwise(single)


def _segment(lo: Column, hi: Column, error: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"), error.cast("string").alias("error"))


def _first_error(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t["error"].isNotNull()), F.lit(0))["error"]


def _folded(tokens: Column) -> Column:
    return F.transform(
        tokens,
        lambda t: F.struct(
            t["lo"].cast("bigint").alias("lo"), t["hi"].cast("bigint").alias("hi")
        ),
    )


def _checked(tokens: Column) -> Column:
    """Segments when no token is broken, otherwise the first error."""

    def build(ts: Column) -> Column:
        return let(
            _first_error(ts),
            lambda err: F.struct(
                F.when(err.isNull(), _folded(ts)).alias("segments"), err.alias("error")
            ),
        )

    return let(tokens, build)


def _failed(code: str) -> Column:
    return F.struct(F.lit(None).cast(NO_SEGMENTS).alias("segments"), F.lit(code).alias("error"))


def _whole(count: Column) -> Column:
    return F.struct(
        F.array(
            F.struct(F.lit(1).cast("bigint").alias("lo"), count.cast("bigint").alias("hi"))
        ).alias("segments"),
        F.lit(None).cast("string").alias("error"),
    )


def _size(segments: Column) -> Column:
    """Pages of folded segments, at most ``HUGE``; null for null."""
    return F.aggregate(
        segments,
        F.lit(0).cast("bigint"),
        lambda acc, s: F.least(acc + F.abs(s["hi"] - s["lo"]) + 1, F.lit(HUGE)),
    )


def merge_segments(segments: Column | str) -> Column:
    """Sorted, disjoint segments of the same pages; neighbours are joined, and lo <= hi."""
    ordered = F.sort_array(
        F.transform(col(segments), lambda s: F.struct(F.least(s["lo"], s["hi"]).alias("lo"), F.greatest(s["lo"], s["hi"]).alias("hi")))
    )
    empty = F.struct(F.array().cast(NO_SEGMENTS).alias("done"), F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("last"))

    def step(acc: Column, s: Column) -> Column:
        joins = s["lo"] <= acc["last"]["hi"] + 1
        grown = F.struct(acc["last"]["lo"].alias("lo"), F.greatest(acc["last"]["hi"], s["hi"]).alias("hi"))
        return (
            F.when(acc["last"].isNull(), F.struct(acc["done"].alias("done"), s.alias("last")))
            .when(joins, F.struct(acc["done"].alias("done"), grown.alias("last")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["last"]).alias("done"), s.alias("last")))
        )

    return F.aggregate(
        ordered, empty, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["last"]))
    )


def page_set(parsed: Column) -> Column:
    """Folded segments as a set: struct(segments, n, error), at any size; ``n`` counts the pages."""

    def build(p: Column) -> Column:
        return let(
            F.when(p["error"].isNull(), merge_segments(p["segments"])),
            lambda m: F.struct(m.alias("segments"), _size(m).alias("n"), p["error"].alias("error")),
        )

    return let(parsed, build)


def _expand(parsed: Column, max_pages: int | None, ordered: bool) -> Column:
    most = min(MAX_PAGES if max_pages is None else max_pages, ARRAY_LIMIT)

    def folded(p: Column) -> Column:
        # a set is merged before it is counted and listed, so repeats cost nothing
        segments = F.when(p["error"].isNull(), p["segments"] if ordered else merge_segments(p["segments"]))
        return F.struct(segments.alias("segments"), p["error"].alias("error"))

    def judged(p: Column) -> Column:
        too_many = F.coalesce(_size(p["segments"]) > most, F.lit(False))
        too_large = F.coalesce(
            F.exists(p["segments"], lambda s: F.greatest(s["lo"], s["hi"]) > INT_MAX), F.lit(False)
        )
        error = (
            F.when(p["error"].isNotNull(), p["error"])
            .when(too_many, "TOO_MANY_PAGES")
            .when(too_large, "TOO_LARGE")
        )
        return F.struct(p["segments"].alias("segments"), error.alias("error"))

    def build(p: Column) -> Column:
        usable = F.when(p["error"].isNull(), p["segments"])
        pages = F.flatten(
            F.transform(usable, lambda s: F.sequence(s["lo"].cast("int"), s["hi"].cast("int")))
        )
        return F.struct(pages.alias("pages"), p["error"].alias("error"))

    return let(let(let(parsed, folded), judged), build)


# --- strict grammar -------------------------------------------------------


def parse_range_segments(
    spec: Column | str, page_count: Column | int | None = None, allow_all: bool = True
) -> Column:
    """The strict grammar without expansion: struct(segments, error)."""
    count = (
        page_count if isinstance(page_count, Column) else F.lit(page_count)
    ).cast("bigint")
    # a count of 0 is treated like an unknown one
    bound = F.when(count != 0, count)
    text = F.lower(F.regexp_replace(col(spec), INNER_SPACE, ""))

    def token(t: Column) -> Column:
        # a dash at either end, or two of them, is no range
        broken = t.rlike("^-|-$|-.*-")
        return let(_ends(t, _digits), lambda e: judged(t, broken, e))

    def judged(t: Column, broken: Column, e: Column) -> Column:
        whole = F.coalesce((e["lo"] >= 1) & (e["hi"] >= 1), F.lit(False))
        error = (
            F.when(t == "", "EMPTY_TOKEN")
            .when(broken, "BAD_RANGE")
            .when(~whole, "BAD_NUMBER")
            .when(F.greatest(e["lo"], e["hi"]) > bound, "OUT_OF_RANGE")
            .when(F.greatest(e["lo"], e["hi"]) >= HUGE, "TOO_LARGE")
        )
        return _segment(e["lo"], e["hi"], error)

    def build(s: Column) -> Column:
        if allow_all:
            everything = F.when(count >= 1, _whole(count)).otherwise(_failed("ALL_NEEDS_COUNT"))
        else:
            everything = _failed("ALL_NOT_ALLOWED")
        return (
            F.when(s == "", _failed("EMPTY"))
            .when(s.isin("all", "*"), everything)
            .otherwise(_checked(F.transform(F.split(s, ","), token)))
        )

    return let(text, build)


def parse_range(
    spec: Column | str,
    page_count: Column | int | None = None,
    preserve_order: bool = False,
    allow_all: bool = True,
    max_pages: int | None = None,
) -> Column:
    """Strict page range to struct(pages, error)."""
    return _expand(parse_range_segments(spec, page_count, allow_all), max_pages, preserve_order)


# --- lenient grammar ------------------------------------------------------


def lenient_segments(spec: Column | str) -> Column:
    """The lenient grammar without expansion; lo <= hi in every segment."""

    def token(t: Column) -> Column:
        return let(_ends(t, lambda part: _u32(_trim(part))), ordered)

    def ordered(e: Column) -> Column:
        broken = e["lo"].isNull() | e["hi"].isNull()
        return _segment(
            F.when(~broken, F.least(e["lo"], e["hi"])),
            F.when(~broken, F.greatest(e["lo"], e["hi"])),
            F.when(broken, F.lit("INVALID_PAGES")),
        )

    def build(parts: Column) -> Column:
        return F.when(F.size(parts) == 0, _failed("INVALID_PAGES")).otherwise(
            _checked(F.transform(parts, token))
        )

    parts = F.filter(F.transform(F.split(col(spec), ","), _trim), lambda t: t != "")
    return let(parts, build)


def parse_range_lenient(spec: Column | str, max_pages: int | None = None) -> Column:
    """Lenient page set to struct(pages, error): sorted, unique, 0 allowed."""
    return _expand(lenient_segments(spec), max_pages, ordered=False)


# --- ordered grammar with z -----------------------------------------------


def spec_segments(spec: Column | str, n: Column | str) -> Column:
    """The ordered grammar without expansion; descending segments keep lo > hi."""
    total = col(n).cast("bigint")

    def number(t: Column) -> Column:
        return let(_trim(t), lambda v: F.when(F.lower(v) == "z", total).otherwise(_u32(v)))

    def checked(e: Column) -> Column:
        bad = e["lo"].isNull() | e["hi"].isNull()
        return _segment(e["lo"], e["hi"], F.when(bad, F.lit("INVALID_PAGES")))

    def token(t: Column) -> Column:
        return let(_ends(t, number), checked)

    def in_bounds(parsed: Column) -> Column:
        outside = F.exists(
            parsed["segments"],
            lambda s: (F.least(s["lo"], s["hi"]) < 1) | (F.greatest(s["lo"], s["hi"]) > total),
        )
        error = F.when(parsed["error"].isNotNull(), parsed["error"]).when(outside, "OUT_OF_RANGE")
        return F.struct(
            F.when(error.isNull(), parsed["segments"]).alias("segments"), error.alias("error")
        )

    def build(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s, ","), _trim), lambda t: t != "")
        nothing = F.struct(
            F.array().cast(NO_SEGMENTS).alias("segments"),
            F.lit(None).cast("string").alias("error"),
        )
        whole = (s == "") | (F.lower(s) == "all") | (s == "1-z")
        return (
            F.when(whole & (total < 1), nothing)
            .when(whole, _whole(total))
            .when(F.size(parts) == 0, _failed("INVALID_PAGES"))
            .otherwise(let(_checked(F.transform(parts, token)), in_bounds))
        )

    return let(_trim(col(spec)), build)


def expand_spec(spec: Column | str, n: Column | str, max_pages: int | None = None) -> Column:
    """Ordered page spec to struct(pages, error); order and repeats are kept."""
    return _expand(spec_segments(spec, n), max_pages, ordered=True)


def is_full_range(spec: Column | str, n: Column | str) -> Column:
    """Whether the spec lists 1..n once in natural order; ``1-z`` always does."""

    def token(t: Column) -> Column:
        return _ends(t, lambda part: _u32(_trim(part)))

    def build(s: Column) -> Column:
        after = F.aggregate(
            F.transform(F.transform(F.split(s, ","), _trim), token),
            F.lit(1).cast("bigint"),
            lambda expect, t: F.when((t["lo"] == expect) & (t["hi"] >= t["lo"]), t["hi"] + 1),
        )
        return (s == "1-z") | F.coalesce(after == col(n).cast("bigint") + 1, F.lit(False))

    return let(_trim(col(spec)), build)


# --- split ranges ---------------------------------------------------------


def parse_split_ranges(text: Column | str, total: Column | str) -> Column:
    """Comma or newline list to struct(ranges array<struct<start,end>>, error)."""
    count = col(total).cast("bigint")

    def token(t: Column) -> Column:
        shaped = t.rlike(r"^[0-9]+(\s*-\s*[0-9]+)?$")
        ends = F.when(shaped, _ends(t, lambda part: _digits(_trim(part))))
        return let(ends, judged)

    def judged(e: Column) -> Column:
        error = (
            F.when(e.isNull(), "BAD_TOKEN")
            .when((e["lo"] < 1) | (e["hi"] < 1) | (e["lo"] > e["hi"]), "BAD_RANGE")
            .when(e["hi"] > count, "OUT_OF_RANGE")
            .when(e["hi"] >= HUGE, "TOO_LARGE")
        )
        return _segment(e["lo"], e["hi"], error)

    def build(parts: Column) -> Column:
        parsed = F.when(F.size(parts) == 0, _failed("EMPTY")).otherwise(
            _checked(F.transform(parts, token))
        )
        return let(
            parsed,
            lambda p: F.struct(
                F.transform(
                    p["segments"],
                    lambda s: F.struct(s["lo"].alias("start"), s["hi"].alias("end")),
                ).alias("ranges"),
                p["error"].alias("error"),
            ),
        )

    trimmed = F.transform(F.split(col(text), "[,\n]"), _trim)
    return let(F.filter(trimmed, lambda t: t != ""), build)


# --- formatting -----------------------------------------------------------


def format_page_list(pages: Column | str) -> Column:
    """[1,3,4,6] to "1,3-4,6"; a run breaks on any step other than +1."""

    def build(p: Column) -> Column:
        starts = F.filter(p, lambda x, i: (i == 0) | (x != F.get(p, i - 1) + 1))
        ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
        runs = F.zip_with(
            starts,
            ends,
            lambda a, b: F.when(a == b, a.cast("string")).otherwise(
                F.concat_ws("-", a.cast("string"), b.cast("string"))
            ),
        )
        return F.array_join(runs, ",")

    return let(col(pages), build)
