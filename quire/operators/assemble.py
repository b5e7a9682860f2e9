"""Assembly: combined documents, order, merge, split, rotation, print sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions import let
from quire.functions.ranges import U32_MAX, lenient_segments
from quire.plans.blocks import (
    ORDER_BITS,
    block,
    clip,
    number_units,
    prefix_sums,
    range_join,
    row_numbers,
    run_numbers,
)
from quire.plans.moves import shifted as shifted_items
from quire.plans.moves import shifts
from quire.plans.scan import scan_numbers
from quire.session import shared_folder

MIN_SHEET = 72.0
MIN_TILE = 36.0
GUTTER = 12.0
SLOTS = {"2up": 2, "4up": 4, "booklet": 2}


def combine(files: DataFrame, bits: int = ORDER_BITS) -> DataFrame:
    """(doc_id, pos, uid, page, key) of every page of every file in file order.

    ``files`` is (doc_id, ord, uid, page_count). Positions come from a running
    sum over the file table, so pages are generated without a window.
    """
    count = F.coalesce(F.col("page_count"), F.lit(0)).cast("bigint")
    placed = prefix_sums(
        files.select("doc_id", "ord", "uid", "page_count"), ["doc_id"], "ord", {"__offset": count}, bits
    )
    pages = number_units(placed, ["doc_id", "uid"], "page_count", "page", bits)
    return pages.select(
        "doc_id",
        (F.col("__offset") + F.col("page")).alias("pos"),
        "uid",
        "page",
        F.concat_ws("#", F.col("uid").cast("string"), F.col("page").cast("string")).alias("key"),
    )


def shifted(position: Column, source: Column, target: Column) -> Column:
    """Place of an item after another one moved from ``source`` to ``target``."""
    return (
        F.when(position == source, target)
        .when((position > source) & (position <= target), position - 1)
        .when((position < source) & (position >= target), position + 1)
        .otherwise(position)
    )


def move_file(files: DataFrame, moves: DataFrame, block_moves: int | None = None) -> DataFrame:
    """Move files of a document from place ``src`` to ``dst`` (both 0-based ``ord``).

    ``moves`` is (doc_id, src, dst) and, where a document has several, ``seq``: they
    are applied in that order. Flags such as ``active`` belong to the file row and
    travel with it. Equal or out-of-range places change nothing. Lists of moves of
    any length become maps of stretches, see ``quire.plans.moves``.
    """
    order = "seq" if "seq" in moves.columns else "__order"
    sizes = files.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    place = shared_folder(files.sparkSession, "moves")
    src, dst = (F.col(c).cast("bigint") for c in ("src", "dst"))
    real = moves.withColumn("__order", F.struct("src", "dst")).join(sizes, "doc_id").filter(
        (src != dst) & (src >= 0) & (dst >= 0) & (src < F.col("n")) & (dst < F.col("n"))
    )
    real.select("doc_id", order, src.alias("src"), dst.alias("dst"), "n").write.parquet(place)
    real = files.sparkSession.read.parquet(place)
    most = real.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).agg(F.max("m")).first()[0]
    if (most or 0) > 1:
        maps = shifts(real, ["doc_id"], order, block_moves)
        moved = files.join(real.select("doc_id").distinct(), "doc_id", "left_semi")
        same = files.join(real.select("doc_id").distinct(), "doc_id", "left_anti")
        return shifted_items(moved, maps, ["doc_id"], "ord").unionByName(same.select(*files.columns))
    single = real.select("doc_id", F.col("src").alias("__src"), F.col("dst").alias("__dst"))
    at = F.when(F.col("__src").isNull(), F.col("ord")).otherwise(shifted(F.col("ord"), F.col("__src"), F.col("__dst")))
    return files.join(single, "doc_id", "left").select(
        *[c if c != "ord" else at.cast(files.schema["ord"].dataType).alias("ord") for c in files.columns]
    )


def remove_files(files: DataFrame, removals: DataFrame) -> DataFrame:
    """Take files out of their documents; the places of the others close up.

    ``files`` is (doc_id, ord, active, ...) with places from 0, ``removals`` (doc_id,
    ord) with places before anything is removed. The active file stays active; if
    it goes, the next one that stays is active, or the last one.
    """
    left = files.join(removals.select("doc_id", "ord").distinct(), ["doc_id", "ord"], "left_anti")
    was = files.filter("active").groupBy("doc_id").agg(F.max("ord").alias("__was"))
    now = left.join(was, "doc_id").groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(F.col("ord") >= F.col("__was"), F.col("ord"))), F.max("ord")).alias("__now")
    )
    places = scan_numbers(left, ["doc_id"], "ord", "__place").join(now, "doc_id", "left")
    new = {
        "ord": (F.col("__place") - 1).cast(files.schema["ord"].dataType),
        "active": F.coalesce(F.col("ord") == F.col("__now"), F.lit(False)),
    }
    return places.select(*[new[c].alias(c) if c in new else c for c in files.columns])


def merge_docs(pages: DataFrame, merges: DataFrame, targets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages of ``source`` documents in ``ord`` order as one ``target`` document.

    ``merges`` is (target, ord, source). A source may go to many targets, or
    twice to one; its pages meet each merge by block, so a source that holds
    most pages is spread over many tasks. The second frame names ``targets``
    without any input.
    """
    sizes = pages.groupBy("doc_id").agg(F.max("page").cast("bigint").alias("__n"))
    sized = merges.join(sizes, merges["source"] == sizes["doc_id"]).select(
        "target", "ord", "source", "__n"
    )
    placed = prefix_sums(sized, ["target"], "ord", {"__offset": F.col("__n")})
    spans = placed.select(
        F.col("source").alias("doc_id"),
        "target",
        "ord",
        "__offset",
        F.lit(1).cast("bigint").alias("__lo"),
        F.col("__n").alias("__hi"),
    )
    joined = range_join(pages, spans, ["doc_id"], "page", "__lo", "__hi")
    merged = joined.select(
        "target",
        (F.col("__offset") + F.col("page")).alias("pos"),
        "ord",
        F.col("doc_id").alias("source"),
        *[c for c in pages.columns if c != "doc_id"],
    )
    if targets is None:
        errors = merges.select("target").filter(F.lit(False))
    else:
        errors = targets.select("target").join(merges, "target", "left_anti")
    return merged, errors.withColumn("error", F.lit("NO_INPUT"))


def assemble(pages: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordered picks (doc_id, pos, path, page) with the page columns, and picks not found."""
    found = picks.join(pages, ["path", "page"])
    missing = picks.join(pages.select("path", "page"), ["path", "page"], "left_anti")
    rest = [c for c in pages.columns if c not in ("path", "page")]
    return found.select("doc_id", "pos", "path", "page", *rest), missing.select(
        "doc_id", "pos", "path", "page", F.lit("PAGE_NOT_FOUND").alias("error")
    )


def group_runs(
    picks: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    order: str = "pos",
    path: str = "path",
    page: str = "page",
    bits: int = ORDER_BITS,
) -> DataFrame:
    """(keys, group_no, path, item, page): neighbouring picks of one file, one row each.

    A file that returns later opens a new group; ``item`` numbers the picks of a
    group from 1.
    """
    src = picks.select(
        *keys, F.col(order).alias("__ord"), F.col(path).alias("path"), F.col(page).alias("page")
    )
    numbered = run_numbers(
        src, keys, "__ord", ["path"], lambda prev, cur: ~cur["path"].eqNullSafe(prev["path"]), "group_no", bits
    )
    items = row_numbers(numbered, [*keys, "group_no"], "__ord", "item", bits)
    return items.select(*keys, "group_no", "path", "item", "page")


def rotate(pages: DataFrame, rotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn output positions by 90, 180 or 270; overlapping groups add up.

    ``pages`` is (doc_id, pos, rotate, ...), ``rotations`` (doc_id, angle, spec)
    with "" or "all" for every page. The second frame holds refused groups.
    """
    good = F.col("angle").isin(90, 180, 270)
    wrong = rotations.filter(~good).select(
        "doc_id", "angle", "spec", F.lit("INVALID_ANGLE").alias("error")
    )
    whole = (F.col("spec") == "") | (F.lower("spec") == "all")
    parsed = rotations.filter(good).withColumn("__s", F.when(~whole, lenient_segments("spec")))
    broken = parsed.filter(F.col("__s.error").isNotNull() | F.col("spec").isNull()).select(
        "doc_id", "angle", "spec", F.coalesce("__s.error", F.lit("INVALID_PAGES")).alias("error")
    )
    everything = F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), F.lit(U32_MAX).cast("bigint").alias("hi")))
    groups = parsed.filter(F.col("__s.error").isNull() & F.col("spec").isNotNull()).select(
        "doc_id", "angle", F.explode(F.when(F.col("__s").isNull(), everything).otherwise(F.col("__s.segments"))).alias("__g")
    )
    # an angle begins at lo and ends after hi: running sums give stretches that do not overlap
    edge = F.array(
        F.struct(F.col("__g.lo").alias("at"), F.col("angle").cast("bigint").alias("by")),
        F.struct((F.col("__g.hi") + 1).alias("at"), (-F.col("angle").cast("bigint")).alias("by")),
    )
    edges = groups.select("doc_id", F.explode(edge).alias("__e")).groupBy("doc_id", "__e.at").agg(F.sum("__e.by").alias("by"))
    along = Window.partitionBy("doc_id").orderBy("at")  # edges of instructions, not pages
    stretches = edges.select(
        "doc_id",
        F.col("at").alias("__lo"),
        (F.lead("at").over(along) - 1).alias("__hi"),
        F.sum("by").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("__turn"),
    ).filter("__turn <> 0")
    stretches = clip(stretches, pages, ["doc_id"], "pos", "__hi")
    out = range_join(pages, stretches, ["doc_id"], "pos", "__lo", "__hi", "left")
    angle = F.pmod(F.col("rotate") + F.coalesce("__turn", F.lit(0)), F.lit(360)).cast("int").alias("rotate")
    return out.select(*[c if c != "rotate" else angle for c in pages.columns]), wrong.unionByName(broken)


def split_every(pages: DataFrame, n: int, stem: Column) -> DataFrame:
    """Add ``part`` and ``output``; ``stem`` is the name of the document's first file."""
    part = F.floor((F.col("pos") - 1) / F.lit(max(n, 1))).cast("bigint") + 1
    return pages.withColumn("part", part).withColumn(
        "output", F.concat(stem, F.format_string("-part%03d.pdf", F.col("part")))
    )


def split_ranges(pages: DataFrame, ranges: DataFrame, stem: Column) -> tuple[DataFrame, DataFrame]:
    """One output per range (doc_id, range_no, start, end); ranges may overlap.

    Reversed bounds are swapped and clamped to the document; a range past its
    end is INVALID_RANGE.
    """
    sizes = pages.groupBy("doc_id").agg(F.max("pos").alias("__n"))
    sized = ranges.join(sizes, "doc_id", "left").select(
        "doc_id",
        "range_no",
        F.greatest(F.least("start", "end"), F.lit(1)).alias("__lo"),
        F.least(F.greatest("start", "end"), F.coalesce(F.col("__n"), F.lit(0))).alias("__hi"),
        F.coalesce(F.col("__n"), F.lit(0)).alias("__n"),
    )
    errors = sized.filter(F.col("__lo") > F.col("__n")).select(
        "doc_id", "range_no", F.lit("INVALID_RANGE").alias("error")
    )
    joined = range_join(
        pages, sized.filter(F.col("__lo") <= F.col("__n")).drop("__n"), ["doc_id"], "pos", "__lo", "__hi"
    )
    output = F.concat(
        stem, F.format_string("_p%d-%d.pdf", F.col("__lo").cast("bigint"), F.col("__hi").cast("bigint"))
    )
    return joined.withColumn("output", output).drop("__lo", "__hi"), errors


def remap(
    annots: DataFrame, old_keys: DataFrame, new_keys: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move annotations to the first place of their page key in a new page list.

    ``old_keys`` and ``new_keys`` are (doc_id, page_index, key), 0-based. Returns
    kept annotations, dropped ones, and per document whether anything was
    dropped, which also clears its undo history.
    """
    old = old_keys.select("doc_id", "page_index", F.col("key").alias("__key"))
    new = new_keys.groupBy("doc_id", F.col("key").alias("__key")).agg(
        F.min("page_index").alias("__next")
    )
    placed = annots.join(old, ["doc_id", "page_index"], "left").join(new, ["doc_id", "__key"], "left")
    kept = placed.filter(F.col("__next").isNotNull()).select(
        *[c if c != "page_index" else F.col("__next").alias("page_index") for c in annots.columns]
    )
    dropped = placed.filter(F.col("__next").isNull()).select(*annots.columns)
    history = placed.groupBy("doc_id").agg(
        F.bool_or(F.col("__next").isNull()).alias("history_dropped")
    )
    return kept, dropped, history


def place_matrix(page_box: Column, rotate: Column, slot: Column) -> Column:
    """Six-value matrix that draws a page centred in a slot, its rotation baked in.

    Null for a page with a side of 1 pt or less.
    """

    b, s = page_box, slot
    size = geo.displayed_size(b, rotate)
    slot_w, slot_h = s["x1"] - s["x0"], s["y1"] - s["y0"]
    r = geo.turn(rotate)

    def fit(v: Column) -> Column:
        return F.least(
            F.greatest(slot_w - 2 * GUTTER, F.lit(1.0)) / v["w"],
            F.greatest(slot_h - 2 * GUTTER, F.lit(1.0)) / v["h"],
        )

    def by_turn(zero: Column, quarter: Column, half: Column, three: Column) -> Column:
        return F.when(r == 90, quarter).when(r == 180, half).when(r == 270, three).otherwise(zero)

    one, no = F.lit(1.0), F.lit(0.0)
    e = by_turn(-b["x0"], -b["y0"], b["x1"], b["y1"])
    f = by_turn(-b["y0"], b["x1"], b["y1"], -b["x0"])

    def scaled(m: Column) -> Column:
        return F.array(
            m["k"] * by_turn(one, no, -one, no),
            m["k"] * by_turn(no, -one, no, one),
            m["k"] * by_turn(no, one, no, -one),
            m["k"] * by_turn(one, no, -one, no),
            m["k"] * e + s["x0"] + (slot_w - m["k"] * m["size"]["w"]) / 2,
            m["k"] * f + s["y0"] + (slot_h - m["k"] * m["size"]["h"]) / 2,
        )

    usable = (b["x1"] - b["x0"] > 1) & (b["y1"] - b["y0"] > 1)
    fitted = let(size, lambda v: F.struct(fit(v).alias("k"), v.alias("size")))
    return F.when(usable, let(fitted, scaled))


def slot_box(mode: str, slot: Column, sheet_w: float, sheet_h: float) -> Column:
    """Box of 0-based ``slot`` on a sheet, slots in reading order."""
    w, h = float(sheet_w), float(sheet_h)
    right = F.pmod(slot, F.lit(2)) == 1
    x0 = F.when(right, w / 2).otherwise(0.0)
    x1 = F.when(right, w).otherwise(w / 2)
    if mode == "4up":
        top = slot < 2
        return geo.box(x0, F.when(top, h / 2).otherwise(0.0), x1, F.when(top, h).otherwise(h / 2))
    return geo.box(x0, F.lit(0.0), x1, F.lit(h))


def sheet_plan(
    docs: DataFrame, boxes: DataFrame, mode: str, sheet_w: float, sheet_h: float, max_sheets: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sheet, slot, page, matrix) for 2up, 4up or booklet printing.

    ``docs`` is (doc_id, n), ``boxes`` (doc_id, page, box, rotate). Page 0 is an
    empty slot. Documents of more than ``max_sheets`` sheets are refused, if it is set.
    """
    if mode not in SLOTS:
        raise ValueError("INVALID_MODE")
    n = F.col("n").cast("bigint")
    per = SLOTS[mode]
    sheets = F.ceil(n / 4) * 2 if mode == "booklet" else F.ceil(n / per)
    sized = docs.select("doc_id", n.alias("n"), sheets.cast("bigint").alias("__sheets"))
    error = F.when(F.lit(min(sheet_w, sheet_h) < MIN_SHEET), "SHEET_TOO_SMALL")
    if max_sheets is not None:
        error = error.when(F.col("__sheets") > max_sheets, "TOO_MANY_SHEETS")
    sized = sized.withColumn("error", error)
    errors = sized.filter(F.col("error").isNotNull()).select("doc_id", "error")

    plan = sized.filter(F.col("error").isNull() & (F.col("__sheets") >= 1))
    plan = number_units(plan, ["doc_id"], "__sheets", "sheet")
    plan = plan.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per - 1))))
    if mode == "booklet":
        # outer pages alternate sides: (n,1), (2,n-1), (n-2,3), ...
        front = F.col("sheet")
        back = F.col("__sheets") * 2 + 1 - F.col("sheet")
        odd_sheet = F.pmod(F.col("sheet"), F.lit(2)) == 1
        first = F.when(odd_sheet, back).otherwise(front)
        second = F.when(odd_sheet, front).otherwise(back)
        page = F.when(F.col("slot") == 0, first).otherwise(second)
    else:
        page = (F.col("sheet") - 1) * per + F.col("slot") + 1
    plan = plan.select(
        "doc_id", "sheet", "slot", F.when(page <= F.col("n"), page).otherwise(F.lit(0)).alias("page")
    )
    shapes = boxes.select("doc_id", "page", "box", "rotate")
    placed = plan.join(shapes, ["doc_id", "page"], "left")
    placed = placed.withColumn("__slot", slot_box(mode, F.col("slot"), sheet_w, sheet_h))
    matrix = place_matrix(F.col("box"), F.col("rotate"), F.col("__slot"))
    return placed.select("doc_id", "sheet", "slot", "page", matrix.alias("matrix")), errors


def _tile_layout(short: float, long: float, orientation: str, overlap: float, max_tiles: int | None) -> Column:
    """struct(w, h, gap, cols, rows, error) of the tiles of a page (box, rotate)."""

    def sheets(size: Column, w: float, h: float) -> Column:
        across = geo.tile_count(size["w"], F.lit(w), F.lit(overlap))
        return across * geo.tile_count(size["h"], F.lit(h), F.lit(overlap))

    if orientation == "portrait":
        upright = F.lit(True)
    elif orientation == "landscape":
        upright = F.lit(False)
    else:
        upright = let(
            geo.displayed_size("box", "rotate"),
            lambda s: ~(sheets(s, long, short) < sheets(s, short, long)),
        )
    # tiles are cut in page space, so a sideways page swaps the sides once more
    sideways = F.pmod(geo.turn("rotate"), F.lit(180)) == 90

    def sides(up: Column) -> Column:
        return F.struct(
            F.when(up, short).otherwise(long).alias("w"), F.when(up, long).otherwise(short).alias("h")
        )

    gap = max(min(max(overlap, 0.0), short - 12.0), 0.0)

    def counted(t: Column) -> Column:
        return F.struct(
            t["w"].alias("w"),
            t["h"].alias("h"),
            geo.tile_count(F.col("box.x1") - F.col("box.x0"), t["w"], F.lit(gap)).alias("cols"),
            geo.tile_count(F.col("box.y1") - F.col("box.y0"), t["h"], F.lit(gap)).alias("rows"),
        )

    def judged(c: Column) -> Column:
        error = F.when(F.lit(short < MIN_TILE), "TILE_TOO_SMALL")
        if max_tiles is not None:
            error = error.when(c["cols"] * c["rows"] > max_tiles, "TOO_MANY_TILES")
        return F.struct(*[c[n].alias(n) for n in ("w", "h", "cols", "rows")], F.lit(gap).alias("gap"), error.alias("error"))

    return let(let(let(upright != sideways, sides), counted), judged)


def tile_plan(
    page_boxes: DataFrame,
    paper: str = "a4",
    orientation: str = "auto",
    overlap: float = 0.0,
    keys: Sequence[str] = ("doc_id", "page"),
    max_tiles: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(keys, row, col, box): a page cut into sheets of paper, top to bottom.

    ``page_boxes`` is (keys, box, rotate). "auto" takes the orientation with
    fewer sheets, portrait on a tie. Pages of more than ``max_tiles`` tiles are refused, if it is set.
    """
    short_mm, long_mm = geo.PAPERS.get(paper, geo.PAPERS["a4"])
    layout = _tile_layout(
        short_mm * geo.PT_PER_MM, long_mm * geo.PT_PER_MM, orientation, float(overlap), max_tiles
    )
    df = page_boxes.select(*keys, "box", layout.alias("__g"))
    errors = df.filter(F.col("__g.error").isNotNull()).select(*keys, F.col("__g.error").alias("error"))

    g = F.col("__g")
    tiles = df.filter(g["error"].isNull())
    tiles = tiles.withColumn("row", F.explode(F.sequence(F.lit(0).cast("bigint"), g["rows"] - 1)))
    tiles = tiles.withColumn("col", F.explode(F.sequence(F.lit(0).cast("bigint"), g["cols"] - 1)))
    step_x = F.greatest(g["w"] - g["gap"], F.lit(1.0))
    step_y = F.greatest(g["h"] - g["gap"], F.lit(1.0))
    tiles = tiles.withColumns(
        {
            "__top": F.least(F.col("box.y1") - F.col("row") * step_y, F.col("box.y1")),
            "__left": F.greatest(F.col("box.x0") + F.col("col") * step_x, F.col("box.x0")),
        }
    )
    cut = geo.box(
        F.col("__left"),
        F.greatest(F.col("__top") - g["h"], F.col("box.y0")),
        F.least(F.col("__left") + g["w"], F.col("box.x1")),
        F.col("__top"),
    )
    tiles = tiles.select(*keys, "row", "col", cut.alias("box"))
    whole = (F.col("box.x1") - F.col("box.x0") >= 2) & (F.col("box.y1") - F.col("box.y0") >= 2)
    return tiles.filter(whole), errors
