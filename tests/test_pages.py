"""Selection and assembly of pages."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.operators import assemble as A
from quire.operators.labels import bates, recent_jobs, z_order
from quire.operators.select import delete_pages, extract_pages, format_ranges


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def pages_of(spark, sizes, pos="page"):
    data = [(d, p, f"{d}.{p}") for d, n in sizes.items() for p in range(1, n + 1)]
    return spark.createDataFrame(data, f"doc_id int, {pos} int, text string")


def test_delete(spark):
    pages = pages_of(spark, {1: 5, 2: 3, 3: 2, 4: 2})
    specs = spark.createDataFrame([(1, "2-3,9"), (2, "3-1"), (3, "a"), (7, "1")], "doc_id int, spec string")
    kept, errors = delete_pages(pages, specs)
    assert rows(kept, "doc_id", "page") == [(1, 1), (1, 4), (1, 5), (4, 1), (4, 2)]
    assert rows(errors, "doc_id", "error") == [(2, "DELETE_ALL"), (3, "INVALID_PAGES")]


def test_extract(spark):
    pages = pages_of(spark, {1: 4, 2: 3, 3: 3})
    specs = spark.createDataFrame(
        [(1, "z-3,1,1", 4), (2, "", 3), (3, "5", 3)], "doc_id int, spec string, n int"
    )
    found, errors = extract_pages(pages, specs)
    assert rows(found, "doc_id", "position", "page") == [
        (1, 1, 4), (1, 2, 3), (1, 3, 1), (1, 4, 1), (2, 1, 1), (2, 2, 2), (2, 3, 3),
    ]
    assert rows(errors, "doc_id", "error") == [(3, "OUT_OF_RANGE")]


@pytest.mark.parametrize("bits", [0, 1, 16])
def test_format_ranges_keeps_order(spark, bits):
    lists = {1: [1, 2, 3, 5, 7, 8], 2: [1, 3, 4, 6], 3: [2], 4: [5, 4, 3, 9, 10, 10]}
    data = [(k, i, p) for k, ps in lists.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(data, "k int, i int, page int")
    parts = {}
    for r in format_ranges(df, ["k"], "page", "i", bits).orderBy("k", "run").collect():
        parts.setdefault(r["k"], []).append(r["spec"])
    joined = {k: ",".join(v) for k, v in parts.items()}
    assert joined == {1: "1-3,5,7-8", 2: "1,3-4,6", 3: "2", 4: "5,4,3,9-10,10"}


def files(spark):
    return spark.createDataFrame(
        [(1, 0, "f1", 2), (1, 1, "f2", 1), (1, 2, "f3", 0), (1, 3, "f4", None), (1, 4, "f5", 3), (2, 0, "f1", 1)],
        "doc_id int, ord int, uid string, page_count int",
    )


@pytest.mark.parametrize("bits", [0, 1, 16])
def test_combine(spark, bits):
    got = rows(A.combine(files(spark), bits), "doc_id", "pos", "key")
    assert got == [
        (1, 1, "f1#1"), (1, 2, "f1#2"), (1, 3, "f2#1"), (1, 4, "f5#1"), (1, 5, "f5#2"), (1, 6, "f5#3"), (2, 1, "f1#1"),
    ]


@pytest.mark.parametrize(
    "number,prefix,pad,date,label",
    [
        (123, "DAVA-", 6, None, "DAVA-000123"),
        (123, "DAVA-", 6, "2026-07-02", "DAVA-000123 – 02.07.2026"),
        (7, "", 0, None, "7"),
        (12345, "", 2, None, "12345"),
        (-5, "", 4, None, "-005"),
    ],
)
def test_bates(spark, number, prefix, pad, date, label):
    day = None if date is None else F.to_date(F.lit(date))
    df = spark.createDataFrame([(1, 3)], "doc_id int, pos int")
    assert bates(df, number - 2, prefix, pad, day).first()["label"] == label


@pytest.mark.parametrize("src,dst,order", [(0, 2, "bcad"), (3, 0, "dabc"), (1, 1, "abcd"), (0, 4, "abcd"), (-1, 2, "abcd")])
def test_move_file(spark, src, dst, order):
    df = spark.createDataFrame([(1, i, u, u == "b") for i, u in enumerate("abcd")], "doc_id int, ord int, uid string, active boolean")
    moves = spark.createDataFrame([(1, src, dst)], "doc_id int, src int, dst int")
    got = A.move_file(df, moves).orderBy("ord").collect()
    assert "".join(r["uid"] for r in got) == order
    assert [r["ord"] for r in got] == [0, 1, 2, 3]
    assert [r["uid"] for r in got if r["active"]] == ["b"]


def test_moves_of_a_document_in_order(spark):
    df = spark.createDataFrame([(d, i, u) for d in (1, 2) for i, u in enumerate("abcd")], "doc_id int, ord int, uid string")
    moves = spark.createDataFrame([(1, 5, 3, 0), (1, 2, 0, 3), (1, 9, 1, 7), (2, 1, 1, 2)], "doc_id int, seq int, src int, dst int")
    got = A.move_file(df, moves).orderBy("doc_id", "ord").collect()
    assert "".join(r["uid"] for r in got) == "abcd" + "acbd"
    moves = spark.createDataFrame([(1, 1, 0, 3), (1, 2, 0, 1)], "doc_id int, seq int, src int, dst int")
    assert "".join(r["uid"] for r in A.move_file(df, moves).filter("doc_id = 1").orderBy("ord").collect()) == "cbda"


def test_merge_and_split_back(spark):
    pages = pages_of(spark, {1: 3, 2: 2, 3: 4})
    merges = spark.createDataFrame([("t", 5, 3), ("t", 1, 1), ("t", 9, 1), ("u", 1, 2)], "target string, ord int, source int")
    targets = spark.createDataFrame([("t",), ("u",), ("w",)], "target string")
    merged, errors = A.merge_docs(pages, merges, targets)
    got = {(r["target"], r["pos"]): r["text"] for r in merged.collect()}
    want = ["1.1", "1.2", "1.3", "3.1", "3.2", "3.3", "3.4", "1.1", "1.2", "1.3"]
    assert got == {**{("t", i + 1): t for i, t in enumerate(want)}, ("u", 1): "2.1", ("u", 2): "2.2"}
    assert rows(errors, "target", "error") == [("w", "NO_INPUT")]

    # cut t at the joints again: each piece is its source
    whole = merged.filter("target = 't'").select(F.lit(1).alias("doc_id"), "pos", "text")
    cuts = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 4, 7)], "doc_id int, range_no int, start int, end int")
    parts, _ = A.split_ranges(whole, cuts, F.lit("t"))
    again = {}
    for r in parts.orderBy("range_no", "pos").collect():
        again.setdefault(r["output"], []).append(r["text"])
    assert again == {"t_p1-3.pdf": ["1.1", "1.2", "1.3"], "t_p4-7.pdf": ["3.1", "3.2", "3.3", "3.4"]}


def test_split_every_and_ranges(spark):
    pages = pages_of(spark, {1: 5}, "pos")
    got = rows(A.split_every(pages, 2, F.lit("s")), "pos", "part", "output")
    assert [g[1] for g in got] == [1, 1, 2, 2, 3] and got[4][2] == "s-part003.pdf"
    assert {r["part"] for r in A.split_every(pages, 0, F.lit("s")).collect()} == {1, 2, 3, 4, 5}
    ranges = spark.createDataFrame(
        [(1, 1, 4, 2), (1, 2, 0, 9), (1, 3, 6, 8), (2, 1, 1, 1)], "doc_id int, range_no int, start int, end int"
    )
    parts, errors = A.split_ranges(pages, ranges, F.lit("s"))
    assert rows(parts.groupBy("output").count(), "output", "count") == [("s_p1-5.pdf", 5), ("s_p2-4.pdf", 3)]
    assert rows(errors, "doc_id", "range_no") == [(1, 3), (2, 1)]


def test_assemble(spark):
    pages = spark.createDataFrame([("a", 1, "a1"), ("a", 2, "a2"), ("b", 1, "b1")], "path string, page int, text string")
    picks = spark.createDataFrame([(1, 1, "b", 1), (1, 2, "a", 2), (1, 3, "b", 1), (1, 4, "a", 9)], "doc_id int, pos int, path string, page int")
    found, missing = A.assemble(pages, picks)
    assert rows(found, "pos", "text") == [(1, "b1"), (2, "a2"), (3, "b1")]
    assert rows(missing, "pos", "error") == [(4, "PAGE_NOT_FOUND")]


@pytest.mark.parametrize("bits", [0, 1, 16])
def test_group_runs(spark, bits):
    picks = [("a", 1), ("a", 3), ("b", 1), ("a", 2), ("a", 2)]
    df = spark.createDataFrame([(1, i, p, g) for i, (p, g) in enumerate(picks)], "doc_id int, pos int, path string, page int")
    got = A.group_runs(df, bits=bits).orderBy("group_no", "item").collect()
    assert [tuple(r)[1:] for r in got] == [(1, "a", 1, 1), (1, "a", 2, 3), (2, "b", 1, 1), (3, "a", 1, 2), (3, "a", 2, 2)]


def test_a_run_across_a_block_border_is_one(spark):
    df = spark.createDataFrame([(1, p, "a", p) for p in (65534, 65535, 65536)] + [(2, 900_000, "a", 1)], "doc_id int, pos int, path string, page int")
    got = A.group_runs(df).orderBy("doc_id", "item").collect()
    assert [(r["doc_id"], r["group_no"], r["item"]) for r in got] == [(1, 1, 1), (1, 1, 2), (1, 1, 3), (2, 1, 1)]


def test_rotate(spark):
    pages = spark.createDataFrame([(1, p, 270) for p in (1, 2, 3)] + [(2, 1, 0)], "doc_id int, pos int, rotate int")
    turns = spark.createDataFrame(
        [(1, 90, ""), (1, 180, "2-3"), (1, 90, "3-900000000"), (2, 45, "all"), (2, 90, "?"), (2, 180, None)], "doc_id int, angle int, spec string"
    )
    turned, errors = A.rotate(pages, turns)
    assert rows(turned, "doc_id", "pos", "rotate") == [(1, 1, 0), (1, 2, 180), (1, 3, 270), (2, 1, 0)]
    assert rows(errors, "angle", "error") == [(180, "INVALID_PAGES"), (45, "INVALID_ANGLE"), (90, "INVALID_PAGES")]


@pytest.mark.parametrize(
    "old,new,index,want",
    [
        (["f1#1", "f1#2"], ["f1#1", "f1#2", "f2#1"], 1, 1),
        (["f1#1", "f2#1", "f2#2"], ["f2#1", "f2#2"], 2, 1),
        (["f1#1", "f2#1"], ["f1#1"], 1, None),
        (["f1#1"], ["f1#1", "f2#1"], 0, 0),
        (["f1#1"], ["f1#1"], 3, None),
        (["a#1"], ["b#1", "a#1", "a#1"], 0, 1),
    ],
)
def test_remap(spark, old, new, index, want):
    def keys(names):
        return spark.createDataFrame([(1, i, k) for i, k in enumerate(names)], "doc_id int, page_index int, key string")

    annots = spark.createDataFrame([(1, "x", index)], "doc_id int, id string, page_index int")
    kept, dropped, history = A.remap(annots, keys(old), keys(new))
    assert [r["page_index"] for r in kept.collect()] == ([] if want is None else [want])
    assert [r["id"] for r in dropped.collect()] == (["x"] if want is None else [])
    assert history.first()["history_dropped"] is (want is None)


@pytest.mark.parametrize(
    "mode,n,sheets",
    [
        ("booklet", 8, [[8, 1], [2, 7], [6, 3], [4, 5]]),
        ("booklet", 4, [[4, 1], [2, 3]]),
        ("booklet", 5, [[0, 1], [2, 0], [0, 3], [4, 5]]),
        ("booklet", 6, [[0, 1], [2, 0], [6, 3], [4, 5]]),
        ("2up", 5, [[1, 2], [3, 4], [5, 0]]),
        ("4up", 6, [[1, 2, 3, 4], [5, 6, 0, 0]]),
        ("2up", 0, []),
    ],
)
def test_sheet_plan(spark, mode, n, sheets):
    docs = spark.createDataFrame([(1, n), (2, 9000)], "doc_id int, n int")
    boxes = spark.range(1, n + 1).select(
        F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page"),
        geo.box(F.lit(0), F.lit(0), F.lit(612), F.lit(792)).alias("box"), F.lit(0).alias("rotate"),
    )
    plan, errors = A.sheet_plan(docs, boxes, mode, 842, 595, max_sheets=2000)
    got = {}
    for r in plan.orderBy("sheet", "slot").collect():
        got.setdefault(r["sheet"], []).append(r["page"])
        assert (r["matrix"] is None) == (r["page"] == 0)
    assert list(got.values()) == sheets
    assert [tuple(r) for r in errors.collect()] == [(2, "TOO_MANY_SHEETS")]
    tiny = A.sheet_plan(docs, boxes, mode, 842, 71)[1].collect()
    assert {r["error"] for r in tiny} == {"SHEET_TOO_SMALL"}


@pytest.mark.parametrize("rotate", [0, 90, 180, 270])
def test_place_matrix_keeps_pages_in_their_slot(one, rotate):
    page = geo.box(F.lit(5), F.lit(7), F.lit(600), F.lit(849))
    slot = geo.box(F.lit(421), F.lit(0), F.lit(842), F.lit(595))
    a, b, c, d, e, f = one(A.place_matrix(page, F.lit(rotate), slot))
    for x, y in ((5, 7), (600, 7), (5, 849), (600, 849)):
        px, py = a * x + c * y + e, b * x + d * y + f
        assert 421 + 12 - 1e-6 <= px <= 842 - 12 + 1e-6
        assert 12 - 1e-6 <= py <= 595 - 12 + 1e-6


def test_place_matrix_values(one):
    slot = geo.box(F.lit(0), F.lit(0), F.lit(421), F.lit(595))
    letter = geo.box(F.lit(0), F.lit(0), F.lit(612), F.lit(792))
    m = one(A.place_matrix(letter, F.lit(0), slot))
    fit = min(397 / 612, 571 / 792)
    assert m == pytest.approx([fit, 0, 0, fit, (421 - fit * 612) / 2, (595 - fit * 792) / 2])
    thin = geo.box(F.lit(0), F.lit(0), F.lit(0.5), F.lit(792))
    assert one(A.place_matrix(thin, F.lit(0), slot)) is None


@pytest.mark.parametrize(
    "w,h,rotate,orientation,count,first",
    [
        (500, 1600, 0, "auto", 2, (595.27, 841.89)),
        (1600, 500, 0, "auto", 2, (841.89, 500)),
        (500, 500, 0, "auto", 1, (500, 500)),
        (500, 1600, 90, "auto", 2, (500, 841.89)),
        (1000, 1000, 0, "landscape", 4, (841.89, 595.27)),
    ],
)
def test_tile_plan(spark, w, h, rotate, orientation, count, first):
    df = spark.range(1).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page"), geo.box(F.lit(0), F.lit(0), F.lit(w), F.lit(h)).alias("box"),
        F.lit(rotate).alias("rotate"),
    )
    tiles, errors = A.tile_plan(df, "a4", orientation)
    got = tiles.orderBy("row", "col").collect()
    assert len(got) == count and errors.count() == 0
    b = got[0]["box"]
    assert b["y1"] == h and b["x0"] == 0
    assert b["x1"] - b["x0"] == pytest.approx(min(w, first[0]), abs=0.01)
    assert b["y1"] - b["y0"] == pytest.approx(min(h, first[1]), abs=0.01)


def test_tile_plan_limit(spark):
    df = spark.range(1).select(
        F.lit(1).alias("doc_id"), F.lit(1).alias("page"), geo.box(F.lit(0), F.lit(0), F.lit(20000), F.lit(20000)).alias("box"),
        F.lit(0).alias("rotate"),
    )
    assert A.tile_plan(df)[0].count() > 600 and A.tile_plan(df)[1].count() == 0
    tiles, errors = A.tile_plan(df, max_tiles=600)
    assert tiles.count() == 0 and errors.first()["error"] == "TOO_MANY_TILES"


@pytest.mark.parametrize(
    "oid,direction,order",
    [("a", "front", "bca"), ("c", "back", "cab"), ("b", "forward", "acb"), ("b", "backward", "bac"),
     ("c", "front", "abc"), ("c", "forward", "abc"), ("a", "backward", "abc"), ("nope", "back", "abc")],
)
def test_z_order(spark, oid, direction, order):
    rows_ = [(1, 0, u, i * 10) for i, u in enumerate("abc")] + [(1, 1, "other", 5)]
    annots = spark.createDataFrame(rows_, "doc_id int, page_index int, id string, ord int")
    moves = spark.createDataFrame([(1, oid, direction)], "doc_id int, id string, dir string")
    got = z_order(annots, moves).filter("page_index = 0").orderBy("ord").collect()
    assert "".join(r["id"] for r in got) == order
    assert [r["ord"] for r in got] == [1, 2, 3]


def test_z_order_of_several_moves(spark):
    annots = spark.createDataFrame([(1, 0, u, i * 10) for i, u in enumerate("abc")], "doc_id int, page_index int, id string, ord int")
    kind = "doc_id int, seq int, id string, dir string"
    for moves, order in (
        ([(1, 1, "a", "front"), (1, 2, "b", "front")], "cab"), ([(1, 2, "a", "front"), (1, 1, "b", "front")], "cba"),
        ([(1, 1, "a", "forward"), (1, 2, "a", "forward"), (1, 3, "a", "forward")], "bca"), ([(1, 1, "c", "back"), (1, 2, "a", "backward")], "acb"),
    ):
        got = z_order(annots, spark.createDataFrame(moves, kind), block_moves=1).orderBy("ord").collect()
        assert ("".join(r["id"] for r in got), [r["ord"] for r in got]) == (order, [1, 2, 3])


def test_recent_jobs(spark):
    jobs = spark.createDataFrame(
        [("a", 1, "failed"), ("b", 2, "completed"), ("a", 3, "completed"), ("c", 0, "cancelled")], "id string, finished_at long, status string"
    )
    got = recent_jobs(jobs, 2).collect()
    assert [(r["id"], r["finished_at"], r["status"]) for r in got] == [("a", 3, "completed"), ("b", 2, "completed")]


@pytest.mark.parametrize("block", [7, 64])
def test_long_lists_of_moves_against_a_list(spark, block):
    """One document has most moves; moves that change nothing are among them."""
    rng = random.Random(block)
    sizes = {1: 50, 2: 9, 3: 1, 4: 6}
    lists = {d: list(range(n)) for d, n in sizes.items()}
    moves = []
    for seq in range(150):
        d = 1 if rng.random() < 0.85 else rng.choice([2, 3])
        src, dst = rng.randrange(-1, sizes[d] + 1), rng.randrange(-1, sizes[d] + 1)
        moves.append((d, seq * 3, src, dst))
        if 0 <= src < sizes[d] and 0 <= dst < sizes[d]:
            lists[d].insert(dst, lists[d].pop(src))
    df = spark.createDataFrame([(d, i, i) for d, n in sizes.items() for i in range(n)], "doc_id int, ord int, uid int")
    frame = spark.createDataFrame(rng.sample(moves, len(moves)), "doc_id int, seq int, src int, dst int")
    got = A.move_file(df, frame, block).collect()
    assert {(r["doc_id"], r["ord"]): r["uid"] for r in got} == {(d, i): u for d, items in lists.items() for i, u in enumerate(items)}
    assert len(got) == sum(sizes.values())


@pytest.mark.parametrize("block", [24, 200])
def test_long_lists_of_layer_moves_against_a_list(spark, block):
    rng = random.Random(block)
    pages = {(1, 0): list("abcdefghij"), (1, 1): list("xyz"), (2, 0): ["a"], (3, 0): list("pq")}
    annots = spark.createDataFrame([(d, p, i, k * 10) for (d, p), ids in pages.items() for k, i in enumerate(ids)], "doc_id int, page_index int, id string, ord int")
    moves = []
    for seq in range(90):
        key = (1, 0) if rng.random() < 0.8 else rng.choice([(1, 1), (2, 0)])
        i, way = rng.choice(pages[key]), rng.choice(["front", "back", "forward", "backward"])
        moves.append((key[0], seq, i, way))
        at = pages[key].index(i)
        pages[key].insert(max(0, {"front": len(pages[key]), "back": 0, "forward": at + 1, "backward": at - 1}[way]), pages[key].pop(at))
    frame = spark.createDataFrame(rng.sample(moves, len(moves)), "doc_id int, seq int, id string, dir string")
    got = z_order(annots, frame, block).collect()
    assert {(r["doc_id"], r["page_index"], r["ord"]): r["id"] for r in got} == {(*key, k + 1): i for key, ids in pages.items() for k, i in enumerate(ids)}


def test_a_hundred_thousand_moves_of_one_document(spark):
    """Places are followed one by one for a few files only."""
    n, m = 3000, 100_000
    moves = spark.range(m).selectExpr("1 AS doc_id", "id AS seq", "(id * 7919 + 13) % 3000 AS src", "(id * 104729 + 7) % 3000 AS dst")
    df = spark.range(n).selectExpr("1 AS doc_id", "id AS ord", "id AS uid")
    order = list(range(n))
    for k in range(m):
        src, dst = (k * 7919 + 13) % n, (k * 104729 + 7) % n
        order.insert(dst, order.pop(src))
    moved = A.move_file(df, moves)
    assert "collect_list" not in moved._jdf.queryExecution().executedPlan().toString()
    assert [r["uid"] for r in moved.orderBy("ord").collect()] == order


@pytest.mark.parametrize("active", [0, 3, 5, None])
def test_files_are_removed_as_one_by_one(spark, active):
    rng = random.Random(active)
    gone, rows, want = [], [], {}
    for doc in range(12):
        names, at = list(range(6)), active
        out = rng.sample(range(6), rng.randrange(7))
        for place in out:
            i = names.index(place)
            del names[i]
            if at is not None:
                at = at - 1 if i < at else at
                at = max(0, len(names) - 1) if at >= len(names) else at
        rows += [(doc, k, k, k == active) for k in range(6)]
        gone += [(doc, k) for k in out] + [(doc, 99)]
        want.update({(doc, n): (k, k == at) for k, n in enumerate(names)})
    files_ = spark.createDataFrame(rows, "doc_id int, ord int, uid int, active boolean")
    got = A.remove_files(files_, spark.createDataFrame(gone, "doc_id int, ord int"))
    assert got.columns == files_.columns
    assert {(r["doc_id"], r["uid"]): (r["ord"], r["active"]) for r in got.collect()} == want
