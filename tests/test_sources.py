"""Catalogue, intake, images, names and sinks on real files."""

import json
import random
import re

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quire.operators.metadata import meta_edit, meta_read
from quire.operators.outline import outline
from quire.plans import registry
from quire.plans.catalog import flows, streams
from quire.sources import files, images, sinks

SF = "/root/testdata/sf0.001"


def test_scan_files(spark, tmp_path):
    for name, size in (("a.pdf", 5), ("b.PDF", 7), ("c.txt", 3), ("sub/d.pdf", 1)):
        target = tmp_path / name
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(b"x" * size)
    counts = spark.createDataFrame(
        [(f"file:{tmp_path}/{n}", c) for n, c in (("a.pdf", 4), ("c.txt", 9), ("sub/d.pdf", None))], "path string, page_count int"
    )
    got = {r["name"]: (r["size"], r["page_count"], r["is_valid"]) for r in files.scan_files(spark, str(tmp_path), counts).collect()}
    assert got == {"a.pdf": (5, 4, True), "b.PDF": (7, None, False), "c.txt": (3, None, False), "d.pdf": (1, None, False)}


def test_scan_lists_empty_and_hidden_files_and_opens_none(spark, tmp_path, monkeypatch):
    want = {}
    for k in range(90):  # more folders than are opened before tasks take over
        folder = tmp_path / "wide" / f"d{k}" / ".inner"
        folder.mkdir(parents=True)
        (folder / f"f{k}.pdf").write_bytes(b"x" * k)
        want[f"file:{folder}/f{k}.pdf"] = k
    for name in (".hidden.pdf", "_SUCCESS.pdf", "empty.pdf", "no.txt", "with space é.pdf"):
        (tmp_path / name).write_bytes(b"" if "empty" in name else b"yy")
        want[f"file:{tmp_path}/{name}"] = 0 if "empty" in name else 2
    (tmp_path / "closed.pdf").write_bytes(b"abc")
    (tmp_path / "closed.pdf").chmod(0)
    want[f"file:{tmp_path}/closed.pdf"] = 3
    found = files.scan_files(spark, str(tmp_path))
    assert {r["path"]: r["size"] for r in found.collect()} == want and found.count() == len(want)
    only = files.scan_files(spark, f"file://{tmp_path}", pattern="*.pdf")
    assert {r["path"] for r in only.collect()} == {p for p in want if p.endswith(".pdf")}
    (tmp_path / "nothing").mkdir()
    assert files.scan_files(spark, str(tmp_path / "nothing")).count() == 0


def test_intake(spark):
    incoming = spark.createDataFrame(
        list(enumerate(["/x/a.pdf", "/x/a.pdf", "/x/b.pdf", "/x/i.png", "/x/i.png", "/x/d.docx", "/x/z.zip", "/x/bad.pdf", "/x/e.jpg"])),
        "seq int, path string",
    )
    existing = spark.createDataFrame([("/x/b.pdf",), ("/x/i.png",)], "path string")
    info = spark.createDataFrame(
        [("/x/a.pdf", True, None), ("/x/b.pdf", True, None), ("/x/i.png", True, None), ("/x/bad.pdf", False, None), ("/x/e.jpg", None, "broken")],
        "path string, is_valid boolean, error string",
    )
    added, report, rejected = files.intake(incoming, existing, info, first_uid=10)
    assert [(r["path"], r["uid"]) for r in added.orderBy("seq").collect()] == [
        ("/x/a.pdf", "f10"), ("/x/a.pdf", "f11"), ("/x/i.png", "f12"), ("/x/i.png", "f13"), ("/x/d.docx", "f14"),
    ]
    assert report.first().asDict() == {"added": 5, "invalid": 1, "errors": 1, "already_loaded": 1, "not_pdf": True}
    assert {(r["name"], r["outcome"], r["message"]) for r in rejected.collect()} == {
        ("b.pdf", "already_loaded", None), ("z.zip", "unsupported", None), ("bad.pdf", "invalid", None), ("e.jpg", "error", "e.jpg: broken"),
    }
    assert sorted(r["path"] for r in files.conversions(incoming).collect()) == ["/x/e.jpg", "/x/i.png"]


def named(stems):
    """Names in input order; repeats avoid every literal name."""
    literal, count, used = set(stems), {}, {}
    out = []
    for s in stems:
        count[s] = count.get(s, 0) + 1
        if count[s] == 1:
            out.append(s)
            continue
        k = used.get(s, 1) + 1
        while f"{s} ({k})" in literal:
            k += 1
        used[s] = k
        out.append(f"{s} ({k})")
    return out


@pytest.mark.parametrize("bits", [1, 16])
@pytest.mark.parametrize(
    "stems",
    [
        ["r", "r", "r"],
        ["r", "r (2)", "r", "r (4)", "r", "r"],
        ["r (2)", "r (2)", "r", "r", "r (3)", "r (2)", "r"],
        ["r", "r (5)", "r", "r (1)", "r (02)", "r"],
        ["r"] * 6 + ["r (2)", "r (3)", "r (5)", "r (9)"],
        ["a (2)", "b"],
    ],
)
def test_name_outputs(spark, stems, bits):
    df = spark.createDataFrame([(i, "/o", s) for i, s in enumerate(stems)], "seq int, dir string, stem string")
    got = [r["output_path"] for r in files.name_outputs(df, bits=bits).orderBy("seq").collect()]
    assert got == [f"/o/{n}.pdf" for n in named(stems)]
    assert len(set(got)) == len(got)


def test_names_avoid_existing_files(spark):
    df = spark.createDataFrame([(i, "/o", "r") for i in range(3)], "seq int, dir string, stem string")
    there = spark.createDataFrame([("/o", "r (2)"), ("/p", "r (3)")], "dir string, stem string")
    got = [r["output_path"] for r in files.name_outputs(df, existing=there).orderBy("seq").collect()]
    assert got == ["/o/r.pdf", "/o/r (3).pdf", "/o/r (4).pdf"]
    assert spark.range(1).select(files.page_image_name(F.lit(7))).first()[0] == "page-007"


PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR"


def png(w, h):
    return PNG + w.to_bytes(4, "big") + h.to_bytes(4, "big")


def jpeg(w, h, lead=b"", marker=0xC0, tail=b"\xff\xd9"):
    frame = b"\xff" + bytes([marker]) + b"\0\x09\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x03\x11"
    return b"\xff\xd8" + lead + frame + tail


IMAGES = {
    "p.png": (png(80, 60), 80, 60, None),
    "wide.png": (png(5000, 10), 5000, 10, "IMAGE_TOO_LARGE"),
    "zero.png": (png(0, 10), None, None, "IMAGE_BAD"),
    "cut.png": (png(9, 9)[:20], None, None, "IMAGE_BAD"),
    "fake.png": (b"\x89PNG" + b"0" * 40, None, None, "IMAGE_BAD"),
    "j.jpg": (jpeg(640, 480), 640, 480, None),
    "segments.jpg": (jpeg(20, 30, b"\xff\xe0\0\x06abcd\xff\x01\xff\xd0junk\xff\xff\xfe\0\x03!", 0xCF), 20, 30, None),
    "tall.jpg": (jpeg(1, 4097), 1, 4097, "IMAGE_TOO_LARGE"),
    "ends.jpg": (b"\xff\xd8\xff\xd9" + jpeg(9, 9)[2:], None, None, "IMAGE_BAD"),
    "table.jpg": (jpeg(9, 9, marker=0xC4), None, None, "IMAGE_BAD"),
    "flat.jpg": (jpeg(9, 0), None, None, "IMAGE_BAD"),
    "g.gif": (b"GIF89a", None, None, "IMAGE_TYPE"),
}


def test_image_gate(spark, tmp_path):
    for name, (data, *_) in IMAGES.items():
        (tmp_path / name).write_bytes(data)
    with open(tmp_path / "huge.png", "wb") as out:
        out.write(png(10, 10))
        out.truncate(images.MAX_BYTES + 1)
    read = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["width"], r["height"], r["reason"]) for r in images.image_gate(read).collect()}
    want = {name: tuple(rest) for name, (_, *rest) in IMAGES.items()}
    assert got == {**want, "huge.png": (None, None, "IMAGE_TOO_LARGE")}


def test_oversized_images_are_not_opened(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(1, 1))
    plan = images.image_gate(spark.read.format("binaryFile").load(str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    first, *others = plan.split("FileScan")[1:]
    assert "content" not in first.split("Batched")[0]
    assert others and all(re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(length", s) for s in others)


def test_heif_profile(spark):
    df = spark.createDataFrame(
        [("a", 1, 100, 100, 1), ("b", 64 * 2**20 + 1, 1, 1, 1), ("c", 1, 8193, 1, 1), ("d", 1, 8000, 8000, 1), ("e", 1, 1, 1, 2**28), ("f", 1, 0, 5, 1)],
        "path string, length long, width int, height int, decoded_bytes long",
    )
    assert {r["path"] for r in images.image_gate(df, "heif").collect() if r["reason"]} == set("bcdef")


def test_image_budget(spark):
    facts = spark.createDataFrame(
        [("x", 30, 1, 1, None), ("y", 20, 1, 1, None), ("z", 1, 9, 9, "IMAGE_BAD"), ("w", 1, 100, 100, None)],
        "image string, bytes long, width int, height int, reason string",
    )
    placed = spark.createDataFrame(
        [(1, 1, "x"), (1, 2, "x"), (1, 3, "x"), (2, 5, "x"), (2, 7, "y"), (2, 9, "z"), (3, 1, "z"), (3, 2, "x"), (3, 3, "y"), (4, 1, "no"), (5, 1, "w")],
        "doc_id int, seq int, image string",
    )
    got = {r["doc_id"]: tuple(r)[1:] for r in images.image_budget(placed, facts, 49, 9_000).collect()}
    assert got == {
        1: (30, 1, None, None), 2: (51, 83, "IMAGE_TOO_LARGE", 7), 3: (51, 83, "IMAGE_BAD", 1), 4: (0, 0, "IMAGE_MISSING", 1),
        5: (1, 10_000, "IMAGE_TOO_LARGE", 1),
    }


def test_write_docs_never_overwrites(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    out = str(tmp_path / "out")
    sinks.write_docs(df, out)
    with pytest.raises(AnalysisException):
        sinks.write_docs(df, out)
    for bad in (out, out + "/", f"{out}/below", f"file://{out}/x", str(tmp_path)):
        with pytest.raises(ValueError, match="OUTPUT_IS_INPUT"):
            sinks.write_docs(df, bad, inputs=[out])
    assert spark.read.parquet(out).collect() == df.collect()
    sinks.write_docs(df, out + "2", inputs=[out])


def test_write_text(spark, tmp_path):
    rows = [("a/b c.%é", 0, "a\fb\r\n"), ("a/b c.%é", 1, "ç\u2028"), ("", 0, "x"), (".", 3, ""), (None, 0, "nobody's"), ("k", 0, "y" * 300_000)]
    parts = spark.createDataFrame([*rows, ("null", 0, None)], "doc_id string, part int, text string")
    out = str(tmp_path / "t")
    sinks.write_text(parts.repartition(3), out)
    back = sinks.read_text(spark, out)
    assert {tuple(r) for r in back.collect()} == {*rows, ("null", 0, "")}
    done = json.loads((tmp_path / "t" / "_SUCCESS").read_text())
    assert done == {"files": 7, "bytes": sum(len((t or "").encode()) for *_, t in rows)}
    found = [p for p in (tmp_path / "t").rglob("*.txt")]
    assert len(found) == 7 and all(len(p.parent.name) == 2 for p in found)
    with pytest.raises(ValueError, match="OUTPUT_EXISTS"):
        sinks.write_text(parts, out)
    with pytest.raises(ValueError, match="OUTPUT_IS_INPUT"):
        sinks.write_text(parts, out + "/x", inputs=[out])


def test_what_a_lost_task_left_is_no_text(spark, tmp_path):
    sinks.write_text(spark.createDataFrame([("a", 0, "x")], "doc_id string, part int, text string"), str(tmp_path / "t"))
    folder = next((tmp_path / "t").rglob("*.txt")).parent
    (folder / ".0123abcd").write_text("half a te")
    assert [tuple(r) for r in sinks.read_text(spark, str(tmp_path / "t")).collect()] == [("a", 0, "x")]
    empty = spark.createDataFrame([], "doc_id string, part int, text string")
    sinks.write_text(empty, str(tmp_path / "e"))
    assert sinks.read_text(spark, str(tmp_path / "e")).count() == 0


def test_write_text_packed(spark, tmp_path):
    rows = [(1, 0, "a\fb\r\n\n"), (1, 1, "ç\u2028"), (2, 0, ""), (None, 0, "x")]
    parts = spark.createDataFrame(rows, "doc_id int, part int, text string")
    sinks.write_text(parts, str(tmp_path / "t"), packed=True)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert {tuple(r) for r in back.collect()} == set(rows)
    assert sorted(tuple(r)[1:] for r in back.filter("doc_id = 1").collect()) == [r[1:] for r in rows[:2]]


@pytest.mark.parametrize("packed", [False, True])
def test_write_text_of_all_documents(spark, tmp_path, packed):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.lit(0).alias("part"), "text")
    sinks.write_text(docs, str(tmp_path / "t"), packed=packed)
    if packed:
        back = spark.read.parquet(str(tmp_path / "t")).select("doc_id", "text")
    else:
        back = sinks.read_text(spark, str(tmp_path / "t")).select(F.col("key").cast("bigint"), "text")
    whole = {tuple(r) for r in docs.select("doc_id", "text").collect()}
    assert {tuple(r) for r in back.collect()} == whole and any(k % 2 for k, _ in whole)


def test_text_of_every_document_comes_back(spark):
    registry.load()
    assert registry.QUERIES["write_text_packed"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_outline(spark):
    nodes = spark.createDataFrame(
        [
            (1, "b", None, 2, "B", "p2"), (1, "a", None, 1, " A ", "p1"), (1, "a2", "a", 10, "A2", None), (1, "a1", "a", 9, " ", "p1"),
            (1, "a1x", "a1", 1, "deep", "gone"), (2, "q", None, 1, None, None),
        ],
        "doc_id int, node string, parent string, sibling_no int, title string, target string",
    )
    pages = spark.createDataFrame([(1, "p1", 1), (1, "p2", 7)], "doc_id int, target string, page int")
    got = [tuple(r)[1:] for r in outline(nodes, pages).orderBy("doc_id", "item_no").collect()]
    assert got == [(1, "A", 1, 0), (2, "deep", None, 2), (3, "A2", None, 1), (4, "B", 7, 0)]
    assert [r["title"] for r in outline(nodes, pages, limit=2).orderBy("item_no").collect()] == ["A", "deep"]


def test_deep_outlines_and_cycles(spark):
    deep = [(1, str(k), str(k - 1) if k else None, 0, f"t{k}", None) for k in range(130)]
    nodes = spark.createDataFrame(
        [*deep, (2, "x", "y", 0, "X", None), (2, "y", "x", 0, "Y", None)],
        "doc_id int, node string, parent string, sibling_no int, title string, target string",
    )
    pages = spark.createDataFrame([], "doc_id int, target string, page int")
    got = [(r["doc_id"], r["item_no"], r["level"]) for r in outline(nodes, pages).orderBy("item_no").collect()]
    assert got == [(1, k + 1, k) for k in range(130)]


def test_outline_against_a_walk(spark):
    """One document with most items, many children of one node, equal sibling numbers, nodes below nothing."""
    rng, rows, children = random.Random(9), [], {}
    for doc, size in ((1, 600), (2, 40), (3, 1)):
        for i in range(size):
            parent = None if i == 0 or rng.random() < 0.05 else 0 if rng.random() < 0.3 else rng.randrange(max(0, i - 3), i)
            row = (doc, i, parent, rng.randrange(4), rng.choice(["t", " ", f"n{i}"]), None)
            rows.append(row)
            children.setdefault((doc, parent), []).append(row)
    rows += [(1, 9001, 9000, 0, "lost", None), (1, 9002, 9001, 0, "lost", None), (1, 9003, 9003, 0, "loop", None)]
    want = []

    def walk(doc, parent, level):
        for row in sorted(children.get((doc, parent), []), key=lambda r: (r[3], r[1])):
            if row[4].strip():
                want.append((doc, sum(w[0] == doc for w in want) + 1, row[4], level))
            walk(doc, row[1], level + 1)

    for doc in (1, 2, 3):
        walk(doc, None, 0)
    nodes = spark.createDataFrame(rows, "doc_id int, node int, parent int, sibling_no int, title string, target string").repartition(4)
    pages = spark.createDataFrame([], "doc_id int, target string, page int")
    got = outline(nodes, pages).select("doc_id", "item_no", "title", "level").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert "Window" not in outline(nodes, pages)._jdf.queryExecution().executedPlan().toString()


def test_metadata_edits_in_order(spark):
    docs = spark.createDataFrame([(1, {"Title": "t", "X": "x"}), (2, {"X": "x"})], "doc_id int, info map<string,string>")
    edits = spark.createDataFrame(
        [(1, 2, False, "second", None), (1, 1, True, None, None), (2, 2, False, None, "b"), (2, 1, False, "a", None)],
        "doc_id int, seq int, clear_all boolean, title string, author string",
    )
    for name in ("subject", "keywords", "creator", "producer"):
        edits = edits.withColumn(name, F.lit(None).cast("string"))
    got = {r["doc_id"]: r["info"] for r in meta_edit(docs, edits).collect()}
    assert got == {1: {"Title": "second"}, 2: {"X": "x", "Author": "b"}}


def test_edits_of_a_document_are_not_gathered(spark):
    pick = random.Random(3)
    fields = ["title", "author", "subject", "keywords", "creator", "producer"]
    docs = [(d, {"Title": "t", "X": "x", "Author": "a"} if d % 3 else None) for d in range(12)]
    edits = [
        (d, seq, pick.choice([True, False, False, False, None]), *[pick.choice([None, " ", f"{seq}"]) for _ in fields])
        for d in range(1, 12) for seq in pick.sample(range(99), pick.randrange(1, 6))
    ]
    made = spark.createDataFrame(edits, "doc_id int, seq int, clear_all boolean, " + ", ".join(f"{f} string" for f in fields))
    found = meta_edit(spark.createDataFrame(docs, "doc_id int, info map<string,string>"), made)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    for d, info in docs:
        own = sorted(e for e in edits if e[0] == d)
        for _, _, clear, *values in own:
            kept = {k: v for k, v in (info or {}).items() if k.lower() not in fields}
            info = {} if clear else kept | {f.title(): v for f, v in zip(fields, values) if v and v.strip()}
        assert [r["info"] for r in found.filter(F.col("doc_id") == d).collect()] == [info]


@pytest.mark.parametrize("name, area", [("scan_files_listed", flows), ("stream_intake", streams)])
def test_files_of_one_source_come_from_many_tasks(spark, tmp_path, monkeypatch, name, area):
    registry.load()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "sf/documents.parquet"))
    monkeypatch.setattr(area, "shared_folder", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(area, "table", lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        rows = registry.QUERIES[name](spark, str(tmp_path / "sf")).collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    size = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(2 * F.octet_length("text") + 1).alias("n")).collect()}
    assert {r["folder"]: r["size"] for r in rows} == size and len(rows) == len(size)
    assert len(list(tmp_path.glob("*/**/source=*/part-*"))) > 2 * len(size)


def test_metadata(spark):
    docs = spark.createDataFrame(
        [(1, {"Title": bytearray(b"\xfe\xff\x01\x5e"), "Author": bytearray(b"  "), "X": bytearray(b"x")}), (2, {"Title": bytearray(b"t")}), (3, None)],
        "doc_id int, info map<string,binary>",
    )
    read = {r["doc_id"]: r["m"] for r in docs.select("doc_id", meta_read("info").alias("m")).collect()}
    assert read[1]["title"] == "Ş" and read[1]["author"] is None and read[2]["title"] == "t"
    edits = spark.createDataFrame(
        [(1, False, " New ", "é", None, "", None, None), (2, True, "ignored", None, None, None, None, None)],
        "doc_id int, clear_all boolean, title string, author string, subject string, keywords string, creator string, producer string",
    )
    got = {r["doc_id"]: r["info"] for r in meta_edit(docs, edits).collect()}
    assert {k: bytes(v) for k, v in got[1].items()} == {"Title": b"New", "Author": b"\xfe\xff\0\xe9", "X": b"x"}
    assert got[2] == {} and got[3] is None
