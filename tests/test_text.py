"""Page text operators against plain Python."""

import pytest

from quire.operators.search import search, search_snippets
from quire.operators.text import cap_text, effective_text, export_text, has_text, split_pages


def test_split_drops_only_a_blank_last_page(spark):
    df = spark.createDataFrame(
        [(1, "a\f\fb\f"), (2, "a\f \n"), (3, "one"), (4, ""), (5, "\f\f")], "doc_id int, text string"
    )
    got = {}
    for r in split_pages(df).orderBy("doc_id", "page").collect():
        got.setdefault(r["doc_id"], []).append((r["page"], r["text"]))
    assert got == {
        1: [(1, "a"), (2, ""), (3, "b")],
        2: [(1, "a")],
        3: [(1, "one")],
        5: [(1, ""), (2, "")],
    }


def capped(texts, cap):
    """Read the joined pages up to ``cap`` bytes, as one stream."""
    stream = "\f".join(texts).encode()
    pages = stream[:cap].decode("utf-8", "replace").split("\f")
    if len(stream) > cap and not pages[-1].strip():
        pages.pop()
    return pages


@pytest.mark.parametrize("cap", [1, 2, 3, 5, 6, 7, 8, 11, 12, 13, 40, 1000])
@pytest.mark.parametrize("bits", [0, 1, 16])
def test_cap_text(spark, cap, bits):
    docs = {
        1: ["abc", "", "déf", "  ", "x"],
        2: ["é" * 5, "z"],
        3: ["   ", "abc"],
        4: ["tiny"],
    }
    rows = [(d, i + 1, t) for d, ts in docs.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string")
    got = {}
    for r in cap_text(df, cap, bits=bits).orderBy("doc_id", "page").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {d: capped(ts, cap) for d, ts in docs.items() if capped(ts, cap)}


def test_export_text_in_parts(spark):
    pages = spark.createDataFrame(
        [(d, p, f"{d}.{p}") for d in (1, 2, 3) for p in range(1, 8)], "doc_id int, page int, text string"
    )
    ranges = spark.createDataFrame([(1, 0, 3), (2, 5, None), (3, 4, 2)], "doc_id int, first int, last int")
    text, errors = export_text(pages, ranges, part_bytes=8)
    parts = {}
    for r in text.orderBy("doc_id", "part").collect():
        parts.setdefault(r["doc_id"], []).append(r["text"])
    assert parts == {1: ["1.1\f1.2", "1.3"], 2: ["2.5\f2.6", "2.7"]}
    assert [tuple(r) for r in errors.collect()] == [(3, "INVALID_RANGE")]


def test_effective_and_has_text(spark):
    pages = spark.createDataFrame(
        [(1, 1, "a"), (1, 2, ""), (2, 1, ""), (2, 2, " \n"), (3, 1, None)], "doc_id int, page int, text string"
    )
    ocr = spark.createDataFrame([(1, 1, "no"), (1, 2, "read"), (3, 1, "r")], "doc_id int, page int, text string")
    got = {(r["doc_id"], r["page"]): r["text"] for r in effective_text(pages, ocr).collect()}
    assert got == {(1, 1): "a", (1, 2): "read", (2, 1): "", (2, 2): " \n", (3, 1): "r"}
    flags = {r["doc_id"]: r["has_text"] for r in has_text(pages).collect()}
    assert flags == {1: True, 2: False, 3: False}


@pytest.fixture(scope="module")
def book(spark):
    long = "x" * 50 + " Needle\t\n " + "y" * 80
    return spark.createDataFrame(
        [(1, 1, "needle at once"), (1, 2, "nothing"), (1, 3, long), (2, 1, "NEEDLE needle")],
        "doc_id int, page int, text string",
    )


def test_search(book):
    got = sorted((r["doc_id"], r["page"], r["query"]) for r in search(book, [" Needle ", "n", "zz", " "], min_chars=2).collect())
    assert got == [(1, 1, "Needle"), (1, 3, "Needle"), (2, 1, "Needle")]
    assert search(book, ["n"]).count() == 4 and search(book, ["n"], min_chars=2).count() == 0


def test_snippets(book):
    hits = {(r["doc_id"], r["page"]): r for r in search_snippets(book, ["needle"]).collect()}
    first = hits[1, 1]
    assert (first["before"], first["match"], first["after"]) == ("", "needle", " at once…")
    cut = hits[1, 3]
    assert (cut["before"], cut["match"]) == ("…" + "x" * 39 + " ", "Needle")
    assert cut["after"] == " " + "y" * 57 + "…"
    assert hits[2, 1]["match"] == "NEEDLE"
    exact = search_snippets(book, ["needle"], case_sensitive=True).collect()
    assert sorted((r["doc_id"], r["page"]) for r in exact) == [(1, 1), (2, 1)]
    assert sorted((r["doc_id"], r["page"], r["hit_no"]) for r in search_snippets(book, ["needle"]).collect()) == [(1, 1, 1), (1, 3, 2), (2, 1, 1)]
    assert sorted((r["doc_id"], r["page"]) for r in search_snippets(book, ["needle"], limit=1).collect()) == [(1, 1), (2, 1)]


def test_snippet_of_a_needle_with_special_characters(spark):
    df = spark.createDataFrame([(1, 1, "50% (a.b) done")], "doc_id int, page int, text string")
    assert search_snippets(df, ["% (a.b)"]).first()["match"] == "% (a.b)"
