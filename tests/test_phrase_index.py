"""Search by anchors against looking for every phrase on every page."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import phrase_index as P
from quire.operators.search import search_snippets


def looked_for(pages, phrases, case=False, least=1):
    out = set()
    for page, text in pages:
        for number, phrase in phrases:
            p = (phrase or "").strip(" ")
            if len(p) < max(1, least) or text is None:
                continue
            at = (text if case else text.lower()).find(p if case else p.lower())
            if at >= 0:
                out.add((page, number, at + 1))
    return out


def cases():
    rng = random.Random(3)
    pieces = ["land register ", "the ", "Öl", "ab", "x", "é", "a long passage of the old book, ", "THE LAND", "\n", "aaaaaaaaaaaa"]
    pages = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))) for k in range(150)]
    pages += [(900, None), (901, ""), (902, "y" * 50_000 + " the land register " + "é" * 30_000 + "needle at the end")]
    phrases = [(k, t) for k, t in enumerate([
        "land register", " The ", "öl", "x", "é", "aaaaaaaaaaaaa", "passage of the old book, the land", "needle at the end", "nowhere to be found", "",
        None, "   ", "éx", "abababab", "abababa", "ababababa", "ster the land reg", "the land\n", "öl", "e l"])]
    for k in range(60):
        text = rng.choice(pages[:150])[1]
        a = rng.randrange(len(text) + 1)
        phrases.append((100 + k, text[a: a + rng.randrange(1, 120)]))
    return pages, phrases


@pytest.mark.parametrize("case, least, block", [(False, 1, 1 << 20), (True, 3, 64), (False, 9, 1 << 20)])
def test_against_every_phrase(spark, monkeypatch, case, least, block):
    monkeypatch.setattr(P, "BLOCK", block)
    pages, phrases = cases()
    left = spark.createDataFrame(pages, "page int, text string").repartition(3)
    right = spark.createDataFrame(phrases, "number int, phrase string")
    got = P.search_table(left, right, ["page"], case_sensitive=case, min_chars=least)
    assert {(r["page"], r["number"], r["at"]) for r in got.collect()} == looked_for(pages, phrases, case, least)
    assert got.count() == len(looked_for(pages, phrases, case, least))


def test_snippets_are_those_of_the_plain_search(spark):
    pages, phrases = cases()
    left = spark.createDataFrame([(k, 1, t) for k, t in pages], "doc_id int, page int, text string")
    texts = sorted({p.strip(" ") for _, p in phrases if p and p.strip(" ") == p.strip()} - {""})
    plain = search_snippets(left, texts).select("doc_id", "query", "before", "match", "after").collect()
    ours = P.search_table(left, spark.createDataFrame([(t,) for t in texts], "query string"), phrase="query")
    assert sorted(map(tuple, plain)) == sorted(tuple(r) for r in ours.select("doc_id", "query", "before", "match", "after").collect())


def test_no_phrase_is_in_the_plan_and_no_text_moves(spark):
    pages = spark.createDataFrame(cases()[0], "page int, text string").withColumn("doc_id", F.lit(1))
    phrases = spark.createDataFrame([("needle at the end",)], "phrase string")
    plan = P.search_table(pages, phrases)._jdf.queryExecution().executedPlan().toString()
    assert "needle" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    for exchange, below in zip(plan.split("\n"), plan.split("\n")[1:]):
        if "Exchange" in exchange:
            assert not re.search(r"\[.*\b(text|__text)#", below), below


def test_empty_tables_and_no_usable_phrase(spark):
    pages = spark.createDataFrame([(1, "some text")], "page int, text string")
    phrases = spark.createDataFrame([("text",)], "phrase string")
    assert P.search_table(pages.limit(0), phrases, ["page"]).count() == 0
    assert P.search_table(pages, phrases.limit(0), ["page"]).count() == 0
    assert P.search_table(pages, phrases, ["page"], min_chars=9).count() == 0
