import hashlib
import random
import re
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import op10_personal as P

PLAIN = {
    0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    2: re.compile(r"[0-9]([\x20-]?[0-9])+"),
    3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain(text):
    """The patterns as they are written in their definition."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = kind == 0 or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
            ok = ok or (kind == 2 and 16 <= len(digits) <= 19 and P.luhn(digits)) or (kind == 3 and 8 <= len(digits) <= 15)
            out += [(kind, *m.span())] * ok
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- (-é%2_5", max_size=40))
def test_spans_of_the_patterns(text):
    assert P.base_spans(text) == plain(text)


def test_luhn():
    assert P.luhn("4918187128635271") and not P.luhn("4918187128635272")


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "1." * 150_000, "+1" * 150_000):
        P.base_spans(text)


def test_marginals_of_a_tree_are_exact():
    pick = np.random.default_rng(1)
    n, size = 4, len(P.LABELS)
    features = np.stack([pick.integers(0, s, n) for s in P.SIZES], 1)
    crf = P.Crf(pick.normal(size=(sum(P.SIZES) + P.JOINT + 1, size)), pick.normal(size=(size, size)), pick.normal(size=(size, size)))
    chain, skip = np.array([[0, 1], [1, 2]]), np.array([[1, 3]])
    node = P.one_hot(features) @ crf.weights
    exact = np.zeros((n, size))
    for y in product(range(size), repeat=n):
        s = sum(node[k, y[k]] for k in range(n)) + sum(crf.chain[y[i], y[j]] for i, j in chain) + sum(crf.skip[y[i], y[j]] for i, j in skip)
        for k in range(n):
            exact[k, y[k]] += np.exp(s)
    exact /= exact.sum(1, keepdims=True)
    assert np.allclose(crf.marginals(features, chain, skip, rounds=60), exact, atol=1e-6)


def test_whole_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in P.op10_personal(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(documents)
    for d in documents:
        base, row = plain(d["text"]), rows[d["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(P.joined(base).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in P.KINDS] == [sum(s[0] == i for s in base) for i in range(4)]
        assert set(filter(None, P.joined(base).split(","))) <= set(row["spans"].split(","))


CARDS = ["4918187128635271", "4315726095712222", "4337166598464399", "4279055890764913"]


@pytest.fixture
def people(docs):
    pick = random.Random(2)
    rows = []
    for k in range(300):
        phone = f"+1 ({pick.randrange(200, 999)}) 555-{pick.randrange(1000, 9999)}"
        rows.append(f"call me on {phone} or write to user.{k}@mail{k % 9}.example.com, paid with {CARDS[k % 4]} from {k % 200}.7.9.{k % 250} in 20{k % 25:02d}")
    return docs(rows)


def test_the_field_adds_what_runs_together(people, docs, rows_of):
    crf = P.train(people)
    text = "we saw +1 (578) 555-6437 4918187128635271 there"
    found = rows_of(P.personal(docs([text, "in 2012 there were 40 of 300 left"]), crf))
    assert found[0]["base_spans"] == "" and found[0]["all_spans"] == "card:25:41,phone:7:24"
    assert P.masked(text, found[0]["all_spans"]) == "we saw <phone> <card> there"
    assert found[1]["all_spans"] == ""


def test_values_side_by_side_are_told_apart(people, docs, rows_of):
    crf = P.train(people)
    cards = " ".join(CARDS[:3])
    found = rows_of(P.personal(docs([f"paid with {CARDS[0]} {CARDS[1]}", f"paid with {cards} and left"]), crf))
    assert [r["base_spans"] for r in found.values()] == ["", ""]
    assert found[0]["all_spans"] == "card:10:26,card:27:43" and found[1]["all_spans"] == "card:10:26,card:27:43,card:44:60"


@pytest.mark.parametrize("kind, run, values", [
    (2, "4918187128635271 4315726095712222", ["4918187128635271", "4315726095712222"]),
    (2, "4918 1871 2863 5271 4315 7260 9571 2222", ["4918 1871 2863 5271", "4315 7260 9571 2222"]),
    (2, "300 4918187128635271", ["4918187128635271"]),
    (2, "4918187128635271 7 12 4315726095712222 9", ["4918187128635271", "4315726095712222"]),
    (3, "(578) 555-6437 (415) 555-0100", ["(578) 555-6437", "(415) 555-0100"]),
    (3, "+1 (578) 555-6437 +49 (30) 1234-5678 +1 (415) 555-0100", ["+1 (578) 555-6437", "+49 (30) 1234-5678", "+1 (415) 555-0100"]),
    (3, "12 (578) 555-6437", ["(578) 555-6437"]),
])
def test_parts_of_a_run_of_one_label(kind, run, values):
    text = f"we saw {run} there"
    found = P.field(text)
    spans = P.added(text, found, np.full(len(found.spans), kind + 1), [])
    assert [text[a:b] for _, a, b in spans] == values and {k for k, _, _ in spans} == {kind}
    assert P.added(text, found, np.full(len(found.spans), kind + 1), [(kind, *spans[0][1:])]) == spans[1:]


@pytest.mark.parametrize("again", ["14155550100", "415-555-0100", "(415) 555-0100", "415 555 0100", "4155550100"])
def test_a_phone_is_found_again_however_it_is_written(people, docs, rows_of, again):
    text = f"call +14155550100 {'and then some ' * 50}ring {again} or go in 2012 with 4155550 of 300"
    found = rows_of(P.personal(docs([text, f"ring {again} now"]), P.train(people)))
    a = text.index(again, 20)
    assert found[0]["all_spans"] == f"phone:5:17,phone:{a}:{a + len(again)}"
    assert found[1]["all_spans"] in ("", f"phone:5:{5 + len(again)}")


def test_a_phone_is_whole_where_the_field_says_so():
    text = "ring 415-555-0100 or 2012"
    found = P.field(text)
    assert P.added(text, found, np.array([4, 4]), []) == [(3, 5, 17)]


def test_all_places_of_a_content_share_a_hub():
    found = P.field("x 415 555 0100 y (415) 555-0100 z 4155550100 v 12 w 12 12")
    chain, same = P.edges(found)
    assert sorted(map(sorted, same)) == [[0, 1, 2, 3, 4, 5], [6, 7, 8]]


def test_evidence_reaches_any_distance():
    """A chain of words that agree, the first one certain; and a content of many places."""
    size, n = len(P.LABELS), 60
    weights = np.zeros((sum(P.SIZES) + P.JOINT + 1, size))
    weights[1, 4] = 40.0  # the first category's second value
    features = np.zeros((n, len(P.SIZES)), np.int64)
    features[0, 0] = 1
    agree = 12 * np.eye(size)
    crf = P.Crf(weights, agree, agree)
    none = np.zeros((0, 2), np.int64)
    far = crf.marginals(features, np.array([(k, k + 1) for k in range(n - 1)]), none)
    hub = crf.marginals(features, none, np.array([(k, n) for k in range(n)]), hubs=1)
    assert far[-1, 4] > 0.9 and hub[-1, 4] > 0.9


def test_edges(docs, rows_of):
    table = docs([None, "", " \n", "no data"])
    found = rows_of(P.personal(table.withColumnRenamed("source", "n_ip")))
    assert all((r["n_email"], r["n_ip"], r["base_spans"], r["all_spans"]) == (0, 0, "", "") for r in found.values()) and len(found) == 4
    assert P.personal(docs([])).count() == 0
    same = P.personal(docs([(1, "x@y.zz"), (1, "x@y.zz"), (None, "é x@y.zz")])).collect()
    assert [r["all_spans"] for r in same] == ["email:0:6", "email:0:6", "email:2:8"]
