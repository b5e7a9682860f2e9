import re
from itertools import combinations

import numpy as np
import pytest

from quire.llm import op09_licenses as L

INDEX = L.Index()


def full_alignment(template, text):
    """Best local alignment without a band: (matched, first, last)."""
    empty = (0, 0, -1, -1)
    best, row = empty, [empty] * (len(text) + 1)
    for a in template:
        now = [empty]
        for j, b in enumerate(text):
            s, m, f, e = row[j]
            cell = (s + L.MATCH, m + 1, j if f < 0 else f, j) if a == b else (s + L.OTHER, m, f, e)
            if row[j + 1][0] + L.OTHER > cell[0]:
                cell = (row[j + 1][0] + L.OTHER, *row[j + 1][1:])
            if now[j][0] + L.OTHER > cell[0]:
                cell = (now[j][0] + L.OTHER, *now[j][1:])
            now.append(cell if cell[0] > 0 else empty)
            best = max(best, now[-1], key=lambda c: c[0])
        row = now
    return best[1:]


def brute(hashes):
    """Best template of a text by full alignment with every one."""
    found = []
    for t, own in enumerate(INDEX.words):
        matched, first, last = full_alignment(own, hashes)
        if matched / len(own) >= L.COVERAGE:
            found.append((-matched, t, first, last))
    return [(INDEX.names[t], -m, f, e) for m, t, f, e in sorted(found)[:1]]


@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_every_template_is_found_whole(name):
    words, hashes = L.cut(["before it " + L.TEMPLATES[name] + " after it"])
    top = max(L.scan(INDEX, hashes), key=lambda m: m.matched)
    assert (top.coverage, top.first, top.last) == (1.0, 2, len(hashes) - 3)
    assert top.name == name


def test_against_full_alignment():
    pick = np.random.default_rng(4)
    texts = []
    for name in ("bsd", "isc"):
        words = L.TEMPLATES[name].split()
        for _ in range(2):
            edited = [w for w in words if pick.random() > 0.04]
            for at in pick.integers(0, len(edited), 3):
                edited[at] = "other"
            texts.append(" ".join(["some", "words"] * 10 + edited + ["and", "more"] * 5))
    words, hashes = L.cut(texts)
    for a, b in zip(words.first, words.first[1:]):
        found = max(L.scan(INDEX, hashes[a:b]), key=lambda m: m.matched)
        assert [(found.name, found.matched, found.first, found.last)] == brute(hashes[a:b])


def test_whole_table_against_full_alignment_of_lines(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in L.op9_licenses(spark, "/root/testdata/sf0.001").collect()}
    notices = [n for n, t in L.TEMPLATES.items() if len(t.split()) < 14]
    some = 0
    for d in documents:
        named = {m["name"] for m in rows[d["doc_id"]]["licenses"]}
        for n in notices:
            if L.TEMPLATES[n] in d["text"]:
                some += 1
                assert n in named
        for m in rows[d["doc_id"]]["licenses"]:
            quoted = d["text"][m["start"]: m["end"]]
            assert m["coverage"] < 1 or " ".join(quoted.lower().split()) in " ".join(L.TEMPLATES[m["name"]].lower().split())
    assert some and len(rows) == len(documents)


def names(text):
    _, hashes = L.cut([text])
    return [m.name for m in L.scan(INDEX, hashes)]


@pytest.mark.parametrize("name", [n for n, t in L.TEMPLATES.items() if len(t.split()) < 12])
def test_short_notices_with_changed_words(name):
    """Every way to change as many words as the coverage allows, against full alignment."""
    words = L.cut([L.TEMPLATES[name]])[0].text().size
    plain = re.findall("[A-Za-z0-9]+", L.TEMPLATES[name])
    assert len(plain) == words
    for n in range(int(0.3 * words + 1e-9) + 1):
        for at in combinations(range(words), n):
            text = " ".join(["see", "below"] + [f"zq{k}" if k in at else w for k, w in enumerate(plain)] + ["and", "more"])
            _, hashes = L.cut([text])
            whole = brute(hashes)
            # a change at an end is left out of the span, so it may leave two templates equal
            assert not whole or whole[0][1:] in {(m.matched, m.first, m.last) for m in L.scan(INDEX, hashes)}, text


def test_whole_licenses_and_their_parts_are_told_apart():
    own = {n: L.TEMPLATES[n] for n in L.TEMPLATES}
    assert names("Copyright 2020 A. Holder " + own["bsd-2-clause"]) == ["bsd-2-clause"]
    assert names("Copyright 2020 A. Holder " + own["bsd-3-clause"]) == ["bsd-3-clause"]
    assert names(own["bsd-disclaimer"]) == ["bsd-disclaimer"] and names(own["mit-warranty"]) == ["mit-warranty"]
    assert names("x " + own["mit-full"] + " y") == ["mit-full"]
    for n in ("apache-2.0-full", "gpl-2.0-full", "gpl-3.0-full", "lgpl-2.1-full", "lgpl-3.0-full", "mpl-2.0-full"):
        body = own[n].split()
        assert n in names(" ".join(body[len(body) // 20: -len(body) // 10]))


def test_edges(docs, rows_of):
    texts = [None, "", "\n ", "été All RIGHTS\nreserved!", "all rights", "All rights reserved. " * 3, "x" * 50_000 + " Released under the MIT License."]
    found = rows_of(L.licenses(docs(texts).withColumnRenamed("source", "license")))
    assert [found[k]["n_licenses"] for k in range(len(texts))] == [0, 0, 0, 1, 0, 3, 1]
    span = found[3]["licenses"][0]
    assert texts[3][span["start"]: span["end"]] == "All RIGHTS\nreserved"
    same = L.licenses(docs([(None, texts[3]), (2, texts[3]), (2, texts[3])])).collect()
    assert len({str(r["licenses"]) for r in same}) == 1
    assert L.licenses(docs([])).count() == 0
