import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import op11_variants as V
from quire.llm import words as W


def counted(rows, slip=97):
    out = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{low}".encode())
            if slip and h % slip == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1:]
            out[low] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words):
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words.get(form.get(w)))
    return out


def found(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("symbols", [1, 8])
def test_against_all_pairs(docs, symbols):
    rng = random.Random(symbols)
    base = ["receive", "Größe", "colour", "élève", "banana", "aaaaaa", "étéétés", "theatre"]
    texts = []
    for k in range(400):
        words = []
        for _ in range(rng.randrange(20)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice("aeéßÀ")
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + [c] + w[at:], w[:at] + [c] + w[at + 1:]])
            words.append("".join(w))
        texts.append((k % 90 or None, rng.choice([" ", "-", "7", "\n"]).join(words)))
    want = grouped(counted(texts))
    assert any(want[f][0] for f, *_ in want.values() if f), "a chain of forms is among the cases"
    assert found(V.variants(docs(texts), symbols=symbols)) == want


def test_long_chains_reach_their_root(spark):
    links = [(f"w{k:02d}", f"w{k + 1:02d}") for k in range(40)]
    got = V.roots(spark.createDataFrame(links, "word string, form string"), 3 << 40).collect()
    assert {r["word"]: r["root"] for r in got} == {a: "w40" for a, _ in links}


def test_checksums():
    texts = ["", "é" * 200 + " b", "word ÿ x" * 30]
    data, offsets = W.texts(pa.array(texts))
    runs = V.letter_runs(data, offsets)
    seed = np.full(len(runs.start), zlib.crc32(b"7:"), np.uint32)
    got = V.continued_crc(runs.data, runs.start, runs.end, seed).tolist()
    assert got == [zlib.crc32(("7:" + r).encode()) for t in texts for r in re.findall("[a-zÀ-ÿ]+", t)]


def test_edges(docs):
    assert V.variants(docs([])).count() == 0
    assert V.variants(docs([None, "", "1 2 3", "abcd " * 9])).count() == 0
    rows = [(1, "Letters letters LETTERS"), (1, "Letters letters LETTERS"), (None, "x" * 300_000 + " ÀÉÎÕÜ" * 5), (2, "éèàÿü×÷ß" * 3 + "1éèàÿü×÷ß2éèàÿü×÷ß 3éèàÿü×÷ß")]
    clash = docs(rows).withColumn("word", F.lit(1)).withColumn("n", F.lit("own")).withColumn("key", F.lit(0))
    got = found(V.variants(clash, slip=0))
    assert got == {"letters": (None, "letters", 6, 0, None), "ÀÉÎÕÜ": (None, "ÀÉÎÕÜ", 5, 0, None), "éèàÿü×÷ß": (None, "éèàÿü×÷ß", 3, 0, None)}


def test_ties_take_the_smallest_form(docs):
    text = "house " * 2 + "mouse " * 9 + "rouse " * 9 + "douse " * 2
    got = found(V.variants(docs([text]), min_count=2, slip=0))
    assert got["house"] == ("mouse", "mouse", 2, 3, 9) and got["mouse"][0] is None


def test_nothing_as_long_as_the_vocabulary_is_broadcast(spark, docs):
    """Spark may take every table for small here, and a broadcast of one byte stops the job."""
    words = {"w" * 5 + "abcdefgh"[:k]: 1 << (2 + k) for k in range(9)}
    table = docs([f"{w} " * n for w, n in words.items()])
    limits = {"spark.sql.autoBroadcastJoinThreshold": "1g", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1g", "spark.sql.maxBroadcastTableSize": "1"}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        assert found(V.variants(table, slip=0)) == grouped(words)
    finally:
        for name in limits:
            spark.conf.unset(name)


def test_whole_table_against_all_deletions(spark):
    """The registered query against pairs found by a shared deletion at one place."""
    from quire.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    words = counted(rows)
    by_deletion = {}
    for w in words:
        for i in range(len(w)):
            by_deletion.setdefault(w[:i] + w[i + 1:], []).append((w, i))
    near = {w: set() for w in words}
    for short, members in by_deletion.items():
        for w, i in members:
            if short in near:
                near[short].add(w)
                near[w].add(short)
            near[w].update(x for x, j in members if i == j and x != w)
    got = {r["word"]: r for r in QUERIES["op11_variants"](spark, sf).collect()}
    assert {w: (r["n"], r["n_near"]) for w, r in got.items()} == {w: (n, len(near[w])) for w, n in words.items()}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best and words[best] >= 2 * n else None
        assert (got[w]["form"], got[w]["form_n"]) == (form, words.get(form))
        assert got[w]["root"] == (got[form]["root"] if form else w)
