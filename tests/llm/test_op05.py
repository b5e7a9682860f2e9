import random

import numpy as np
import pytest

from quire.llm import op05_similar as S


def sets_of(texts, n=5):
    out = []
    for text in texts:
        w = (text or "").split()
        out.append({tuple(w[i: i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    return out


def brute(texts, threshold=0.8):
    """(class index of each text, links of each text to different sets)."""
    sets = sets_of(texts)
    keys = [frozenset(s) for s in sets]
    distinct = sorted({k for k in keys if k}, key=lambda k: keys.index(k))
    links = {k: set() for k in distinct}
    by_size = sorted(range(len(distinct)), key=lambda i: len(distinct[i]))
    for x, i in enumerate(by_size):
        for j in by_size[x + 1:]:
            if len(distinct[i]) < threshold * len(distinct[j]):
                break
            a, b = distinct[i], distinct[j]
            if len(a & b) / len(a | b) >= threshold:
                links[a].add(j)
                links[b].add(i)
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, k in enumerate(distinct):
        for j in links[k]:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    at = {k: i for i, k in enumerate(distinct)}
    classes = [("set", find(at[k])) if k else ("row", i) for i, k in enumerate(keys)]
    return classes, [len(links.get(k, ())) for k in keys]


def check(found, ids, texts):
    classes, links = brute(texts)
    least = {}
    for i, c in zip(ids, classes):
        least[c] = min(i, least.get(c, i))
    assert {i: (least[c], n) for i, c, n in zip(ids, classes, links)} == {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found.collect()}


def corpus(seed, groups=12, copies=30, words=60):
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = pick.choices(vocabulary, k=12)
    out = []
    for _ in range(groups):
        base = pick.choices(vocabulary, k=words)
        for _ in range(copies):
            copy = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 3])):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            out.append(" ".join(copy))
    out += [" ".join(passage + pick.choices(vocabulary, k=40)) for _ in range(200)]
    return out


def test_runs_reach_the_recall():
    assert S.runs_needed(0.8, 2, 0.9999) == 4
    assert S.runs_needed(0.5, 3, 0.9) > 1


def test_a_path_never_takes_a_token_twice():
    for slot in (0, 5, 60, 1000, 4095):
        for level in range(12):
            path = [S.coordinate(k, slot // 2 ** (level - k), 4) for k in range(level + 1)]
            assert len(set(path)) == len(path) and max(path) < S.TOKENS


def test_overlaps_in_slices():
    sets = [np.array([1, 2, 3], np.uint64), np.array([2, 3, 4, 9], np.uint64), np.array([7], np.uint64)]
    bounds = np.array([0, 3, 7, 8])
    assert S.overlaps(np.concatenate(sets), bounds, width=2).tolist() == [[3, 2, 0], [2, 4, 0], [0, 0, 1]]


@pytest.mark.parametrize("leaf, block", [(128, 512), (6, 8)])
def test_against_brute_force(docs, monkeypatch, leaf, block):
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "BLOCK_SETS", block)
    texts = corpus(3)
    check(S.similar(docs(texts)), range(len(texts)), texts)


def test_whole_table_against_brute_force(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = documents.select("doc_id", "text").collect()
    check(S.op5_similar(spark, "/root/testdata/sf0.001"), [r["doc_id"] for r in rows], [r["text"] for r in rows])


def test_edges(docs, rows_of):
    texts = [None, "", " \n ", "one two", "one two", "one  two\n", "one two three", "a b c d e", "a b c d e f"]
    found = rows_of(S.similar(docs(texts)))
    assert [found[i]["class_id"] for i in range(9)] == [0, 1, 2, 3, 3, 3, 6, 7, 8]
    assert all(r["n_links"] == 0 for r in found.values())
    assert S.similar(docs([])).count() == 0


def test_repeated_rows_and_missing_ids(docs, rows_of):
    long_text = " ".join(f"w{i}" for i in range(100))
    near = long_text.replace("w50 ", "x50 ")
    table = docs([(None, long_text), (None, near), (4, "other words stand in this text"), (4, "other words stand in this text"), (2, None), (2, None)])
    assert [r["class_id"] for r in rows_of(S.similar(table))[None]] == [None, None]
    kept = S.one_of_each(table.withColumnRenamed("n_chars", "node")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 2), (False, 2), (False, 4), (True, 0)]
