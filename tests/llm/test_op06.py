import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import op06_language_model as L

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def base(texts, training):
    c = Counter(t for text in training for t in tokens(text))
    n, v = sum(c.values()), len(c)
    return [(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x)), sum(c[t] > 0 for t in tokens(x)), len(tokens(x)), n) for x in texts]


def same(rows, want):
    for r, (score, known, n, total) in zip(rows, want):
        assert r["base_score"] == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert (r["n_known"], r["n_tokens"], r["train_tokens"]) == (known, n, total)


def test_whole_table(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = L.op6_language_model(spark, SF).orderBy("doc_id").collect()
    out = [zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0 for d in documents]
    assert [r["held_out"] for r in rows] == out
    same(rows, base([d["text"] for d in documents], [d["text"] for d, o in zip(documents, out) if not o]))
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_tokens_by_join_score_alike(docs):
    texts = [f"the cat w{k % 7} sat on w{k} mat {'x' * (k % 3 + 1)}" for k in range(60)]
    want = L.score(docs(texts), L.learn(docs(texts))).orderBy("doc_id").collect()
    few = L.score(docs(texts), L.learn(docs(texts), frequent=3)).orderBy("doc_id").collect()
    for a, b in zip(want, few):
        assert a["score"] == pytest.approx(b["score"]) and a["n_known"] == b["n_known"]
    same(few, base(texts, texts))


def test_probabilities_of_all_tokens_sum_to_one(docs):
    texts = [f"the {w} ran and the {v} sat." for w in ("cat", "dog", "cow", "hen") for v in ("fox", "owl", "ox")]
    trained = L.learn(docs(texts))
    m = trained.outputs.size()
    logs = trained.model.log_probabilities(np.arange((m + 1) ** 2))
    assert np.allclose(np.exp(logs).sum(1), 1, atol=1e-4)
    counts = trained.counts.toPandas()
    out = trained.outputs.of(counts["hash"].to_numpy(np.int64).view(np.uint64), counts["class"].to_numpy())
    for k in range(L.CLASSES):
        own = counts["c"].to_numpy()[out == len(trained.outputs.words) + k]
        assert (own + 0.1).sum() + 0.1 == pytest.approx(10 ** trained.class_log[k])


def test_training_learns_what_follows():
    m = 4  # 0 after 1, 1 after 0, whatever comes before
    code = np.array([((b * (m + 1) + a) * m) + (1 - a) for a in (0, 1) for b in range(m)])
    model = L.train(code, np.full(len(code), 50), m)
    p = np.exp(model.log_probabilities(np.array([2 * (m + 1) + 0, 2 * (m + 1) + 1])))
    assert p[0, 1] > 0.9 and p[1, 0] > 0.9


def test_edges(docs, rows_of):
    texts = [None, "", " \n", "the cat", "THE cat", "unseen " * 3000]
    found = rows_of(L.score(docs(texts).withColumnRenamed("source", "score"), L.learn(docs(["the cat sat", "the cat ran", None]))))
    same([found[k] for k in range(6)], base(texts, ["the cat sat", "the cat ran", None]))
    assert found[3]["score"] == found[4]["score"] and found[0]["score"] == found[2]["score"]
    bare = rows_of(L.score(docs(texts), L.learn(docs([]))))
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 for r in bare.values())
    trained = L.learn(docs(["a b"]))
    assert L.score(docs([]), trained).count() == 0
    assert len(L.score(docs([(None, "a"), (1, "a"), (1, "a")]), trained).collect()) == 3
