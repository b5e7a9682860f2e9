import zlib

import numpy as np
from pyspark.sql import functions as F

from quire.llm import op03_language as L

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    rows = {r["doc_id"]: r for r in L.op3_language(spark, SF).collect()}
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in rows.items())
    out = [t for t in truth if rows[t["doc_id"]]["held_out"]]
    assert sum(rows[t["doc_id"]]["lang_pred"] == t["lang"] for t in out) >= 0.98 * len(out)


def test_em_raises_the_likelihood_to_its_maximum():
    pick = np.random.default_rng(3)
    likelihood, count = pick.random((40, 2)), np.ones(40)
    first = np.array([0])
    shares, value = L.fit(likelihood, count, first, np.array([[0.5, 0.5]]), 500)
    grid = np.linspace(0.001, 0.999, 999)
    best = max((np.log(likelihood @ [a, 1 - a]).sum(), a) for a in grid)
    assert abs(shares[0, 0] - best[1]) < 2e-3 and abs(value[0] - best[0]) < 1e-3


def learnt(spark):
    return L.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_mixtures(spark, docs, rows_of):
    names, model = learnt(spark)
    some = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    texts = [some["de"][:3000], some["de"][:4000] + " " + some["fr"][:1500], "".join(some[k][:2000] + " " for k in ("en", "es", "fr"))]
    found = rows_of(L.identify(docs(texts), names, model))
    assert [sorted(found[k]["langs"]) for k in range(3)] == [["de"], ["de", "fr"], ["en", "es", "fr"]]
    assert found[1]["lang_pred"] == "de" and 0.6 < found[1]["score"] < 0.85


def test_edges(spark, docs, rows_of):
    names, model = learnt(spark)
    texts = [None, "", " \n", "12 34 !?", "der", "x" * 60_000, "中文 \ud83d".encode("utf-8", "replace").decode()]
    found = rows_of(L.identify(docs(texts).withColumnRenamed("source", "score"), names, model))
    assert [found[k]["lang_pred"] == "und" for k in range(7)] == [True] * 4 + [False] * 3
    assert all(found[k]["score"] == 0 and found[k]["langs"] == [] for k in range(4))
    same = L.identify(docs([(None, "der und die"), (1, "der und die"), (1, "der und die")]), names, model).collect()
    assert len(same) == 3 and len({r["score"] for r in same}) == 1
    assert L.identify(docs([]), names, model).count() == 0


def test_nothing_is_labelled(docs):
    assert [r["lang_pred"] for r in L.identify(docs(["some text"]), *L.learn(docs(["some text"]))).collect()] == ["und"]
