import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import op12_shards as S
from quire.session import shared_folder


def test_matrix_sums_are_exact():
    parts, shards = [0, 7, 1, 1000, 3, 0, 250], S.shard_sizes(1261, 16)
    matrix = S.communication_matrix(parts, shards)
    assert matrix.sum(1).tolist() == parts and (matrix.sum(0) == shards).all() and (matrix >= 0).all()
    assert (matrix == S.communication_matrix(parts, shards)).all()
    assert shards.max() - shards.min() == 1 and shards.sum() == 1261


def test_matrix_has_the_distribution_of_a_uniform_permutation():
    seen = Counter(int(S.communication_matrix([3, 5], S.shard_sizes(8, 2), seed)[0, 0]) for seed in range(20_000))
    want = [4 / 56, 24 / 56, 24 / 56, 4 / 56]  # C(4, k) * C(4, 3 - k) / C(8, 3)
    for k, p in enumerate(want):
        assert abs(seen[k] / 20_000 - p) < 0.015


def test_large_urns(monkeypatch):
    good, bad, drawn = 40_000, 70_000, 900
    exact = np.random.default_rng(1).hypergeometric(good, bad, drawn, 4000)
    monkeypatch.setattr(S, "URN", 10)
    rng = np.random.default_rng(2)
    ours = np.array([S.hypergeometric(rng, good, bad, drawn) for _ in range(4000)])
    assert abs(ours.mean() - exact.mean()) < 1.5 and abs(ours.std() / exact.std() - 1) < 0.06
    matrix = S.communication_matrix([5, 9, 0, 11], S.shard_sizes(25, 4))
    assert matrix.sum(1).tolist() == [5, 9, 0, 11] and matrix.sum(0).tolist() == [7, 6, 6, 6]
    monkeypatch.undo()
    matrix = S.communication_matrix([3 * 10**9, 10**9, 7], S.shard_sizes(4 * 10**9 + 7, 3))
    assert matrix.sum(1).tolist() == [3 * 10**9, 10**9, 7] and np.ptp(matrix.sum(0)) <= 1


@pytest.mark.parametrize("shards, cell_rows", [(16, 1 << 14), (3, 5), (700, 2)])
def test_shards_are_even_and_gapless(spark, shards, cell_rows):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text")).repartition(5)
    path = shared_folder(spark, "test-shards")
    rows = S.write_shards(docs, path, shards, cell_rows=cell_rows).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == [(k, f"text {k % 7}") for k in range(600)]
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_the_shuffle_looks_uniform(spark):
    docs = spark.range(0, 8000, 1, 4).select(F.col("id").alias("doc_id"))
    rows = S.shuffled(docs, 4, cell_rows=100).collect()
    origin = Counter((r["doc_id"] // 2000, r["shard"]) for r in rows)  # a quarter of each partition to each shard, about
    assert len(origin) == 16 and all(abs(n - 500) < 100 for n in origin.values())
    for shard in range(4):
        ordered = np.array([r["doc_id"] for r in sorted((r for r in rows if r["shard"] == shard), key=lambda r: r["slot"])])
        assert abs(np.corrcoef(ordered, np.arange(len(ordered)))[0, 1]) < 0.1
        assert abs(np.corrcoef(ordered[1:], ordered[:-1])[0, 1]) < 0.1


def test_reruns_agree_and_seeds_differ(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    one, two, other = ({r["doc_id"]: (r["shard"], r["slot"]) for r in S.shuffled(docs, seed=s).collect()} for s in (12, 12, 13))
    assert one == two != other


def test_edges(docs, spark):
    assert S.shuffled(docs([])).count() == 0
    empty = S.write_shards(docs([]), shared_folder(spark, "test-shards"))
    assert empty.count() == 0 and {"text", "shard", "slot"} <= set(empty.columns)
    rows = [(None, None), (1, ""), (2, "é" * 200_000), *[(3, "same")] * 40, (None, "x")]
    clash = docs(rows).withColumn("Shard", F.lit("own")).withColumn("slot", F.lit(7)).withColumn("slot_in", F.lit(8)).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    got = S.write_shards(clash, shared_folder(spark, "test-shards"), 4, cell_rows=3)
    assert got.columns == [*docs(rows).columns, "Shard_in", "slot_in_in", "slot_in", "m", "slot", "shard"]
    found = got.collect()
    assert Counter(r["shard"] for r in found) == {0: 11, 1: 11, 2: 11, 3: 11}
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((a, b) for a, b in rows)
    assert {r["Shard_in"] for r in found} == {"own"} and {r["slot_in_in"] for r in found} == {7} and {r["slot_in"] for r in found} == {8}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.op12_shards(spark, sf).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
