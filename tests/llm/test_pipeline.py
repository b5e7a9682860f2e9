import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from tests.llm.test_op05 import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows in and out of every stage, over the whole small table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append(([r.asDict() for r in docs.collect()], [r.asDict() for r in after.collect()], after.columns))
        docs = after
    return out


def test_stages_keep_the_columns(steps):
    assert [s[2] for s in steps[:-1]] == [["doc_id", "text", "lang", "source", "n_chars"]] * 4
    assert all(s[1] for s in steps)


def test_language(steps):
    before, after, _ = steps[0]
    assert len(after) >= 0.99 * len(before)  # every document here is prose of a labelled language
    assert not [r for r in after if not re.search(r"[^\W\d_]", r["text"] or "")]


def test_one_of_each(steps):
    before, after, _ = steps[1]
    classes, _ = brute([r["text"] for r in before])
    least = {}
    for r, c in zip(before, classes):
        least[c] = min(r["doc_id"], least.get(c, r["doc_id"]))
    assert sorted(r["doc_id"] for r in after) == sorted(least.values())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def test_benchmark(spark, steps):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k: k + 10]) for k in range(max(1, len(w) - 9))}
    before, after, _ = steps[2]
    clean = [r["doc_id"] for r in before if not any(tuple(w[k: k + 10]) in windows for w in [words(r["text"])] for k in range(len(w)))]
    assert sorted(r["doc_id"] for r in after) == sorted(clean) and len(clean) < len(before)


def test_mix(steps):
    before, after, _ = steps[3]
    sizes = Counter()
    for r in before:
        sizes[r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in after:
        taken[r["source"]] += len(r["text"].split())
    assert set(Counter(r["doc_id"] for r in after).values()) <= {1, 2}
    assert abs(sum(taken.values()) / sum(sizes.values()) - 1.5) < 0.1


def test_token_files(steps):
    from tokenizers import Tokenizer

    before, after, _ = steps[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [1], "<u4") for r in before}
    start, want = 0, []
    for doc_id in sorted(r["doc_id"] for r in before):
        want.append((doc_id, start, len(ids[doc_id]), zlib.crc32(ids[doc_id].tobytes())))
        start += len(ids[doc_id])
    assert sorted(tuple(r.values()) for r in after) == want


def test_nothing_and_nulls(spark, docs):
    empty = docs([])
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0
    odd = docs([(None, None), (1, ""), (2, "prose of some words", "en", None), (2, "prose of some words", "en", None)])
    for _, stage in P.STAGES:
        stage(spark, odd, SF).collect()
