import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import op07_token_files as T
from quire.session import shared_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


def direct(texts):
    from tokenizers import Tokenizer

    return [e.ids + [1] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def expected(rows):
    start, out = 0, []
    for doc_id, ids in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def stored(spark, table):
    path = T.write_tokens(table, shared_folder(spark, "t"), PATH)
    rows = T.read_tokens(spark, path).collect()
    return path, rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=40))
def test_numbers_return(numbers):
    n = np.array(numbers, np.uint32)
    control, data = T.encode_numbers(n)
    assert len(control) == -(-len(n) // 4)
    assert T.decode_numbers(control, data, len(n)).tolist() == numbers


def test_whole_table_against_the_tokenizer(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = expected(list(zip([d["doc_id"] for d in documents], direct([d["text"] for d in documents]))))
    got = T.op7_token_files(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


TEXTS = ["it's I'LL été a b İx 12 345!?", None, "", "  \n ", "x" * 30_000, "don't 中文 \U0001f600 ́mark", "same same", "same same"]


def test_plain_words_go_without_the_normalizer():
    """Letters with and without composed forms, marks, digits and what lowers in more than one step."""
    words = ["it's", "I'LL", "été,", "ÀÉÎÕÜß×÷ÿ", "İx", "J\u030c", "j\u030c", "ΣΑΣ", "e\u0301", "“Quoted”", "a—b", "12345!?", "x\u0660y", "\u0660", "中文", "ﬁ", "K", "don't.'s", "ŁÓDŹ", "<|endoftext|>", "…", "«A»"]
    known = T.Known(PATH)
    ids, sizes = known._encoded(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [known.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert known.bare is not None and T.Known(public_tokenizers.path("byte_bpe_50k.json")).bare is None


@pytest.mark.parametrize("block, known", [(1 << 16, 10**6), (3, 2)])
def test_edges(spark, docs, monkeypatch, block, known):
    monkeypatch.setattr(T, "BLOCK_TOKENS", block)
    monkeypatch.setattr(T, "KNOWN_WORDS", known)
    ids = [7, None, 3, 5, 2, 9, 4, 4]
    table = docs(list(zip(ids, TEXTS))).withColumnRenamed("source", "ids")
    _, rows = stored(spark, table.repartition(3))
    assert sorted((tuple(r)[:4] for r in rows), key=str) == sorted(expected(list(zip(ids, direct(TEXTS)))), key=str)
    for row in rows:
        assert zlib.crc32(row["ids"]) == row["ids_crc32"]


def test_frequent_ids_are_short(spark, docs):
    path, _ = stored(spark, docs(["the the the of", "the zyzzyva"]))
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    counts = [i for ids in direct(["the the the of", "the zyzzyva"]) for i in ids]
    assert [r["id"] for r in ranks] == sorted(set(counts), key=lambda i: (-counts.count(i), i))


def test_nothing(spark, docs):
    _, rows = stored(spark, docs([]))
    assert rows == []
