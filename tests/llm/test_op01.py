import math

import public_tokenizers
import pytest

from quire.llm import op01_token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return C.read_ranks(PATH)


TOTAL = {}


def brute(ranks, word):
    """Pieces of the best segmentation, by trying every piece at every place."""
    if len(ranks) not in TOTAL:
        TOTAL[len(ranks)] = math.log(sum(1 / (r + C.SHIFT) for r in ranks.values())), max(map(len, ranks))
    norm, longest = TOTAL[len(ranks)]
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[end - 1][0] - math.log(len(ranks) + C.SHIFT) - norm, -(-best[end - 1][1] + 1))]
        for start in range(max(0, end - longest), end):
            rank = ranks.get(word[start:end])
            if rank is not None:
                options.append((best[start][0] + (-math.log(rank + C.SHIFT) - norm), best[start][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def pretokens(text):
    raw, out, k = (text or "").encode(), [], 0
    for word in raw.split():
        k = raw.index(word, k)
        out.append(word if k == 0 else b" " + word)
        k += len(word)
    return out


def count(ranks, text):
    return sum(brute(ranks, w) for w in pretokens(text))


def test_whole_table_against_brute_force(spark, ranks):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    known = {}
    for d in documents:
        for w in pretokens(d["text"]):
            if w not in known:
                known[w] = brute(ranks, w)
    want = {d["doc_id"]: (len(pretokens(d["text"])), sum(known[w] for w in pretokens(d["text"]))) for d in documents}
    assert want == {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in C.op1_token_counts(spark, "/root/testdata/sf0.001").collect()}


TEXTS = [None, "", " \t\n", "the", " the", "été 中文\U0001f600", "x" * 700 + " the", "the the", "a b"]


@pytest.mark.parametrize("nodes, known", [(10**6, 10**6), (3, 1)])
def test_edges(docs, rows_of, ranks, monkeypatch, nodes, known):
    monkeypatch.setattr(C, "NODES", nodes)
    monkeypatch.setattr(C, "KNOWN", known)
    found = rows_of(C.token_counts(docs(TEXTS).withColumnRenamed("source", "n_words"), PATH))
    assert [found[k]["n_tokens"] for k in range(len(TEXTS))] == [count(ranks, t) for t in TEXTS]
    same = C.token_counts(docs([(1, "the cat"), (1, "the cat"), (None, "the cat")]), PATH).collect()
    assert len({r["n_tokens"] for r in same}) == 1 and len(same) == 3
    assert C.token_counts(docs([]), PATH).count() == 0


def test_a_shared_prefix_is_scored_once(ranks, monkeypatch):
    trie, steps = C.Trie(C.Pieces(ranks)), []
    monkeypatch.setattr(C.Trie, "_extend", lambda self, word, end, s, c, real=C.Trie._extend: (steps.append(word[:end]), real(self, word, end, s, c)))
    for word in (b" contest", b" contend", b" content", b" contest"):
        assert trie.pieces_of(word) == brute(ranks, word)
    assert len(steps) == len(set(steps)) == len({w[:k] for w in (b" contest", b" contend", b" content") for k in range(1, 9)})


def test_bytes_without_a_piece():
    trie = C.Trie(C.Pieces({b"ab": 0, b"a": 1}))
    assert [trie.pieces_of(w) for w in (b"ab", b"aab", b"zab", b"zz")] == [1, 2, 2, 2]
