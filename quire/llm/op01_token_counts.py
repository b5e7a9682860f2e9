"""Token counts of a unigram model, with forward scores shared in a trie.

The pieces are a public byte vocabulary; a piece's probability falls with its rank r as 1 / (r + ``SHIFT``). A text's
pre-tokens are its words, with one space before each but one at the very start of the text. Distinct pre-tokens are
inserted in a trie; a node keeps the best score and the number of pieces of the prefix it stands for, computed once for
all pre-tokens that share it, from the pieces that end there; the node where a pre-token ends gives its count. Ties
go to fewer pieces. Counts of known pre-tokens are kept by hash; both stores are bounded and start anew when full.

Edge cases: null, empty and blank texts have no tokens; a byte without a piece counts as a piece of rank ``len(pieces)``;
pre-tokens of any length are read whole, long ones without storing their prefixes; repeated rows count alike; an empty
table gives no rows. Other columns are kept; names that clash with result columns are replaced.
"""

from __future__ import annotations

import base64
import math
import sys
import types

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import words as W

SHIFT = 10.0
#: Nodes of a trie, pre-tokens known by hash, bytes of a pre-token that is stored.
NODES, KNOWN, STORED = 1_000_000, 1_500_000, 256
NEW = ["n_words", "n_tokens"]


class Pieces:
    """Log-probabilities of pieces, found from their last byte backwards."""

    def __init__(self, ranks: dict[bytes, int]):
        norm = math.log(sum(1 / (r + SHIFT) for r in ranks.values()))
        self.unknown = -math.log(len(ranks) + SHIFT) - norm
        self.root: dict = {}
        for piece, rank in ranks.items():
            node = self.root
            for byte in reversed(piece):
                node = node.setdefault(byte, {})
            node[-1] = -math.log(rank + SHIFT) - norm


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Trie:
    """Prefixes of pre-tokens with their forward scores."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.below: dict[int, int] = {}
        self.score, self.count = [0.0], [0]

    def _extend(self, word: bytes, end: int, scores: list[float], counts: list[int]) -> None:
        """Append the best score and count of ``word[:end]``, those of shorter prefixes being there."""
        best, fewest = scores[end - 1] + self.pieces.unknown, counts[end - 1] + 1
        node, at = self.pieces.root, end
        while at:
            node = node.get(word[at - 1])
            if node is None:
                break
            at -= 1
            gain = node.get(-1)
            if gain is not None:
                value, n = scores[at] + gain, counts[at] + 1
                if value > best or (value == best and n < fewest):
                    best, fewest = value, n
        scores.append(best)
        counts.append(fewest)

    def pieces_of(self, word: bytes) -> int:
        scores, counts = [0.0], [0]
        if len(word) > STORED:
            for end in range(1, len(word) + 1):
                self._extend(word, end, scores, counts)
            return counts[-1]
        if len(self.score) > NODES:
            self.clear()
        node = 0
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            found = self.below.get(key)
            if found is None:
                self._extend(word, end, scores, counts)
                found = self.below[key] = len(self.score)
                self.score.append(scores[end])
                self.count.append(counts[end])
            else:
                scores.append(self.score[found])
                counts.append(self.count[found])
            node = found
        return self.count[node]


class Counter:
    """Counts of the pre-tokens that a worker has met, by hash."""

    def __init__(self, path: str):
        self.trie, self.known = Trie(Pieces(read_ranks(path))), {}

    def __call__(self, words: W.Words) -> np.ndarray:
        """The number of pieces of each word."""
        if len(self.known) > KNOWN:
            self.known.clear()
        full = np.flatnonzero(np.diff(words.first))
        bare = words.first[full]
        bare = bare[words.start[bare] == words.begin[full]]  # no space before them
        hashes = W.word_hashes(words)
        hashes[bare] = W.mixed(hashes[bare])
        codes, unique = pd.factorize(hashes)
        unique = unique.tolist()
        fresh = [k for k, n in enumerate(map(self.known.get, unique)) if n is None]
        if fresh:
            at = np.zeros(len(unique), np.int64)
            at[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw, alone = words.data.tobytes(), set(bare.tolist())
            for k, i in zip(fresh, at[fresh].tolist()):
                word = raw[words.start[i]: words.end[i]]
                self.known[unique[k]] = self.trie.pieces_of(word if i in alone else b" " + word)
        return np.array(list(map(self.known.get, unique)), np.int64)[codes]


def counter(path: str) -> Counter:
    """The worker's own counter; workers outlive tasks."""
    kept = sys.modules.setdefault("_quire_piece_counts", types.ModuleType("_quire_piece_counts")).__dict__
    if path not in kept:
        kept[path] = Counter(path)
    return kept[path]


def token_counts(documents: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Documents with n_words and n_tokens."""
    kept = documents.select(*[c for c in documents.columns if c not in NEW])

    def run(batch: pa.RecordBatch, words: W.Words):
        sums = np.concatenate([[0], np.cumsum(counter(vocabulary)(words))])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.diff(words.first)), pa.array(np.diff(sums[words.first]))], [*batch.schema.names, *NEW])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return W.per_text(kept, run, f"{schema}, n_words bigint, n_tokens bigint", text)


def op1_token_counts(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The number of words and tokens of every text."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(documents, public_tokenizers.path(vocabulary)).drop("text")
