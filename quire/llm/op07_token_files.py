"""Token ids in files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Format, a folder of two Parquet tables. ``ranks`` has (rank, id), the most frequent id first. ``tokens`` has a row for
each block of whole documents, in ascending document order through the parts: part, block, doc_ids, counts (ids of each
document, its end id included), n_tokens, control and data. A number takes one to four little-endian bytes of
``data``; two bits of ``control`` say how many, four numbers to a byte, the first in the lowest bits.

Texts are cut at white space, which no token crosses, and each distinct word is encoded once by a worker with the
tokenizer itself; its dictionary is bounded and starts anew when full. Where the tokenizer does no more than compose, squeeze
spaces and lower letters, words of plain letters and marks skip these steps: Python lowers them, and a digit between them,
which no token joins to anything, shows where the ids of a word end. Ids wait in the shared folder for the ranks,
then are ordered by one range shuffle.

Edge cases: a null or empty text has the end id alone; documents without id come first; rows repeated under one id stand
side by side, shorter first; very long texts make a block of their own; an empty table gives files without blocks.
Other columns are not part of the format.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.session import shared_folder

BLOCK_TOKENS = 1 << 16
#: Words and ids that a worker remembers; both bound its memory. Words of one call of the tokenizer.
KNOWN_WORDS, KNOWN_IDS, JOINED = 1_500_000, 10_000_000, 128
#: Words that composition leaves alone and whose letters lower one by one.
PLAIN = re.compile("[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF\u2013\u2014\u2018-\u201E\u2026\u00AB\u00BB]+")
#: A digit that no plain word holds, in bytes that none of them holds.
MARK, AT_ONCE = "\u0660", 32


class Known:
    """Ids of the words that a worker has met, by hash."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.bare, self.mark = self._bare(Tokenizer)
        self.clear()

    def _bare(self, kind) -> tuple:
        """The tokenizer without its normalizer and the ids of the mark, if plain words can go without."""
        made = json.loads(self.tokenizer.to_str())
        steps, cut = made.get("normalizer") or {}, (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [(n["type"], n.get("pattern", {}).get("Regex"), n.get("content")) for n in steps.get("normalizers") or []]
        digits_alone = "|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in (cut[0].get("pattern") or {}).get("Regex", "") and cut[0].get("behavior") == "Removed"
        if steps != [("NFC", None, None), ("Replace", "\\s+", " "), ("Lowercase", None, None)] or not digits_alone:
            return None, None
        bare = kind.from_str(json.dumps({**made, "normalizer": None}))
        return bare, bare.encode(MARK, add_special_tokens=False).ids

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        portions = [MARK.join(words[k: k + AT_ONCE]) + MARK for k in range(0, len(words), AT_ONCE)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(portions, add_special_tokens=False)])
        at, width = np.flatnonzero(ids == self.mark[0]), len(self.mark)
        kept = np.ones(len(ids), bool)
        for k in range(width):
            kept[at + k] = False
        return ids[kept], np.diff(at, prepend=-width) - width

    def clear(self) -> None:
        self.hashes, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.ids, self.used = np.zeros(1 << 14, np.uint32), 0

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of each word's ids), in the order of the words."""
        plain = np.array([self.bare is not None and PLAIN.fullmatch(w) is not None for w in words], bool)
        parts = [np.flatnonzero(plain), np.flatnonzero(~plain)]
        found = [f([words[i].lower() if f == self._plain else words[i] for i in part]) for f, part in zip((self._plain, self._whole), parts) if len(part)]
        if len(found) == 1:
            return found[0]
        order = np.argsort(np.concatenate(parts))
        ids, sizes = (np.concatenate(x) for x in zip(*found))
        at = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        return ids[np.arange(len(ids)) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)], sizes

    def _whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words go to the tokenizer some at a time, parted by line ends."""
        portions = [words[k: k + JOINED] for k in range(0, len(words), JOINED)]
        ids, sizes = [], []
        for portion, found in zip(portions, self.tokenizer.encode_batch(["\n".join(p) for p in portions], add_special_tokens=False)):
            ends = np.cumsum([len(w) + 1 for w in portion])
            cuts = np.searchsorted(np.fromiter((a for a, _ in found.offsets), np.int64, len(found)), ends)
            ids.append(np.array(found.ids, np.uint32))
            sizes.append(np.diff(cuts, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _store(self, before: np.ndarray, hashes: np.ndarray, words: list[str]) -> np.ndarray:
        """Places of new words; ``before`` says where among the sorted hashes theirs belong."""
        ids, sizes = self._encoded(words)
        n, total = len(self.place), len(ids)
        while n + len(sizes) > len(self.at):
            self.at, self.size = np.resize(self.at, 2 * len(self.at)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.at[n: n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[n: n + len(sizes)] = sizes
        self.ids[self.used: self.used + total] = ids
        self.used += total
        place = np.arange(n, n + len(hashes))
        self.hashes, self.place = np.insert(self.hashes, before, hashes), np.insert(self.place, before, place)
        return place

    def encode(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        if len(self.place) > KNOWN_WORDS or self.used > KNOWN_IDS:
            self.clear()
        unique, first, codes = np.unique(W.word_hashes(words), return_index=True, return_inverse=True)
        before = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        inside = before < len(self.hashes)
        known[inside] = self.hashes[before[inside]] == unique[inside]
        place = np.zeros(len(unique), np.int64)
        place[known] = self.place[before[known]]
        if not known.all():
            place[~known] = self._store(before[~known], unique[~known], words.strings(first[~known]))
        at, sizes = self.at[place][codes], self.size[place][codes]
        return self.ids[np.arange(int(sizes.sum())) + np.repeat(at - (np.cumsum(sizes) - sizes), sizes)], sizes


def narrowest(tokenizer: str, end_id: int) -> type:
    """Two bytes for an id where the vocabulary fits, else four; ids wait in this form."""
    from tokenizers import Tokenizer

    return np.uint16 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id) <= 1 << 16 else np.uint32


def known(path: str) -> Known:
    """The worker's own dictionary; workers outlive tasks."""
    kept = sys.modules.setdefault("_quire_known_words", types.ModuleType("_quire_known_words")).__dict__
    if path not in kept:
        kept[path] = Known(path)
    return kept[path]


def token_ids(documents: DataFrame, tokenizer: str, end_id: int, kind: type, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): little-endian ids of each text and the end id."""

    def encode(batch: pa.RecordBatch, words: W.Words):
        ids, sizes = known(tokenizer).encode(words)
        ends = np.concatenate([[0], np.cumsum(sizes)])[words.first]
        ids = ids.astype(kind)
        raw = [ids[a:b].tobytes() + end for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(raw, pa.binary())], [key, "ids"])

    end = kind(end_id).tobytes()
    chosen = documents.select(key, F.col(text).cast("string").alias(text))
    return W.per_text(chosen, encode, f"{key} {documents.schema[key].dataType.simpleString()}, ids binary", text)


def rank_table(ids: DataFrame, kind: type) -> DataFrame:
    """(rank, id) of every id that occurs, by falling count, then id."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            joined = b"".join(batch.column(0).to_pylist())
            n = np.bincount(np.frombuffer(joined, kind))
            total = np.resize(total, len(n)) * (np.arange(len(n)) < len(total)) if len(n) > len(total) else total
            total[: len(n)] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.desc("n"), "id")  # one row for each id of the vocabulary
    return counts.select((F.row_number().over(order) - 1).cast("bigint").alias("rank"), "id")


def encode_numbers(numbers: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    extra = (numbers >= 1 << 8).astype(np.uint8) + (numbers >= 1 << 16) + (numbers >= 1 << 24)
    padded = np.zeros(-(-len(numbers) // 4) * 4, np.uint8)
    padded[: len(numbers)] = extra
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    by_byte = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), by_byte[np.arange(4) <= extra[:, None]].tobytes()


#: Bytes of the four numbers of each control byte.
SIZES = 1 + (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3)


def decode_numbers(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    at = np.cumsum(sizes) - sizes
    out = np.zeros(n, np.uint32)
    for k in range(4):
        out |= np.where(sizes > k, raw[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


def _pairs(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A rank table on the driver; it has as many rows as the vocabulary has ids."""
    rows = table.toPandas().sort_values("rank")
    ids = rows["id"].to_numpy(np.uint32)
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    return ids, rank


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = 1, key: str = "doc_id", text: str = "text") -> str:
    """Encode all texts into ``path`` and return it."""
    spark = documents.sparkSession
    waiting, kind = shared_folder(spark, "ids"), narrowest(tokenizer, end_id)
    width = np.dtype(kind).itemsize
    token_ids(documents, tokenizer, end_id, kind, key, text).write.option("compression", "zstd").parquet(waiting)
    ids = spark.read.parquet(waiting)
    rank_table(ids, kind).coalesce(1).write.parquet(f"{path}/ranks")
    _, rank = _pairs(spark.read.parquet(f"{path}/ranks"))

    def block(part: int, number: int, held: list[tuple]) -> pa.RecordBatch:
        tokens = rank[np.frombuffer(b"".join(x for _, x in held), kind)]
        control, data = encode_numbers(tokens)
        row = {"part": part, "block": number, "doc_ids": [k for k, _ in held], "counts": [len(x) // width for _, x in held],
               "n_tokens": len(tokens), "control": control, "data": data}
        return pa.RecordBatch.from_pylist([row], pa.schema([
            ("part", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
            ("n_tokens", pa.int64()), ("control", pa.binary()), ("data", pa.binary())]))

    def write(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((k, x))
                size += len(x) // width
                if size >= BLOCK_TOKENS:
                    yield block(part, number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield block(part, number, held)

    W.arrow_batches(spark)
    ordered = ids.select(F.col(key).cast("bigint").alias(key), "ids").repartitionByRange(key).sortWithinPartitions(key, F.length("ids"), "ids")
    ordered.mapInArrow(
        write, "part int, block bigint, doc_ids array<bigint>, counts array<bigint>, n_tokens bigint, control binary, data binary"
    ).write.option("compression", "zstd").parquet(f"{path}/tokens")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files, in no set order."""
    by_rank, _ = _pairs(spark.read.parquet(f"{path}/ranks"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = by_rank[decode_numbers(row["control"], row["data"], row["n_tokens"])].astype("<u4")
                ends = np.cumsum(row["counts"])
                raw = [x.tobytes() for x in np.split(ids, ends[:-1])]
                n = len(raw)
                out = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int64()),
                       pa.array(ends - row["counts"], pa.int64()), pa.array(row["counts"], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["doc_id", "part", "block", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array(raw, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    tokens = spark.read.parquet(f"{path}/tokens")
    schema = "doc_id bigint, part int, block bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    rows = tokens.mapInArrow(read, schema)
    sizes = tokens.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("__n"))  # one row for each file part
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumn("__here", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    blocks = blocks.select("part", "block", (F.col("__before") + F.col("__here")).alias("__start"))
    return rows.join(blocks, ["part", "block"]).select(
        "doc_id", (F.col("__start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def op7_token_files(spark, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """All texts as ids of a public tokenizer, written to files and read back: place, number and checksum of the ids."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = write_tokens(documents, shared_folder(spark, "tokens"), public_tokenizers.path(vocabulary))
    return read_tokens(spark, path, with_ids=False)
