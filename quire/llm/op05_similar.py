"""N-gram Jaccard join by chosen paths.

The set of a text is its five-word shingles. Sets are embedded by min-wise hashing: token i of a set is (i, its i-th
minimum), so two sets share a token with the probability of their similarity. A run starts with all sets in one
bucket and splits it on sampled tokens: every set follows ``BRANCHES`` tokens into smaller buckets, and again, until a
bucket is small, or holds half of the one it came from, that is, sets that no token tells apart. Such leaves are
compared pair by pair. A pair at the threshold survives a run with the probability of a branching process, and runs are
repeated until the target recall.

Equal sets are one node throughout, so copies are never paired. A pair that meets in several leaves belongs to the first
of them, so links are counted once without listing pairs. Leaves of any size are compared in bounded blocks. Candidates
pass a sketch test with five standard deviations to spare, then whole texts are fetched and the similarity is exact.

Edge cases: a text of one to four words has one shingle of all its words; null and wordless texts resemble nothing, each
is a class of its own; rows repeated under one id are members like others; a class without any id has a null class id;
an empty table gives no rows. Other columns are kept by ``one_of_each``; clashing names are no input of the rest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.session import shared_folder

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.9999
TOKENS, BRANCHES = 128, 2
#: Buckets up to this many sets are leaves; leaves are compared in blocks of so many sets or shingles.
LEAF, BLOCK_SETS, BLOCK_SHINGLES = 128, 512, 4_000_000
SKETCH = "text_key string, doc_id bigint, node binary, n bigint, sketch binary"

_seeds = np.random.default_rng(5)
FACTOR = _seeds.integers(0, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _seeds.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def runs_needed(threshold: float, branches: int, recall: float) -> int:
    """Runs until a pair at the threshold is found with the target recall, at any depth."""
    survival = 1.0
    for _ in range(200):
        survival = 1 - (1 - threshold * survival) ** branches
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival)))


def shingles(words: W.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text in turn, bounds of the texts)."""
    hashes, sizes = W.word_hashes(words), np.diff(words.first)
    text = words.text()
    parts, of = [], []
    for k in range(1, n + 1):  # texts with fewer than n words are one shingle
        whole = W.windows(hashes, k)
        take = np.flatnonzero(W.fits(words.first, k)[: len(whole)])
        take = take[(sizes[text[take]] == k) | (k == n)]
        parts.append(whole[take] + np.uint64(k))
        of.append(text[take])
    value, of = np.concatenate(parts), np.concatenate(of)
    order = np.argsort(value)
    order = order[np.argsort(of[order], kind="stable")]
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(sizes) + 1))


def sketch(documents: DataFrame, n: int = SHINGLE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(text_key, doc_id, node, n, sketch) of every text; node and sketch are null without words."""

    def run(batch: pa.RecordBatch, words: W.Words):
        value, bounds = shingles(words, n)
        full = np.flatnonzero(np.diff(bounds))
        first, sizes = bounds[:-1][full], np.diff(bounds)
        rows = len(sizes)
        node, sketches = np.full(rows, None, object), np.full(rows, None, object)
        if len(full):
            sums = np.stack([np.add.reduceat(W.mixed(value ^ salt), first) for salt in (np.uint64(11), np.uint64(23))], 1)
            table = np.empty((len(full), TOKENS), np.uint32)
            for i in range(TOKENS):
                table[:, i] = np.minimum.reduceat(value * FACTOR[i] + SHIFT[i], first) >> np.uint64(32)
            node[full] = [x.tobytes() for x in sums]
            sketches[full] = [x.tobytes() for x in table]
        yield pa.RecordBatch.from_arrays(
            [batch.column("text_key"), batch.column("doc_id"), pa.array(node, pa.binary()), pa.array(sizes), pa.array(sketches, pa.binary())],
            ["text_key", "doc_id", "node", "n", "sketch"])

    chosen = documents.select(F.md5(text).alias("text_key"), F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return W.per_text(chosen, run, SKETCH)


def coordinate(level: int, slot: int, runs: int) -> int:
    """The token on which a slot of a level is split: another one for each slot while they last, never one of its path."""
    used = []
    for up in range(level + 1):
        at = runs * sum(BRANCHES ** k for k in range(1, up + 1)) + slot // BRANCHES ** (level - up)
        if at >= TOKENS:
            at = next(c for k in range(TOKENS) if (c := (at * 31 + k * 7) % TOKENS) not in used)
        used.append(at)
    return used[-1]


def _children(rows: DataFrame, level: int, runs: int) -> DataFrame:
    """(path, slot, node, parent): each set's buckets one level down; rows are (path, slot, node, parent, sketch)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            table = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, TOKENS)
            path, slot = (batch.column(c).to_numpy() for c in ("path", "slot"))
            for branch in range(BRANCHES):
                child = slot * BRANCHES + branch
                at = np.zeros(len(child), np.int64)
                for s in np.unique(child):
                    at[child == s] = coordinate(level, int(s), runs)
                token = table[np.arange(len(at)), at].astype(np.uint64)
                below = W.mixed(W.mixed(path.astype(np.uint64) + token) + child.astype(np.uint64) * W.BASE).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(below), pa.array(child), batch.column("node"), batch.column("parent")], ["path", "slot", "node", "parent"])

    return rows.mapInArrow(run, "path bigint, slot bigint, node binary, parent bigint")


def split_buckets(nodes: DataFrame, runs: int) -> DataFrame:
    """(leaf, size, shingles, node): the leaves of all runs with two sets or more."""
    spark = nodes.sparkSession
    leaves, total = shared_folder(spark, "leaves"), nodes.count()
    roots = nodes.select(
        F.lit(0).cast("bigint").alias("path"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(runs - 1).cast("bigint"))).alias("slot"),
        "node", F.lit(total).cast("bigint").alias("parent"), "sketch")
    rows, level = roots, 0
    while True:
        below = shared_folder(spark, "buckets")
        _children(rows, level, runs).write.parquet(below)
        buckets = spark.read.parquet(below)
        sizes = buckets.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = buckets.join(sizes, "path")
        last = level + 1 >= TOKENS // 2
        is_leaf = F.lit(last) | (F.col("size") <= LEAF) | (2 * F.col("size") >= F.col("parent"))
        sized.filter(is_leaf).select(F.col("path").alias("leaf"), "size", "node").write.mode("append").parquet(leaves)
        large = sized.filter(~is_leaf).select("path", "slot", "node", F.col("size").alias("parent"))
        if last or large.isEmpty():
            break
        rows, level = large.join(nodes.select("node", "sketch"), "node"), level + 1
    return spark.read.parquet(leaves)


def _groups(batches: Iterator[pa.RecordBatch], rows_at_once: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups, by (leaf, lo, hi), of sorted batches."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows_at_once:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        start = _starts(table)[-1]
        if start:
            yield table.slice(0, start)
        held, count = table.slice(start).to_batches(), table.num_rows - start
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(table: pa.Table) -> np.ndarray:
    keys = [table[c].to_numpy() for c in ("leaf", "lo", "hi")]
    new = np.ones(table.num_rows, bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _pairs(starts: np.ndarray, n: int, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all pairs of rows in one group, i first, in bounded portions."""
    ends = np.append(starts[1:], n)
    last = np.repeat(ends, ends - starts)
    count = last - np.arange(n) - 1
    cuts, total = [0], np.cumsum(count)
    while cuts[-1] < n:
        done = total[cuts[-1] - 1] if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, done + most, "right"))))
    for a, b in zip(cuts, cuts[1:]):
        c = count[a:b]
        i = np.repeat(np.arange(a, b), c)
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)


class Owner:
    """Which pairs belong to the leaf they are met in: those that met in no earlier leaf."""

    def __init__(self, table: pa.Table):
        self.leaf, self.block = table["leaf"].to_numpy(), table["block"].to_numpy()
        self.alone = (table["lo"].to_numpy() == table["hi"].to_numpy())
        lists = table["leaves"].combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        self.of = np.full((len(sizes), int(sizes.max(initial=1))), np.iinfo(np.int64).max)
        self.of[np.arange(self.of.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        mine = self.alone[i] | (self.block[i] != self.block[j])
        earlier = np.zeros(len(i), bool)
        for a in range(self.of.shape[1]):
            one = self.of[i, a]
            earlier |= (one < self.leaf[i]) & (self.of[j] == one[:, None]).any(1)
        return mine & ~earlier


def _by_group(rows: DataFrame, function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches):
        for table in _groups(batches):
            yield from function(table)

    group = ["leaf", "lo", "hi"]
    W.arrow_batches(rows.sparkSession)
    return rows.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, schema)


def candidates(leaves: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(leaf, lo, hi, block, leaves, node): members of leaf blocks with a partner whose sketch is close enough."""
    least = TOKENS * threshold - 5 * math.sqrt(TOKENS * threshold * (1 - threshold))

    def close(table: pa.Table):
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(-1, TOKENS)
        owned, hit = Owner(table), np.zeros(table.num_rows, bool)
        for i, j in _pairs(_starts(table), table.num_rows):
            near = np.flatnonzero((sketches[i] == sketches[j]).sum(1) >= least)
            i, j = i[near], j[near]
            mine = owned(i, j)
            hit[i[mine]] = hit[j[mine]] = True
        yield from table.drop_columns(["sketch"]).filter(pa.array(hit)).to_batches()

    weights = leaves.join(nodes.select("node", "n"), "node")
    sums = weights.groupBy("leaf").agg(F.sum("n").alias("shingles"))
    met = leaves.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))  # bounded by runs and depth
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("bigint")
    placed = leaves.join(sums, "leaf").withColumn("__blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "__blocks"))
    paired = placed.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1)))
    rows = paired.select("leaf", F.least("block", "__other").alias("lo"), F.greatest("block", "__other").alias("hi"), "block", "node")
    rows = rows.join(met, "node").join(nodes.select("node", "sketch"), "node").select("leaf", "lo", "hi", "block", "leaves", "node", "sketch")
    return _by_group(rows, close, "leaf bigint, lo bigint, hi bigint, block bigint, leaves array<bigint>, node binary")


def overlaps(value: np.ndarray, bounds: np.ndarray, width: int = 1 << 14) -> np.ndarray:
    """Common shingles of each pair of sets; sets lie between the bounds."""
    n = len(bounds) - 1
    unique, column = np.unique(value, return_inverse=True)
    row = np.repeat(np.arange(n), np.diff(bounds))
    common = np.zeros((n, n), np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, len(unique), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((n, min(width, len(unique) - lo)), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        common += part @ part.T
    return common.astype(np.int64)


def verified(found: DataFrame, nodes: DataFrame, documents: DataFrame, threshold: float, n: int, key: str, text: str) -> DataFrame:
    """(node, links, root): links of members to others of their leaf block, and the least node they reach there."""

    def verify(table: pa.Table):
        owned, starts = Owner(table), _starts(table)
        names = table["node"].to_pylist()
        values, bounds = shingles(W.split(*W.texts(table["text"].combine_chunks())), n)
        sizes = np.diff(bounds)
        links, root = np.zeros(len(names), np.int64), np.arange(len(names))
        for a, b in zip(starts, np.append(starts[1:], len(names))):
            common = overlaps(values[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a])
            i, j = np.triu_indices(b - a, 1)
            shared = common[i, j]
            alike = shared / np.maximum(sizes[i + a] + sizes[j + a] - shared, 1) >= threshold
            i, j = i[alike] + a, j[alike] + a
            mine = owned(i, j)
            i, j = i[mine], j[mine]
            np.add.at(links, i, 1)
            np.add.at(links, j, 1)
            while len(i):  # least row reached, by repeated exchange along links and jumps
                low = np.minimum(root[i], root[j])
                before = root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, j, low)
                root = root[root]
                if (root == before).all():
                    break
        at = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays(
            [pa.array([names[k] for k in at], pa.binary()), pa.array(links[at]), pa.array([names[k] for k in root[at]], pa.binary())],
            ["node", "links", "root"])

    rep = nodes.select("node", F.col("text_key").alias("__key"), F.col("first_id").alias("__id"))
    groups = F.collect_list(F.struct("leaf", "lo", "hi", "block", "leaves")).alias("__groups")
    wanted = found.groupBy("node").agg(groups).join(rep, "node")  # groups of a node are bounded by runs, depth and blocks
    whole = documents.select(F.md5(text).alias("__key"), F.col(key).cast("bigint").alias("__id"), F.col(text).alias("text")).alias("d")
    same = (F.col("d.__key") == F.col("w.__key")) & F.col("d.__id").eqNullSafe(F.col("w.__id"))
    texts = whole.join(wanted.alias("w"), same).select("node", "text", "__groups").dropDuplicates(["node"])
    rows = texts.withColumn("__g", F.explode("__groups")).select("__g.*", "node", "text")
    return _by_group(rows, verify, "node binary, links bigint, root binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (node, root) is connected with.

    Large-star and small-star steps in turn; each round is written to the shared folder.
    """
    spark = edges.sparkSession

    def kept(df: DataFrame) -> DataFrame:
        path = shared_folder(spark, "edges")
        df.write.parquet(path)
        return spark.read.parquet(path)

    def digest(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = kept(edges.filter("node <> root").select(F.greatest("node", "root").alias("a"), F.least("node", "root").alias("b")).distinct())
    state = digest(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = kept(large.filter("a <> b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = kept(small.filter("a <> b").distinct())
        after = digest(now)
        if after == state:
            break
        state = after
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def similar(
    documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, text_key, class_id, n_links, root) of every document.

    ``class_id`` is the least id of those connected by links or equal sets, ``n_links`` counts the other sets that the
    document's set resembles, ``root`` names the class where ids are missing.
    """
    spark: SparkSession = documents.sparkSession
    runs = runs_needed(threshold, BRANCHES, recall)
    path, node_path, found_path, link_path = (shared_folder(spark, x) for x in ("sketches", "nodes", "candidates", "links"))
    sketch(documents, n, key, text).write.parquet(path)
    sketches = spark.read.parquet(path)
    full = sketches.filter("node IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    grouped = full.groupBy("node").agg(first.alias("f"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    grouped.select("node", F.col("f.doc_id").alias("first_id"), F.col("f.text_key").alias("text_key"), "n", "sketch").write.parquet(node_path)
    nodes = spark.read.parquet(node_path)
    candidates(split_buckets(nodes, runs), nodes, threshold).write.parquet(found_path)
    verified(spark.read.parquet(found_path), nodes, documents, threshold, n, key, text).write.parquet(link_path)
    links = spark.read.parquet(link_path)

    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(links.select("node", "root")).join(nodes.select("node", "first_id"), "node", "right")
    rooted = roots.withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("class_id"))
    classes = rooted.join(least, "root").join(counts, "node", "left").select("node", "root", "class_id", "n_links")
    return sketches.select("doc_id", "text_key", "node").join(classes, "node", "left").select(
        "doc_id", "text_key",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), "root",
    )


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Documents of which one stays in each class: the one with the least id, one of its rows; wordless ones all stay."""
    found = similar(documents, key=key, text=text, **options).filter("root IS NOT NULL")
    ids = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    stay = found.groupBy("root").agg(F.min(ids).alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.text_key").alias("__key")).distinct()
    rows = documents.withColumn("__text", F.md5(text))
    wordless = F.coalesce(~F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    same = (F.col("__text") == F.col("__key")) & F.col(key).cast("bigint").eqNullSafe(F.col("__id"))
    chosen = rows.join(stay, same).dropDuplicates(["__key", "__id"])
    return chosen.select(*documents.columns).unionByName(documents.filter(wordless))


def op5_similar(spark, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and the number of different texts that it resembles."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return similar(documents).select("doc_id", "class_id", "n_links")
