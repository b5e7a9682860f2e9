"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are words, A-Z lower-cased, and one end for each text. The model's outputs are the ``WORDS`` most frequent tokens
and ``CLASSES`` classes of all others, by their last three bytes; within a class a token has its smoothed share of the
counts, a token never seen the share of a count of zero. The two tokens before are the context: their vectors,
multiplied with a matrix for each place, add up to a vector whose products with the output vectors are the scores.

Spark counts all training tokens and all training contexts. The contexts, at most ``(WORDS + CLASSES) ** 3`` rows, are
what the driver trains on: noise-contrastive estimation with the noise in expectation, so each step is a few matrix
products. Scoring takes the distinct contexts of a batch, one matrix product and a normalisation over all outputs.

Counts of frequent tokens travel to the tasks, at most ``FREQUENT`` of them; all others are joined by a shuffle.

Edge cases: null is an empty text and has the end alone; without training text every output is equally likely and the
base score is 0; documents without id are never held out; repeated rows are scored each by itself; an empty table
gives no rows. Tokens are told apart by a 64-bit hash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W
from quire.llm.op03_language import held_out
from quire.session import shared_folder

WORDS, CLASSES, SIZE, NOISE, ROUNDS, RATE = 96, 64, 32, 10, 80, 0.05
FREQUENT = 1 << 20
END = np.uint64(0x656E64)


def tokens(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, first): tokens of all texts in order, each text followed by its end."""
    data = W.LOWER[words.data]
    n, texts = len(words.start), len(words.first) - 1
    at = np.arange(n) + words.text()
    hashes, classes = np.full(n + texts, END, np.uint64), np.zeros(n + texts, np.int64)
    hashes[at] = W.span_hashes(data, words.start, words.end)
    tail = np.zeros(n, np.uint64)
    for k in range(1, 4):
        here = words.end - k
        tail = tail * np.uint64(257) + np.where(here >= words.start, data[np.maximum(here, 0)] + np.uint64(1), np.uint64(0)) if n else tail
    classes[at] = (W.mixed(tail) % np.uint64(CLASSES)).astype(np.int64)
    return hashes, classes, words.first + np.arange(texts + 1)


def count_tokens(documents: DataFrame, text: str = "text", at_once: int = 1 << 21) -> DataFrame:
    """(hash, class, c) of every distinct token."""
    W.arrow_batches(documents.sparkSession)

    def run(batches):
        held, size = [], 0

        def counted():
            hashes, classes = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            codes, unique = pd.factorize(hashes)
            of = np.zeros(len(unique), np.int64)
            of[codes] = classes
            return pa.RecordBatch.from_arrays([pa.array(unique.view(np.int64)), pa.array(of), pa.array(np.bincount(codes))], ["hash", "class", "c"])

        for batch in batches:
            hashes, classes, _ = tokens(W.split(*W.texts(batch.column(0))))
            held.append((hashes, classes))
            size += len(hashes)
            if size >= at_once:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    rows = documents.select(F.col(text).alias("text")).mapInArrow(run, "hash bigint, class bigint, c bigint")
    return rows.groupBy("hash").agg(F.max("class").alias("class"), F.sum("c").alias("c"))


class Outputs(NamedTuple):
    """Hashes of the words that are outputs, sorted; output k of classes is ``len(words) + k``."""

    words: np.ndarray

    def size(self) -> int:
        return len(self.words) + CLASSES

    def of(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, hashes)
        found = np.zeros(len(hashes), bool)
        inside = at < len(self.words)
        found[inside] = self.words[at[inside]] == hashes[inside]
        return np.where(found, at, len(self.words) + classes)

    def contexts(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(context, output, hash, first) of all tokens; a context is a number made of the two outputs before."""
        hashes, classes, first = tokens(words)
        out = self.of(hashes, classes)
        before = np.full((2, len(out)), self.size())
        for k in (0, 1):
            before[k, k + 1:] = out[: max(0, len(out) - k - 1)]
            for shift in range(k + 1):
                start = first[:-1] + shift
                start = start[start < first[1:]]
                before[k, start] = self.size()
        return before[1] * (self.size() + 1) + before[0], out, hashes, first


class Model(NamedTuple):
    """Log-bilinear: vectors of contexts and outputs, a matrix for each place of the context, a bias."""

    given: np.ndarray
    near: np.ndarray
    far: np.ndarray
    wanted: np.ndarray
    bias: np.ndarray

    def scores(self, context: np.ndarray) -> np.ndarray:
        side = len(self.given)
        hidden = self.given[context // side] @ self.far + self.given[context % side] @ self.near
        return hidden @ self.wanted.T + self.bias

    def log_probabilities(self, context: np.ndarray) -> np.ndarray:
        """Of every output after each context; every row sums to one."""
        s = self.scores(context)
        s -= s.max(1, keepdims=True)
        return s - np.log(np.exp(s).sum(1, keepdims=True))


def context_counts(documents: DataFrame, outputs: Outputs, text: str = "text") -> pa.Table:
    """(code, n): how often each output follows each context, on the driver; bounded by outputs, not by the corpus."""
    m = outputs.size()
    W.arrow_batches(documents.sparkSession)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            context, out, _, _ = outputs.contexts(W.split(*W.texts(batch.column(0))))
            held.append(context * m + out)
            size += len(out)
            if size >= 1 << 21:
                code, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])
                held, size = [], 0
        if size:
            code, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    rows = documents.select(F.col(text).alias("text")).mapInArrow(run, "code bigint, n bigint")
    return rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()


def train(code: np.ndarray, n: np.ndarray, m: int, rounds: int = ROUNDS, rows_at_once: int = 4096) -> Model:
    """Noise-contrastive estimation: each true token against ``NOISE`` draws of the unigram, in expectation."""
    pick = np.random.default_rng(17)
    shapes = [(m + 1, SIZE), (SIZE, SIZE), (SIZE, SIZE), (m, SIZE)]
    parts = [pick.normal(0, 0.1, s).astype(np.float32) for s in shapes]
    parts[1] += np.eye(SIZE, dtype=np.float32)
    parts[2] += np.eye(SIZE, dtype=np.float32)
    if not len(code):
        return Model(*[np.zeros_like(p) for p in parts], np.zeros(m, np.float32))
    order = np.argsort(code)
    context, out, n = code[order] // m, code[order] % m, n[order].astype(np.float32)
    noise = np.bincount(out, n, m) + 0.5
    noise = (noise / noise.sum()).astype(np.float32)
    parts.append(np.log(noise))
    unique, first = np.unique(context, return_index=True)
    total, seen = n.sum(), np.add.reduceat(n, first)
    bounds = np.append(first, len(n))
    moments = [[np.zeros_like(p) for p in parts] for _ in (0, 1)]
    offset = np.log(NOISE * noise)
    for step in range(1, rounds + 1):
        grads, model = [np.zeros_like(p) for p in parts], Model(*parts)
        for a in range(0, len(unique), rows_at_once):
            b = min(a + rows_at_once, len(unique))
            rows = slice(bounds[a], bounds[b])
            left, right = unique[a:b] // (m + 1), unique[a:b] % (m + 1)
            far, near = model.given[left], model.given[right]
            hidden = far @ model.far + near @ model.near
            chance = 1 / (1 + np.exp(offset - (hidden @ model.wanted.T + model.bias)))
            slope = -seen[a:b, None] * NOISE * noise * chance
            at = (np.repeat(np.arange(b - a), np.diff(bounds[a: b + 1])), out[rows])
            slope[at] += n[rows] * (1 - chance[at])
            slope /= total
            back = slope @ model.wanted
            grads[1] += near.T @ back
            grads[2] += far.T @ back
            grads[3] += slope.T @ hidden
            grads[4] += slope.sum(0)
            np.add.at(grads[0], left, back @ model.far.T)
            np.add.at(grads[0], right, back @ model.near.T)
        for p, g, m1, m2 in zip(parts, grads, *moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += np.float32(RATE) * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + np.float32(1e-9))
    return Model(*parts)


class Trained(NamedTuple):
    """A model with what turns its outputs into tokens; ``counts`` is the table (hash, class, c) of all tokens."""

    outputs: Outputs
    model: Model
    counts: DataFrame
    n_tokens: int
    n_types: int
    class_log: np.ndarray
    frequent: tuple[np.ndarray, np.ndarray]
    complete: bool


def learn(documents: DataFrame, text: str = "text", frequent: int = FREQUENT) -> Trained:
    spark = documents.sparkSession
    path = shared_folder(spark, "token-counts")
    count_tokens(documents, text).write.parquet(path)
    counts = spark.read.parquet(path)
    n_tokens, n_types = (int(x or 0) for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    top = counts.orderBy(F.desc("c"), "hash").limit(WORDS).toPandas()
    outputs = Outputs(np.unique(np.append(top["hash"].to_numpy(np.int64).view(np.uint64), END)))
    words = [int(h) for h in outputs.words.view(np.int64)]
    of_class = counts.filter(~F.col("hash").isin(words)).groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    mass = np.full(CLASSES, 0.1)
    for row in of_class:
        mass[row["class"]] += row["c"] + 0.1 * row["n"]
    # the least count of which all tokens fit; as many rows as there are different counts
    sizes = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("c", ascending=False)
    fits = sizes[sizes["n"].cumsum() <= frequent]
    least = int(fits["c"].min()) if len(fits) else (1 << 62)
    table = counts.filter((F.col("c") >= least) | F.col("hash").isin(words)).select("hash", "c").toArrow()
    keys = table["hash"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    code = context_counts(documents, outputs, text)
    model = train(code["code"].to_numpy(), code["n"].to_numpy(), outputs.size())
    return Trained(outputs, model, counts, n_tokens, n_types, np.log10(mass), (keys[order], table["c"].to_numpy()[order]), len(keys) == n_types)


def score(documents: DataFrame, trained: Trained, text: str = "text") -> DataFrame:
    """Documents, less the text, with n_tokens, n_known, train_tokens, base_score and score, both log10."""
    spark = documents.sparkSession
    W.arrow_batches(spark)
    outputs, model, class_log = trained.outputs, trained.model, trained.class_log
    complete, below = trained.complete, np.log10(trained.n_tokens + 0.1 * (trained.n_types + 1))
    frequent = spark.sparkContext.broadcast(trained.frequent)
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rest = [c for c in documents.columns if c not in [*new, text]]
    columns = ["__row", "n_tokens", "n_known", "base", "model", "tail", "times"]

    def run(batch: pa.RecordBatch, words: W.Words):
        context, out, hashes, first = outputs.contexts(words)
        codes, unique = pd.factorize(hashes)
        keys, values = frequent.value
        at = np.minimum(np.searchsorted(keys, unique), max(len(keys) - 1, 0))
        known = keys[at] == unique if len(keys) else np.zeros(len(unique), bool)
        c = np.where(known, values[at], 0) if len(keys) else np.zeros(len(unique))
        settled = (known | complete)[codes]
        own = np.where(settled, np.log10(c + 0.1)[codes], 0.0)
        ctx, which = np.unique(context, return_inverse=True)
        log10 = np.empty(len(out))
        for a in range(0, len(ctx), 8192):
            rows = np.flatnonzero((which >= a) & (which < a + 8192)) if len(ctx) > 8192 else np.arange(len(which))
            log10[rows] = model.log_probabilities(ctx[a: a + 8192])[which[rows] - a, out[rows]] / np.log(10)
        in_class = out >= len(outputs.words)
        inner = np.where(in_class, own - class_log[np.maximum(out - len(outputs.words), 0)], 0.0)
        add = lambda v: np.add.reduceat(v, first[:-1])  # noqa: E731  every text has its end
        open_ = np.flatnonzero(~settled)
        ends = np.searchsorted(open_, first)
        tails, times = [], []
        for a, b in zip(ends, ends[1:]):
            h, n = np.unique(hashes[open_[a:b]].view(np.int64), return_counts=True)
            tails.append(h)
            times.append(n)
        yield pa.RecordBatch.from_arrays([
            *[batch.column(c) for c in rest], batch.column("__row"), pa.array(np.diff(first)), pa.array(add((c > 0)[codes].astype(np.int64))),
            pa.array(add(own - below)), pa.array(add(log10 + inner)), pa.array(tails, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())),
        ], [*rest, *columns])

    numbered = documents.select(*rest, F.col(text).alias("__text")).withColumn("__row", F.monotonically_increasing_id())
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in rest)
    path = shared_folder(spark, "scores")
    schema = f"{kinds}, __row bigint, n_tokens bigint, n_known bigint, base double, model double, tail array<bigint>, times array<bigint>"
    W.per_text(numbered, run, schema, "__text").write.parquet(path)
    scored = spark.read.parquet(path)
    rare = scored.filter(F.size("tail") > 0).select("__row", F.explode(F.arrays_zip("tail", "times")).alias("t"))
    rare = rare.select("__row", F.col("t.tail").alias("hash"), F.col("t.times").alias("k")).join(trained.counts.select("hash", "c"), "hash", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("__row").agg(F.sum(F.col("k") * F.log10(c + 0.1)).alias("__own"), F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("__known"))
    own, more = F.coalesce("__own", F.lit(0.0)), F.coalesce("__known", F.lit(0))
    return scored.join(sums, "__row", "left").select(
        *rest, "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(trained.n_tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + own).alias("base_score"), (F.col("model") + own).alias("score"),
    )


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    """The score of every text by a model of nine tenths of the documents, beside that of smoothed token counts."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    documents = documents.withColumn("held_out", held_out(F.col("doc_id"), 10, 0))
    return score(documents, learn(documents.filter(~F.col("held_out"))))
