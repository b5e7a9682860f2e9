"""Language identification as a mixture: expectation-maximisation over character trigrams.

Trigrams of lower-cased text, every non-letter being a space, are hashed into buckets; a language is a distribution over
buckets, counted from all labelled texts. A document's proportions of languages follow from expectation-maximisation,
and the set of languages from likelihood less a penalty for each language: sets are the k largest proportions, refitted,
for every k. The prediction is the largest proportion of the chosen set, the score is that proportion.

Edge cases: null and letterless texts are ``und`` with score 0 and no languages; so is every text where nothing is
labelled; ties go to the language first by code point; repeated rows are predicted alike and each counts in training;
an empty table gives no rows. Other columns are kept; names that clash with result columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm import words as W

BITS = 16
SMOOTHING = 0.5
ROUNDS = 12
#: Gain in log-likelihood, in units of log(1 + trigrams), that a further language must bring.
PENALTY = 4.0
RESULT = ["lang_pred", "score", "langs"]


class Trigrams:
    """Buckets of the trigrams of many texts, in order, with the text that each is in."""

    def __init__(self):
        self.letter = np.zeros(0x110000, bool)
        self.letter[:0x3100] = [chr(c).isalpha() for c in range(0x3100)]
        self.asked = np.zeros(0x110000, bool)
        self.asked[:0x3100] = True

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        lowered = [(t or "").lower() for t in texts]
        codes = np.frombuffer(" ".join(["", *lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
        unknown = codes[~self.asked[codes]]
        for c in np.unique(unknown):
            self.letter[c], self.asked[c] = chr(c).isalpha(), True
        is_letter = self.letter[codes]
        clean = np.where(is_letter, codes, 32).astype(np.uint64)
        at = np.flatnonzero(is_letter[1:-1])  # a letter in the middle
        mixed = W.mixed((clean[at] << np.uint64(42)) ^ (clean[at + 1] << np.uint64(21)) ^ clean[at + 2])
        ends = np.cumsum([len(t) + 1 for t in lowered])
        return (mixed >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(ends, at + 1, "right")


def learn(documents: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """(languages, likelihoods): one row of ``2**BITS`` likelihoods for each language that labels a text.

    The counts are summed by Spark; what comes to the driver is bounded by languages times buckets.
    """
    labelled = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    W.arrow_batches(documents.sparkSession)

    def count(batches):
        trigrams, totals = Trigrams(), {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            bucket, of = trigrams(batch.column(1).to_pylist())
            code = langs.indices.to_numpy()[of]
            for k, name in enumerate(langs.dictionary.to_pylist()):
                totals[name] = totals.get(name, 0) + np.bincount(bucket[code == k], minlength=1 << BITS)
        for name, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = labelled.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()), key=lambda s: s.encode())
    table = np.full((len(names), 1 << BITS), SMOOTHING)
    row = np.array([names.index(n) for n in rows["lang"].to_pylist()], np.int64)
    table[row, rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return names, table / table.sum(1, keepdims=True) if names else table


def fit(likelihood: np.ndarray, count: np.ndarray, first: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log-likelihoods) of groups of rows, ``first`` being where each begins, after rounds of EM."""
    sizes = np.diff(np.append(first, len(count)))
    total = np.add.reduceat(count, first)
    for _ in range(rounds):
        part = likelihood * np.repeat(shares, sizes, 0)
        part *= (count / part.sum(1))[:, None]
        shares = np.add.reduceat(part, first) / total[:, None]
    of_row = np.einsum("ij,ij->i", likelihood, np.repeat(shares, sizes, 0))
    return shares, np.add.reduceat(count * np.log(of_row), first)


def mixtures(bucket: np.ndarray, of: np.ndarray, model: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray]:
    """(texts, shares): the texts that have trigrams, and their chosen shares of each language."""
    key, count = np.unique(of * (1 << BITS) + bucket, return_counts=True)
    text, first = np.unique(key >> BITS, return_index=True)
    n_langs, count = len(model), count.astype(np.float64)
    likelihood = model[:, key & ((1 << BITS) - 1)].T
    likelihood = likelihood / likelihood.max(1, keepdims=True)
    sizes = np.diff(np.append(first, len(key)))
    full, _ = fit(likelihood, count, first, np.full((len(text), n_langs), 1 / n_langs), ROUNDS)
    alone = np.add.reduceat(count[:, None] * np.log(likelihood), first)
    best = np.argmax(alone, 1)
    shares, value = np.eye(n_langs)[best], alone.max(1)
    order = np.argsort(-full, 1, kind="stable")
    price = penalty * np.log1p(np.add.reduceat(count, first))
    # a set of k languages can gain only where k shares are not all but nothing
    for k in range(2, n_langs + 1):
        open_ = np.flatnonzero(full[np.arange(len(text)), order[:, k - 1]] > 1e-3)
        if not len(open_):
            break
        rows = np.flatnonzero(np.isin(np.repeat(np.arange(len(text)), sizes), open_))
        start = np.cumsum(sizes[open_]) - sizes[open_]
        chosen = np.zeros((len(open_), n_langs))
        np.put_along_axis(chosen, order[open_, :k], np.take_along_axis(full[open_], order[open_, :k], 1), 1)
        chosen = np.maximum(chosen, 1e-300 * (chosen > 0))
        found, ll = fit(likelihood[rows], count[rows], start, chosen / chosen.sum(1, keepdims=True), 3)
        ll = ll - (k - 1) * price[open_]
        better = ll > value[open_]
        shares[open_[better]], value[open_[better]] = found[better], ll[better]
    return text, shares


def identify(documents: DataFrame, names: list[str], model: np.ndarray, text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Documents with lang_pred, score and langs (the chosen set, largest share first)."""
    spark = documents.sparkSession
    W.arrow_batches(spark)
    kept = documents.select(*[c for c in documents.columns if c not in RESULT])
    place, sent = kept.columns.index(text), spark.sparkContext.broadcast(model)

    def predict(batches):
        trigrams = Trigrams()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            pred, score, langs = ["und"] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            bucket, of = trigrams(texts)
            if len(bucket) and names:
                for t, row in zip(*mixtures(bucket, of, sent.value, penalty)):
                    at = int(np.argmax(row))
                    pred[t], score[t] = names[at], min(1.0, float(row[at]))
                    langs[t] = [names[k] for k in np.argsort(-row, kind="stable") if row[k] > 1e-3]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score), pa.array(langs, pa.list_(pa.string()))], [*batch.schema.names, *RESULT])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(predict, f"{schema}, lang_pred string, score double, langs array<string>")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document is kept from training; one without id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def op3_language(spark, sf_dir: str) -> DataFrame:
    """The language of every text, learnt from the labelled texts of three quarters of the ids."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    names, model = learn(documents.filter(~F.col("held_out")))
    return identify(documents.select("doc_id", "held_out", "text"), names, model).select("doc_id", "held_out", "lang_pred", "score")
