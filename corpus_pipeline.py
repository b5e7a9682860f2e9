"""From raw documents to token files: the stages in order, each on what the one before it kept.

Every stage but the last returns the columns of its input. A null text counts as empty; texts are judged whole, however
long; rows repeated under one id are rows of their own; a column named like one of a stage's own comes through unchanged; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import op03_language, op04_mix, op05_similar, op07_token_files, op08_decontaminate
from quire.session import prepare, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Least share of a text that its main language must have; texts in two or three languages are kept.
MIN_SHARE = 1 / 3
VOCABULARY = "word_bpe_49k.json"


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or without one that has a third of the text, go; labels among the documents teach it.

    A null text, or one without a letter, has no language and goes.
    """
    prepare(spark)
    aside = {c: f"__{c}" for c in docs.columns if c in op03_language.RESULT}
    found = op03_language.identify(docs.withColumnsRenamed(aside), *op03_language.learn(docs))
    good = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SHARE)).drop(*op03_language.RESULT)
    return good.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with similar shingles, and of equal ones, one stays.

    Texts without words resemble nothing and stay; of equal choices the smallest id stays.
    """
    prepare(spark)
    return op05_similar.one_of_each(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; those without words stay."""
    prepare(spark)
    return op08_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources ask for; a text without words has size 0 and is not taken."""
    prepare(spark)
    return op04_mix.mix(docs)


def as_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Files of token ids, and from them the place, number and checksum of every document's ids.

    A null or empty text has the end id alone; of rows with one id the shorter comes first.
    """
    import public_tokenizers

    prepare(spark)
    path = op07_token_files.write_tokens(docs, shared_folder(spark, "tokens"), public_tokenizers.path(VOCABULARY))
    return op07_token_files.read_tokens(spark, path, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", in_a_language),
    ("ngram_jaccard_join", one_of_each),
    ("benchmark_decontamination", clean_of_benchmarks),
    ("mixing_sources", mixed),
    ("token_files", as_token_files),
]
# the first stage is a trained model and the last one a tokenizer; tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again as the next one's input."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark, "pipeline")
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
