"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import (
    op01_token_counts,
    op02_quality,
    op03_language,
    op04_mix,
    op05_similar,
    op06_language_model,
    op07_token_files,
    op08_decontaminate,
    op09_licenses,
    op10_personal,
    op11_variants,
    op12_shards,
    op13_phrases,
)
from quire.session import prepare

Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(prepare(spark), sf_dir)

    return run


QUERIES: dict[str, Query] = {
    name: _prepared(query)
    for name, query in {
        "op1_token_counts": op01_token_counts.op1_token_counts,
        "op2_quality": op02_quality.op2_quality,
        "op3_language": op03_language.op3_language,
        "op4_mix": op04_mix.op4_mix,
        "op5_similar": op05_similar.op5_similar,
        "op6_language_model": op06_language_model.op6_language_model,
        "op7_token_files": op07_token_files.op7_token_files,
        "op8_decontaminate": op08_decontaminate.op8_decontaminate,
        "op9_licenses": op09_licenses.op9_licenses,
        "op10_personal": op10_personal.op10_personal,
        "op11_variants": op11_variants.op11_variants,
        "op12_shards": op12_shards.op12_shards,
        "op13_phrases": op13_phrases.op13_phrases,
    }.items()
}

ORACLES: dict[str, str] = {
    name: textwrap.dedent(sql).strip()
    for name, sql in {
        "op2_quality": op02_quality.SQL,
        "op4_mix": op04_mix.SQL,
        "op8_decontaminate": op08_decontaminate.SQL,
        "op11_variants": op11_variants.SQL,
        "op13_phrases": op13_phrases.SQL,
    }.items()
}
