"""Documents to training sequences: toxic documents go, one document of each group of near copies stays, repeated passages and
documents with benchmark items go, the rest is packed.

Each stage reads what its predecessor kept, from Parquet in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontamination, jaccard_join, packing, suffix_dedup, toxicity
from factloom.llm.common import cut


def _not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.first_of_each(docs)


def _without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.clean(docs)


def _without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _not_toxic),
    ("near_copies", _one_of_near_copies),
    ("repeats", _without_repeats),
    ("decontamination", _without_leaks),
    ("packing", _packed),
]

#: The stages learn, sort and tokenize; SQL can't express them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the packed documents. Rows without an id or a text go through all stages (an empty text is its end token alone), rows
    that repeat count as copies where they have ids, columns of any name come through up to the last stage; an empty table gives no rows.
    """
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        rows = cut(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
