"""Corpus preparation in stages; each reads what the stage before has kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lumenflow.llm import mixing, near_dedup, packing, quality_rules, store, suffix_dedup
from lumenflow.llm.queries import vocabulary
from lumenflow.llm.store import ready, saved

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Intermediate tables of the stage before; a stage starts when that one's rows have been written.
_left: list[str] = []


def stage(function: Stage) -> Stage:
    """Delete what the stage before has left behind, unless ``docs`` still reads it."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        store.delete(spark, _left, docs)
        before = len(store.made)
        result = function(spark, docs, sf_dir)
        _left[:] = store.made[before:]
        return result

    return run_stage


@stage
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


@stage
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8."""
    ready(spark)
    return near_dedup.dedup(docs)


@stage
def stripped_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return suffix_dedup.strip(docs)


@stage
def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@stage
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.packed(docs, packing.PackConfig(vocabulary("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", good_documents),
    ("near_dedup", distinct_documents),
    ("suffix_dedup", stripped_documents),
    ("mixing", mixed_documents),
    ("packing", packed_sequences),
]

#: Near-duplicate trees, suffix arrays and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs if k == 0 else saved(docs), sf_dir)
    return docs
