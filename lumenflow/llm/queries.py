"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenflow.llm import (
    collocations, language, lexical, line_dedup, mixing, near_dedup, ordinal, packing, quality_rules, suffix_dedup,
    token_counts, top_k, url_rules,
)
from lumenflow.llm.sql import ORACLE  # noqa: F401
from lumenflow.llm.store import numbered, ready

URL_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mixing_to_weights(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.copies(table(spark, folder, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


def language_crf(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"))))
    labelled = language.identify(docs, model)
    return labelled.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return near_dedup.classes(table(spark, folder, "documents"), near_dedup.NearConfig(width=4))


def packing_balanced(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    config = packing.PackConfig(vocabulary("word_bpe_49k.json"))
    pieces = packing.packed(table(spark, folder, "documents"), config)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    judged = url_rules.judge(pages, url_rules.rule_table(spark, URL_RULES))
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = suffix_dedup.cut(numbered(docs))
    return cut.select("row.id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256")).withColumnRenamed("id", "doc_id")


def quality_votes(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"), carry=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def token_totals(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    config = token_counts.CountConfig(vocabulary("byte_bpe_50k.tiktoken"))
    return token_counts.token_counts(table(spark, folder, "documents"), config)


def ratings(labels: DataFrame) -> DataFrame:
    """Grade 0 for toxic, 1 for low and 2 for good quality; unknown without both labels."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("toxic") == 0, F.when(F.col("quality") == 1, 2).otherwise(1))
    return labels.select("doc_id", F.when(F.col("quality").isNotNull(), grade).alias("grade"))


def quality_grades(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    docs = table(spark, folder, "documents")
    return ordinal.grade(docs, ordinal.train(docs, ratings(table(spark, folder, "labels"))))


def inner_product_top_k(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return top_k.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return collocations.collocations(table(spark, folder, "documents"))


def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    cut = line_dedup.with_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    ready(spark)
    return lexical.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing_to_weights,
    "op2_language_id": language_crf,
    "op3_near_dedup": near_copies,
    "op4_packing": packing_balanced,
    "op5_url_filters": url_filter,
    "op6_suffix_dedup": repeated_strings,
    "op7_quality_rules": quality_votes,
    "op8_token_counts": token_totals,
    "op9_quality_classifier": quality_grades,
    "op10_top_k": inner_product_top_k,
    "op11_collocations": phrase_collocations,
    "op12_line_dedup": repeated_lines,
    "op13_lexical_search": lexical_search,
}
