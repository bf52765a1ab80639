"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

TOKENIZER = "word_bpe_49k.json"
#: Distinct sites from which on a line is boilerplate.
BOILERPLATE_SITES = 10


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import train, verdicts

    docs = table(spark, sf_dir, "documents")
    return verdicts(docs, train(docs, table(spark, sf_dir, "labels")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import store_digests

    return store_digests(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1, words_apart=True)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_classes

    return near_classes(table(spark, sf_dir, "documents"), size=2)


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import token_digests

    return token_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), separator=49407, words_apart=True)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_report

    return line_report(table(spark, sf_dir, "documents"), BOILERPLATE_SITES)


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_quality import line_quality

    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import importance_report

    return importance_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair_report

    return repair_report(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k == "pipeline" or k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    from . import conversations, importance, line_dedup

    return {"op10_line_dedup": line_dedup.report_sql(BOILERPLATE_SITES), "op12_importance_resampling": importance.report_sql(), "op13_conversation_repair": conversations.report_sql()}
