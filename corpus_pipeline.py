"""Corpus pipeline: quality rules, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and
reads it back as the next stage's documents.  All but the last return the columns of documents, n_chars following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxspan.llm import bpe, common, decontamination, line_dedup, near_dedup, quality, registry

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL can express the trees of the first stage.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    forest = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs.select(COLUMNS), forest)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; a document that consists of nothing else keeps an empty text."""
    out = line_dedup.without_boilerplate(docs.select(COLUMNS), registry.BOILERPLATE_SITES)
    return out.select("doc_id", F.col("_kept").alias("text"), "lang", "source", F.when(F.col("_removed") > 0, F.length("_kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    return near_dedup.one_of_each(docs.select(COLUMNS))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are mostly such passages go."""
    return decontamination.clean_rows(docs.select(COLUMNS), common.table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a check that they decode to what the encoder read."""
    return bpe.token_digests(docs, registry.tokenizer_path())


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("tokens", token_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = common.folder(spark)
        with common.temporary():  # a stage's own tables go when its result is stored
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        docs._shared_path = path
        if last is not None:
            common.discard(last)
        last = docs
    return docs
