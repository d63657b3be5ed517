"""Corpus pipeline: the stages one after another, each written as Parquet and read again as the next one's documents.

The first four stages return the columns of ``documents`` and the rows that stay; the last returns the rows with their tokens.
Rows keep their other columns, whatever their names. Null and empty texts are judged like any other text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pressmill.llm.blocks import tune
from pressmill.llm.bpe import round_trip
from pressmill.llm.exact import exact_dedup
from pressmill.llm.leaks import decontaminate
from pressmill.llm.near import near_dedup
from pressmill.llm.quality import fit, keep_good
from pressmill.session import prepare, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labels of ids whose crc32 modulo 4 is not 2."""
    tune(prepare(spark))
    labels = _table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    return keep_good(docs, fit(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts the row with the largest doc_id stays."""
    tune(prepare(spark))
    return exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    tune(prepare(spark))
    return near_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a test item go."""
    tune(prepare(spark))
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their characters. A text whose decoded bytes are not the text itself stops the job."""
    tune(prepare(spark))
    coded = round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), columns=("ids", "starts", "ends", "exact"))
    wrong = F.raise_error(F.concat(F.lit("tokens do not decode to the text of document "), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends",
        F.when(F.col("exact"), F.col("exact")).otherwise(wrong.cast("boolean")).alias("round_trip"))


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("tokens", tokens_stage),
]

#: A classifier, sketches and alignments have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
