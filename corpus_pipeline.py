"""A corpus pipeline over the training-text operators: from raw documents to token ids.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before
it left and returns the columns of documents; the last returns token ids. Between
stages the rows are written as Parquet to the cluster's shared folder and read
again, so a lost executor costs one stage's tasks at most.

Nulls: null texts count as empty and fail the length rule of the first stage, a
null id takes no part in near-duplicate links, a null source is a source. Empty
tables give empty results. Further columns are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm import bpe, jaccard, mixing, quality, repeats
from seqwright.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are good with a posterior probability of one half or more."""
    return quality.keep_good(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by 5-word shingles at 0.8."""
    return jaccard.one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without strings of 200 bytes that occur elsewhere."""
    return repeats.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once a pass, cut where a source's target ends."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian uint32) of each row."""
    return bpe.encode(docs).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]
#: Expectation maximisation and hash shuffles have no SQL for DuckDB; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
