"""Reading tables and column clean-up for the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words that all operators count.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 0 modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def chosen(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our names, so that further or clashing columns of the input play no part."""
    return df.select(*[F.col(f"`{c}`").alias(own) for own, c in columns.items()])
