"""Dictionary operators: exact lookup joins. Whether a dictionary is broadcast is left to its measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lexicon(entries: DataFrame) -> DataFrame:
    """lex_name, term of every whitespace-separated word of the entries (lex_name, entry)."""
    words = F.explode(F.regexp_extract_all("entry", F.lit("\\S+"), F.lit(0)))
    return entries.select("lex_name", words.alias("term")).distinct()


def lexicon_tags(toks: DataFrame, lex: DataFrame, *, lower: bool = False) -> DataFrame:
    """``toks`` (doc_id, pos, tok) with the sorted names of the lexicons that hold each token; no row is lost."""
    names = lex.groupBy("term").agg(F.array_sort(F.collect_set("lex_name")).alias("lexicons"))
    key = F.lower("tok") if lower else F.col("tok")
    found = toks.withColumn("__key", key).join(names, F.col("__key") == F.col("term"), "left")
    return found.withColumn("lexicons", F.coalesce("lexicons", F.array().cast("array<string>"))).drop("__key", "term")


def scores(toks: DataFrame, table: DataFrame) -> DataFrame:
    """``toks`` with the score that the table (word, score) has for each token, or null."""
    return toks.join(table.select(F.col("word").alias("tok"), "score"), "tok", "left")
