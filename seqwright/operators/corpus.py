"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def term_counts(toks: DataFrame) -> DataFrame:
    """tok, tf, df: counts are summed a document first, so a frequent token has a row a document in the shuffle and no more."""
    own = toks.groupBy("doc_id", "tok").agg(F.count("*").alias("n"))
    return own.groupBy("tok").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


def idf_table(toks: DataFrame, n_docs: int) -> DataFrame:
    """tok, tf, df, idf = log2(N / df) and ridf = idf + log2(1 - exp(-tf / N))."""
    idf = F.log2(F.lit(float(n_docs)) / F.col("df"))
    return term_counts(toks).select("tok", "tf", "df", idf.alias("idf"), (idf + F.log2(1 - F.exp(-F.col("tf") / F.lit(float(n_docs))))).alias("ridf"))


def scaled_table(table: DataFrame, value: str, least: float = 0.001) -> DataFrame:
    """tok and weight: ``value`` scaled by its extremes (0 among them) to 0..1, where it is above ``least``."""
    ends = table.agg(F.least(F.lit(0.0), F.min(value)).alias("low"), F.greatest(F.lit(0.0), F.max(value)).alias("high"))
    scaled = table.join(F.broadcast(ends)).select("tok", ((F.col(value) - F.col("low")) / (F.col("high") - F.col("low"))).alias("weight"))  # one row of extremes
    return scaled.where(F.col("weight") > least)


def bigrams(toks: DataFrame) -> DataFrame:
    """first, second and n of neighbours within documents: the histograms that word clustering starts from."""
    after = F.lead("tok").over(Window.partitionBy("doc_id").orderBy("pos"))
    return toks.select(F.col("tok").alias("first"), after.alias("second")).where("second IS NOT NULL").groupBy("first", "second").agg(F.count("*").alias("n"))


def mutual_information(features: DataFrame, labels: DataFrame) -> DataFrame:
    """feature, label, mi, n, n_label and npmi of each feature and label that occur together.

    mi, in bits, sums p(x, y) log2(p(x, y) / p(x) p(y)) over the labels y of the
    documents that have the feature x; n counts these. npmi is log2 p(x)p(y) /
    log2 p(x, y) - 1, which is -1 for the labels without a row and null where
    all documents have both. ``features`` has doc_id and feature, ``labels``
    doc_id and label. Labels without the feature add nothing, so only documents
    that have it are read.
    """
    total = labels.count()
    spread = labels.groupBy("label").agg(F.count("*").alias("n_y"))
    pairs = features.distinct().join(labels, "doc_id").groupBy("feature", "label").agg(F.count("*").alias("n_label"))
    n, joint, share = F.lit(float(total)), F.col("n_label") / total, F.col("n_y") / total
    feature = Window.partitionBy("feature")
    rows = pairs.join(spread, "label").withColumn("n", F.sum("n_label").over(feature))
    part = joint * F.log2(joint / (F.col("n") / n * share))
    npmi = F.try_divide(F.log2(F.col("n") / n * share), F.log2(joint)) - 1
    return rows.withColumns({"mi": F.sum(part).over(feature), "npmi": npmi}).select("feature", "label", "mi", "n", "n_label", "npmi")
