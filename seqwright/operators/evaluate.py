"""Evaluation: spans from labels, precision and recall, confusion, folds."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTSIDE = "lex"


def spans(toks: DataFrame, label: str = "label") -> DataFrame:
    """doc_id, seq_id, label, st and en (positions, both inside) of each run of a label other than the outside one.

    A new span starts where the label changes or at a ``B:`` label.
    """
    order = Window.partitionBy("doc_id", "seq_id").orderBy("pos")
    bare = F.regexp_replace(F.col(label), "^B:", "")
    start = F.when((F.lag(bare).over(order) != bare) | F.lag(bare).over(order).isNull() | F.col(label).startswith("B:"), 1).otherwise(0)
    marked = toks.select("doc_id", "seq_id", "pos", bare.alias("label"), F.sum(start).over(order).alias("run"))
    found = marked.where(F.col("label") != OUTSIDE).groupBy("doc_id", "seq_id", "run", "label").agg(F.min("pos").alias("st"), F.max("pos").alias("en"))
    return found.drop("run")


def span_scores(gold: DataFrame, system: DataFrame) -> DataFrame:
    """label (``TOTAL`` for all), precision, recall and f1 of system spans; labels that gold lacks don't count."""
    key = ["doc_id", "seq_id", "label", "st", "en"]
    g, s = (own.select(*key, F.lit(n).alias("g"), F.lit(1 - n).alias("s")) for own, n in ((gold, 1), (system, 0)))
    both = g.union(s).groupBy(*key).agg(F.max("g").alias("g"), F.max("s").alias("s"))
    known = both.groupBy("label").agg(F.sum("g").alias("g"), F.sum("s").alias("s"), F.sum(F.col("g") * F.col("s")).alias("both")).where("label IS NOT NULL AND g > 0")
    counts = known.rollup("label").agg(F.sum("g").alias("gold"), F.sum("s").alias("system"), F.sum("both").alias("shared"))
    shared = F.coalesce("shared", F.lit(0))
    p, r = shared / F.when(F.col("system") > 0, F.col("system")), shared / F.when(F.col("gold") > 0, F.col("gold"))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return counts.select(F.coalesce("label", F.lit("TOTAL")).alias("label"), p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"))


def confusion(rows: DataFrame, system: str, gold: str) -> DataFrame:
    """system, gold, n."""
    return rows.groupBy(F.col(system).alias("system"), F.col(gold).alias("gold")).agg(F.count("*").alias("n"))


def label_scores(cells: DataFrame) -> DataFrame:
    """label, precision, recall from the cells of :func:`confusion`."""
    right = F.sum(F.when(F.col("system") == F.col("gold"), F.col("n")).otherwise(0))
    p = cells.groupBy(F.col("system").alias("label")).agg((right / F.sum("n")).alias("precision"))
    r = cells.groupBy(F.col("gold").alias("label")).agg((right / F.sum("n")).alias("recall"))
    return p.join(r, "label", "full")


def placed(rows: DataFrame, key: str, *ties: str, descending: bool = False) -> DataFrame:
    """``rows`` with place, from 0, in the order of a number ``key``, then ``ties``; null keys come first, or last if descending.

    Ranks are counted in ranges of the key and added up over the ranges, so no
    task orders all rows unless they share a key.
    """
    marked = rows.withColumn("__key", -F.col(key) if descending else F.col(key))
    cuts = marked.approxQuantile("__key", [i / 64 for i in range(1, 64)], 0.01) if rows.count() > 64_000 else []
    part = sum((F.when(F.col("__key") >= c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    part = F.when(F.col("__key").isNull(), 64 if descending else -1).otherwise(part)
    marked = marked.withColumn("__part", part)
    sizes = marked.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__first"))  # 65 rows at most
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__key", *ties)) - 1
    found = marked.withColumn("__place", inside).join(F.broadcast(starts), "__part")  # 65 rows at most
    return found.withColumn("place", F.col("__first") + F.col("__place")).drop("__part", "__place", "__first", "__key")


def folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """``rows`` with fold: contiguous runs of ceil(n / k) rows by ``key``."""
    size = max(1, -(-rows.count() // k))
    return placed(rows, key).withColumn("fold", F.floor(F.col("place") / size).cast("int")).drop("place")


def token_accuracy(rows: DataFrame, system: str, gold: str) -> DataFrame:
    """n, n_right and accuracy."""
    right = F.sum(F.when(F.col(system).eqNullSafe(F.col(gold)), 1).otherwise(0))
    return rows.agg(F.count("*").alias("n"), right.alias("n_right"), (right / F.when(F.count("*") > 0, F.count("*"))).alias("accuracy"))


def cross_entropy(rows: DataFrame, gold: str, model: str) -> DataFrame:
    """cross_entropy: -sum p ln q over all rows' arrays of probabilities of the classes; p counts as 1e-200 at least."""
    one = F.aggregate(F.arrays_zip(F.col(gold).alias("p"), F.col(model).alias("q")), F.lit(0.0), lambda a, x: a - F.greatest(x["p"], F.lit(1e-200)) * F.ln(x["q"]))
    return rows.agg(F.sum(one).alias("cross_entropy"))


def validated(rows: DataFrame, key: str, k: int, train: Callable[[DataFrame], object], decode: Callable[[DataFrame, object], DataFrame]) -> DataFrame:
    """What ``decode`` gives for each of ``k`` folds under the model that ``train`` makes of the others, with the fold."""
    dealt = folds(rows, key, k)
    parts = [decode(dealt.where(F.col("fold") == i), train(dealt.where(F.col("fold") != i))).withColumn("fold", F.lit(i)) for i in range(k)]
    return functools.reduce(DataFrame.unionByName, parts)


def entropy(p: Column) -> Column:
    """-sum p log2 p of an array of probabilities."""
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log2(x)).otherwise(0.0))
