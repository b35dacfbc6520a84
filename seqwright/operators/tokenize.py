"""Tokenizers as DataFrame operators: one row a token, in order, from one row a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WHITE = "[^ \\r\\n\\t]+"
#: Runs of punctuation and runs of everything else but blanks: disjoint classes, so first match is longest match.
WHITE_PUNCT = "[\\p{Punct}]+|[^ \\r\\n\\t\\p{Punct}]+"

#: Tags as one token, and runs of everything else but blanks.
WHITE_TAG = "<[^<>]+>|[^ \\r\\n\\t<]+|<"
#: Tokens after which a sequence ends in any case.
MOST_TOKENS = 4000
#: Ends of tokens that end a sentence.
SENTENCE_END = "[.?!]+[\"']*$"


def tokens(docs: DataFrame, pattern: str = WHITE, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos (from 0) and tok of every match of the pattern; null and empty texts have no rows."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("pos", "tok"))


def bounded(toks: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """``toks`` (doc_id, seq_id, pos) in sequences of ``most`` tokens or fewer: seq_id is numbered anew, pos counts from 0 in each."""
    order = Window.partitionBy("doc_id", "seq_id").orderBy("pos")
    rows = toks.withColumn("__place", F.row_number().over(order) - 1).withColumn("__part", F.floor(F.col("__place") / most))
    number = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("seq_id", "__part")) - 1
    return rows.withColumns({"seq_id": number.cast("int"), "pos": (F.col("__place") % most).cast("int")}).drop("__place", "__part")


def sentences(toks: DataFrame) -> DataFrame:
    """``toks`` with seq_id: a token of sentence-final marks, or one that ends in them, ends its sequence."""
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.when(F.col("tok").rlike(SENTENCE_END), 1).otherwise(0)
    return toks.withColumn("seq_id", F.coalesce(F.sum(ended).over(order), F.lit(0)).cast("int"))


def sentence_arrays(docs: DataFrame, most: int = MOST_TOKENS, pattern: str = WHITE) -> DataFrame:
    """doc_id, seq_id and toks: a row a sequence of :func:`bounded` over :func:`sentences` of the texts' tokens, without a window or a row a token.

    Texts of the same doc_id are taken together, their tokens by place, as :func:`sentences` orders them.
    """
    cut = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    places = lambda t: F.transform(cut(t), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    rows = docs.groupBy("doc_id").agg(F.collect_list("text").alias("__t"))
    toks = F.when(F.size("__t") == 1, cut(F.get("__t", F.lit(0)))).otherwise(F.array_sort(F.flatten(F.transform("__t", places)))["x"])
    rows = rows.select("doc_id", toks.alias("__t")).where(F.size("__t") > 0)
    n = F.size("__t")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i < n) & F.get("__t", i - 1).rlike(SENTENCE_END))
    rows = rows.select("doc_id", "__t", ends.alias("__e"))

    def parts(p: Column) -> Column:
        return F.transform(F.sequence(p["low"], p["high"] - 1, F.lit(most)), lambda s: F.slice("__t", s + 1, F.least(F.lit(most), p["high"] - s)))

    whole = F.arrays_zip(F.concat(F.array(F.lit(0)), "__e").alias("low"), F.concat("__e", F.array(n)).alias("high"))
    # outer, or Spark would make the arrays once more for whether they are empty
    return rows.select("doc_id", F.posexplode_outer(F.flatten(F.transform(whole, parts))).alias("seq_id", "toks"))
