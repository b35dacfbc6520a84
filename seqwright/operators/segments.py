"""Segments of a few tokens: candidates, their features, and the sizes that labels give.

Tokens have doc_id, seq_id, pos and tok, and attrs (name -> value) where attribute
features are asked for. ``s`` is a segment's number of tokens less one; a segment
is named by its last position. Null tokens count as empty, null attrs as none;
an empty table has no segments; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwright.operators.context import sequence
from seqwright.operators.evaluate import OUTSIDE


def candidates(toks: DataFrame, longest: int, *kept: str) -> DataFrame:
    """doc_id, seq_id, pos, s, words and attrs (arrays, in order) of every segment of up to ``longest`` tokens, and ``kept`` columns of its last token.

    One window gathers the last ``longest`` tokens; the segments are its tails.
    """
    attrs = F.col("attrs") if "attrs" in toks.columns else F.create_map().cast("map<string,string>")
    one = F.struct(F.coalesce("tok", F.lit("")).alias("w"), attrs.alias("a"))
    rows = toks.select("doc_id", "seq_id", "pos", *kept, F.collect_list(one).over(sequence().rowsBetween(1 - longest, 0)).alias("__t"))
    rows = rows.select("doc_id", "seq_id", "pos", *kept, "__t", F.explode(F.sequence(F.lit(0), F.size("__t") - 1)).alias("s"))
    tail = F.slice("__t", F.size("__t") - F.col("s"), F.col("s") + 1)
    return rows.select("doc_id", "seq_id", "pos", "s", tail["w"].alias("words"), tail["a"].alias("attrs"), *kept)


def array_candidates(sequences: DataFrame, longest: int) -> DataFrame:
    """doc_id, seq_id, pos, s, words and values (arrays, in order) of every segment of up to ``longest`` tokens of sequences (doc_id, seq_id, toks, values: of each token one), a row each.

    No window: segments are slices of their sequence. Tokens and values are not null.
    """
    # outer, or Spark would make the arrays once more for whether they are empty
    rows = sequences.select("doc_id", "seq_id", "toks", "values", F.posexplode_outer("toks").alias("pos", "__t")).where("pos IS NOT NULL")
    rows = rows.select("doc_id", "seq_id", "toks", "values", "pos", F.explode_outer(F.sequence(F.lit(0), F.least(F.col("pos"), F.lit(longest - 1)))).alias("s"))
    part = lambda c: F.slice(c, F.col("pos") - F.col("s") + 1, F.col("s") + 1).alias("words" if c == "toks" else c)
    return rows.select("doc_id", "seq_id", "pos", "s", part("toks"), part("values"))


def value_phrase(values: Column) -> Column:
    """:func:`attribute_phrase` of tokens that have one value each."""
    return F.concat(F.lit("attrs=_"), F.array_join(F.reverse(values), "_"))


def size_name(s: Column, *, edge: bool = False) -> Column:
    """The state or edge feature of a segment's size."""
    return F.concat(F.lit(":E::" if edge else ":U::"), s.cast("string"))


def phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def attribute_phrase(attrs: Column, prefix: str) -> Column:
    """``attrs=`` and, from the last token to the first, ``_`` with the values of the attributes whose name has the prefix."""
    own = lambda a: F.map_values(F.map_filter(F.coalesce(a, F.create_map().cast("map<string,string>")), lambda k, _: k.startswith(prefix)))
    return F.concat(F.lit("attrs="), F.array_join(F.transform(F.reverse(attrs), lambda a: F.concat(F.lit("_"), F.array_join(own(a), ""))), ""))


def labelled(sized: DataFrame, longest: int, *kept: str) -> DataFrame:
    """:func:`candidates` with the label of those that the labels of :func:`label_sizes` show, else null: each token ends one of them at most, so nothing is joined."""
    found = candidates(sized.withColumnRenamed("s", "__shown"), longest, "__shown", "label", *kept)
    return found.withColumn("label", F.when(F.col("__shown") == F.col("s"), F.col("label"))).drop("__shown")


def phrase_lexicon(segments: DataFrame, lex: DataFrame) -> DataFrame:
    """``segments`` with names: the lexicons (lex_name, entry) that have the phrase, sorted, or else the phrase."""
    names = lex.groupBy(F.col("entry").alias("__entry")).agg(F.array_sort(F.collect_set("lex_name")).alias("names"))
    found = segments.withColumn("__phrase", phrase(F.col("words"))).join(names, F.col("__phrase") == F.col("__entry"), "left")
    return found.withColumn("names", F.coalesce("names", F.array("__phrase"))).drop("__phrase", "__entry")


def label_sizes(toks: DataFrame) -> DataFrame:
    """``toks`` (label, begin) with s: that of the labelled segment that ends here, and -1 inside of one."""
    whole = sequence().rowsBetween(Window.unboundedPreceding, 0)
    came = F.coalesce(F.last(F.when(F.col("begin"), F.col("pos")), True).over(whole), F.min("pos").over(whole))
    goes_on = ~F.coalesce(F.lead("begin").over(sequence()), F.lit(True)) & (F.col("label") != OUTSIDE)
    return toks.withColumn("s", F.when(goes_on, -1).otherwise(F.col("pos") - came).cast("int"))


def shown(toks: DataFrame, longest: int) -> DataFrame:
    """What :func:`supported` keeps of :func:`candidates`, with the label, from tokens with label and begin: each token ends one segment at most, so one window finds it and nothing is joined."""
    attrs = F.col("attrs") if "attrs" in toks.columns else F.create_map().cast("map<string,string>")
    one = F.struct(F.coalesce("tok", F.lit("")).alias("w"), attrs.alias("a"))
    rows = label_sizes(toks).withColumn("__t", F.collect_list(one).over(sequence().rowsBetween(1 - longest, 0)))
    rows = rows.where((F.col("s") >= 0) & (F.col("s") < F.size("__t")))
    tail = F.slice("__t", F.size("__t") - F.col("s"), F.col("s") + 1)
    return rows.select("doc_id", "seq_id", "pos", "s", tail["w"].alias("words"), tail["a"].alias("attrs"), "label")


def supported(segments: DataFrame, sized: DataFrame) -> DataFrame:
    """``segments`` that the labels of :func:`label_sizes` show, with the label."""
    return segments.join(sized.where("s >= 0").select("doc_id", "seq_id", "pos", "s", "label"), ["doc_id", "seq_id", "pos", "s"])
