"""Combinators of the feature language as window expressions over a token table (doc_id, seq_id, pos, tok)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def sequence() -> WindowSpec:
    return Window.partitionBy("doc_id", "seq_id").orderBy("pos")


def at(value: Column, offset: int) -> Column:
    """``value`` of the token ``offset`` places on; null beyond the sequence."""
    return F.lead(value, offset).over(sequence()) if offset >= 0 else F.lag(value, -offset).over(sequence())


def over(value: Column, offsets: list[int]) -> Column:
    """The values at the offsets, each tagged with its own; those beyond the sequence are left out."""
    return F.filter(F.array(*[F.concat(F.lit(f"{o}@"), at(value, o)) for o in offsets]), lambda x: x.isNotNull())


def within(value: Column, offsets: list[int]) -> Column:
    """The distinct values at the offsets, in order, without telling which."""
    return F.array_sort(F.array_distinct(F.filter(F.array(*[at(value, o) for o in offsets]), lambda x: x.isNotNull())))


def ngram(value: Column, offsets: list[int], *, whole: bool = False) -> Column:
    """One conjunction of the values at the offsets; START stands before a sequence, END after it, nothing farther out.

    With ``whole``, it is null if a token at an offset has no value.
    """
    parts = []
    for o in offsets:
        edge = at(F.lit(1), o - 1) if o > 0 else at(F.lit(1), o + 1) if o < 0 else F.lit(1)
        parts.append(F.coalesce(at(value, o), F.when(edge.isNotNull(), F.lit("END" if o > 0 else "START"))))
    joined = F.concat_ws("^", *parts)
    if not whole:
        return joined
    lacking = [at(F.lit(1), o).isNotNull() & at(value, o).isNull() for o in offsets]
    return F.when(~reduce(or_, lacking), joined)


def cross(left: Column, right: Column) -> Column:
    """All conjunctions of a value of one array with a value of the other."""
    return F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, F.lit("&"), b))))


def displaced(toks: DataFrame, value: Column) -> DataFrame:
    """``toks`` with ``earlier``: the distinct values that earlier occurrences of the same token in the document had."""
    same = Window.partitionBy("doc_id", "tok").orderBy("seq_id", "pos").rowsBetween(Window.unboundedPreceding, -1)
    return toks.withColumn("earlier", F.array_sort(F.collect_set(value).over(same)))


def binned(d: Column) -> Column:
    return F.when(d <= 5, d).when(d <= 7, 7).when(d <= 9, 9).when(d <= 12, 12).otherwise(13)


def nearest_in(marks: Column, backward: Column, pos: Column) -> tuple[Column, Column]:
    """left and right of :func:`nearest` for the token at ``pos`` of a sequence whose marks are an array, given ``backward`` too: what lies more than 12 places off is all one."""
    before = F.array_position(F.slice(backward, F.size(backward) - pos + 1, 12), True)
    after = F.array_position(F.slice(marks, pos + 2, 12), True)
    left = F.when(before > 0, before).otherwise(F.least(pos, F.lit(13)))
    right = F.when(after > 0, after).otherwise(F.least(F.size(marks) - 1 - pos, F.lit(13)))
    return binned(left.cast("int")), binned(right.cast("int"))


def nearest(toks: DataFrame, is_mark: Column) -> DataFrame:
    """``toks`` with left and right: binned distance to the nearest other marked token on either side, or to the sequence's edge.

    Bins: 0 to 5 as they are, then 7, 9, 12 and 13 for more.
    """
    whole = sequence().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.last(F.when(is_mark, F.col("pos")), True).over(sequence().rowsBetween(Window.unboundedPreceding, -1))
    # backward, as a frame that ends with the sequence is read anew for every token
    backward = Window.partitionBy("doc_id", "seq_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    after = F.last(F.when(is_mark, F.col("pos")), True).over(backward)
    left = F.col("pos") - F.coalesce(before, F.min("pos").over(whole))
    right = F.coalesce(after, F.max("pos").over(whole)) - F.col("pos")
    return toks.withColumns({"left": binned(left), "right": binned(right)})
