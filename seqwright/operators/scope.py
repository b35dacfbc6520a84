"""Cues and their scopes: tokens (doc_id, seq_id, pos, tok, attrs) whose attribute ``type`` marks a cue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwright.operators import convert


def cues(toks: DataFrame) -> DataFrame:
    """``toks`` with cue_type and cue_start of the sequence: those of its last token with a type; null without any."""
    whole = Window.partitionBy("doc_id", "seq_id")
    kind = F.try_element_at("attrs", F.lit("type"))
    last = F.max(F.when(kind.isNotNull(), F.struct(F.col("pos").alias("pos"), kind.alias("kind")))).over(whole)
    return toks.withColumn("__last", last).withColumns({"cue_type": F.col("__last.kind"), "cue_start": F.col("__last.pos")}).drop("__last")


def per_cue(toks: DataFrame) -> DataFrame:
    """A copy of each sequence for each of its cues (cue, its position), in which only that token keeps its type; sequences without one go."""
    marked = F.try_element_at("attrs", F.lit("type")).isNotNull()
    starts = toks.where(marked).select("doc_id", "seq_id", F.col("pos").alias("cue"))
    bare = F.map_filter("attrs", lambda k, _: k != "type")
    return toks.join(starts, ["doc_id", "seq_id"]).withColumn("attrs", F.when(F.col("pos") == F.col("cue"), F.col("attrs")).otherwise(bare))


def default_scopes(toks: DataFrame) -> DataFrame:
    """doc_id, seq_id, cue, cue_type, st and en (both inside) of the scope of each cue: from the cue to the end of its sequence."""
    kind = F.try_element_at("attrs", F.lit("type"))
    rows = toks.select("doc_id", "seq_id", "pos", kind.alias("cue_type"), F.max("pos").over(Window.partitionBy("doc_id", "seq_id")).alias("en"))
    return rows.where("cue_type IS NOT NULL").select("doc_id", "seq_id", F.col("pos").alias("cue"), "cue_type", F.col("pos").alias("st"), "en")


def index_lines(annots: DataFrame) -> DataFrame:
    """doc_id, seq_id, cue, kind and line of annotations (doc_id, seq_id, cue, st, en, cue_type; a null type is a scope) by numbers of sentence and tokens."""
    place = F.concat(F.lit('c="" '), F.concat_ws(" ", *[F.concat_ws(":", F.col("seq_id").cast("string"), F.col(c).cast("string")) for c in ("st", "en")]))
    own = F.col("cue").cast("string")
    cue = F.concat(place, F.lit('||t="cue"||sub_t="'), F.col("cue_type"), F.lit('" ref="'), own, F.lit('"'))
    scope = F.concat(place, F.lit('||t="xcope"||id="'), own, F.lit('"'))
    return annots.select("doc_id", "seq_id", "cue", F.when(F.col("cue_type").isNull(), "xcope").otherwise("cue").alias("kind"), F.coalesce(cue, scope).alias("line"))


def inline_scopes(docs: DataFrame, annots: DataFrame) -> DataFrame:
    """doc_id and text with annotations (doc_id, cue, st, en, cue_type; en outside, a null type is a scope) as ``<cue>`` and ``<xcope>`` elements; a scope is outside a cue of the same ends."""
    own, scoped = F.col("cue").cast("string"), F.col("cue_type").isNull()
    quoted = lambda name, value: F.concat(F.lit(f' {name}="'), value, F.lit('"'))
    fields = F.when(scoped, quoted("id", own)).otherwise(F.concat(quoted("type", F.col("cue_type")), quoted("ref", own)))
    tag, level = F.when(scoped, "xcope").otherwise("cue"), F.when(scoped, 0).otherwise(1)
    return convert.inline_text(docs, annots.select("doc_id", tag.alias("tag"), "st", "en", fields.alias("fields"), level.alias("level")))
