"""Line formats as columns of text: what the readers read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def posterior_line(probs: Column, comment: Column | None = None) -> Column:
    """``class:probability`` fields of a map in the order of the classes, then ``#comment`` if there is one."""
    fields = F.transform(F.array_sort(F.map_keys(probs)), lambda k: F.concat(k, F.lit(":"), F.element_at(probs, k).cast("string")))
    return F.concat_ws("\t", F.array_join(fields, "\t"), F.concat(F.lit("#"), comment) if comment is not None else F.lit(None))


def ranking_text(alternatives: DataFrame) -> DataFrame:
    """group_id and text: a line ``label, probability[, # comment]`` for each alternative (group_id, pos, label, prob, comment), after a line of dashes."""
    line = F.concat_ws("\t", "label", F.col("prob").cast("string"), F.concat(F.lit("# "), "comment"))
    rows = alternatives.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return rows.select("group_id", F.concat(F.lit("----\n"), F.array_join("l.line", "\n")).alias("text"))


def dependency_text(toks: DataFrame) -> DataFrame:
    """path, seq_id and text: the tab-separated dependency columns of ``toks`` (path, seq_id, id, form, pos_tag, gov, rel); a token that governs itself is the root."""
    gov = F.when(F.col("gov") == F.col("id"), 0).otherwise(F.col("gov"))
    line = F.concat_ws("\t", F.col("id"), "form", F.lit("_"), "pos_tag", F.lit("_"), F.lit("_"), gov, "rel")
    rows = toks.groupBy("path", "seq_id").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("l"))
    return rows.select("path", "seq_id", F.array_join("l.line", "\n").alias("text"))


def _escaped(text: Column) -> Column:
    for name, mark in (("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"')):
        text = F.replace(text, F.lit(mark), F.lit(f"&{name};"))
    return text


def post_markup(posts: DataFrame) -> DataFrame:
    """path and text: a ``<Post …>`` element for each post (path, post, attrs, toks), its attributes in order; predicted ones are attributes like others. Marks of XML in values and tokens are escaped."""
    entries = F.array_sort(F.map_entries("attrs"))
    head = F.array_join(F.transform(entries, lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"'))), "")
    one = F.concat(F.lit("<Post"), head, F.lit(">"), _escaped(F.array_join("toks", " ")), F.lit("</Post>"))
    rows = posts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("post", one.alias("p")))).alias("l"))
    return rows.select("path", F.array_join("l.p", "\n").alias("text"))


def lex_text(text: Column) -> Column:
    """The text with each whitespace token in ``<lex>`` tags; blanks stay."""
    return F.regexp_replace(text, "([^ \\r\\n\\t]+)", "<lex>$1</lex>")


def xml_text(toks: DataFrame) -> DataFrame:
    """path and text: an ``<s>`` element a sequence, a ``<lex>`` element a token (path, seq_id, pos, tok, gov, attrs) whose gov is the predicted one."""
    attrs = F.map_concat(F.map_filter("attrs", lambda k, _: k != "gov"), F.create_map(F.lit("gov"), F.col("gov").cast("string")))
    fields = F.transform(F.array_sort(F.map_entries(attrs)), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), _escaped(e["value"]), F.lit('"')))
    one = F.concat(F.lit("<lex"), F.array_join(fields, ""), F.lit(">"), _escaped(F.col("tok")), F.lit("</lex>"))
    sents = toks.groupBy("path", "seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("e")))).alias("s"))
    sents = sents.withColumn("s", F.concat(F.lit("<s>"), F.array_join("s.e", " "), F.lit("</s>")))
    files = sents.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq_id", "s"))).alias("s"))
    return files.select("path", F.concat(F.lit("<doc>"), F.array_join("s.s", "\n"), F.lit("</doc>")).alias("text"))


def instance_line(label: Column, fids: Column, vals: Column) -> Column:
    """The label, then ``fid`` or ``fid:value`` for each feature; values within 0.001 of 1 are left out."""
    one = lambda e: F.when(F.abs(e["v"] - 1) <= 0.001, e["f"].cast("string")).otherwise(F.concat_ws(":", e["f"].cast("string"), e["v"].cast("string")))
    return F.concat_ws(" ", label.cast("string"), F.transform(F.arrays_zip(fids.alias("f"), vals.alias("v")), one))
