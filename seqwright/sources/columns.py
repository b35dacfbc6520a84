"""Readers of line formats: files become rows without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, keep: str | None = None) -> DataFrame:
    """path and text of each file below ``path`` whose path the pattern is found in."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where(F.col("path").rlike(keep)) if keep else rows


def lines(docs: DataFrame, ends: str) -> DataFrame:
    """path, seq_id, pos and line of each text line; a line that matches ``ends`` ends a sequence and has no row."""
    # a text is cut where it lies, so that its lines are neither shuffled nor sorted
    rows = docs.select("path", F.split("text", "\r?\n").alias("l")).withColumn("cuts", F.concat(F.array(F.lit(-1)), F.filter(F.transform("l", lambda x, i: F.when(x.rlike(ends), i)), lambda i: i.isNotNull()), F.array(F.size("l"))))
    rows = rows.select("path", "l", F.posexplode(F.arrays_zip(F.slice("cuts", F.lit(1), F.size("cuts") - 1).alias("a"), F.slice("cuts", F.lit(2), F.size("cuts") - 1).alias("b"))).alias("seq_id", "c"))
    own = F.slice("l", F.col("c.a") + 2, F.col("c.b") - F.col("c.a") - 1)
    return rows.select("path", "seq_id", F.posexplode(own).alias("pos", "line")).select("path", "line", "seq_id", "pos")


def _values(fields: Column) -> Column:
    """name -> value of ``f`` and ``f:v`` fields; 1 where there is no number."""
    entries = F.transform(fields, lambda f: F.struct(F.regexp_extract(f, "^(.*?)(?::([^:]*))?$", 1).alias("k"), F.coalesce(F.regexp_extract(f, "^(.*?)(?::([^:]*))?$", 2).try_cast("double"), F.lit(1.0)).alias("v")))
    return F.map_from_entries(F.map_entries(F.aggregate(entries, F.create_map().cast("map<string,double>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])))))


def basic_columns(docs: DataFrame, separator: str = "\t") -> DataFrame:
    """path, seq_id, pos, label, label_dist, feats and comment of the column format.

    A blank line or ``++`` ends a sequence. The first field is the label, or two
    or more leading ``label=probability`` fields are its distribution; a field
    that starts with ``#`` begins the comment.
    """
    rows = lines(docs, r"^\s*$|^\+\+")
    cells = F.split("line", separator)
    comment_at = F.array_position(F.transform(cells, lambda c: c.startswith("#")), True)
    rows = rows.withColumn("cells", F.when(comment_at > 0, F.slice(cells, F.lit(1), (comment_at - 1).cast("int"))).otherwise(cells))
    rows = rows.withColumn("comment", F.when(comment_at > 0, F.array_join(F.slice(cells, comment_at.cast("int"), F.size(cells)), separator)))
    soft = F.aggregate("cells", F.lit(0), lambda n, c: F.when((n >= 0) & c.rlike(r"^[^=:]+=[0-9.eE-]+$"), n + 1).otherwise(F.when(n > 0, -n - 1).otherwise(F.when(n == 0, F.lit(-1)).otherwise(n))))
    n_soft = F.when(soft > 0, soft).otherwise(-soft - 1)
    rows = rows.withColumn("n_soft", n_soft)
    pairs = F.transform(F.slice("cells", F.lit(1), F.col("n_soft")), lambda c: F.struct(F.substring_index(c, "=", 1).alias("k"), F.substring_index(c, "=", -1).cast("double").alias("v")))
    is_soft = F.col("n_soft") >= 2
    first = F.when(is_soft, F.col("n_soft")).otherwise(1)
    return rows.select(
        "path",
        "seq_id",
        "pos",
        F.when(~is_soft, F.get("cells", F.lit(0))).alias("label"),
        F.when(is_soft, F.map_from_entries(pairs)).alias("label_dist"),
        _values(F.filter(F.slice("cells", first + 1, F.size("cells")), lambda c: c != "")).alias("feats"),
        "comment",
    )


def attribute_values(docs: DataFrame) -> DataFrame:
    """path, pos, label, weight, feats and comment of ``[weight] label f[:v] ... [# comment]`` lines; lines of two characters or fewer have no row."""
    rows = lines(docs, r"^.{0,2}$")
    text = F.regexp_extract("line", "^([^#]*)", 1)
    cells = F.filter(F.split(text, r"\s+"), lambda c: c != "")
    weighted = F.get(cells, F.lit(0)).rlike(r"^[0-9]+\.?[0-9]+$|^\.[0-9]+$")
    first = F.when(weighted, 2).otherwise(1)
    return rows.select(
        "path",
        "pos",
        F.get(cells, first - 1).alias("label"),
        F.when(weighted, F.get(cells, F.lit(0)).cast("double")).otherwise(1.0).alias("weight"),
        _values(F.slice(cells, first + 1, F.size(cells))).alias("feats"),
        F.when(F.instr("line", "#") > 0, F.trim(F.regexp_extract("line", "#(.*)$", 1))).alias("comment"),
    )


def soft_values(docs: DataFrame) -> DataFrame:
    """path, pos, label, label_dist, feats and comment of lines that start with two or more ``label=probability`` fields; others are read as :func:`attribute_values` without a weight."""
    rows = lines(docs, r"^.{0,2}$")
    cells = F.filter(F.split(F.regexp_extract("line", "^([^#]*)", 1), " "), lambda c: c != "")
    soft = r"^[A-z]+=[0-9][0-9.E-]+$"
    first_other = F.array_position(F.transform(cells, lambda c: c.rlike(soft)), False)
    n_soft = F.when(first_other > 0, first_other - 1).otherwise(F.size(cells)).cast("int")
    is_soft = n_soft > 1
    pairs = F.transform(F.slice(cells, F.lit(1), n_soft), lambda c: F.struct(F.substring_index(c, "=", 1).alias("k"), F.substring_index(c, "=", -1).cast("double").alias("v")))
    used = F.when(is_soft, n_soft).otherwise(1)
    return rows.select(
        "path",
        "pos",
        F.when(is_soft, F.get(pairs, F.lit(0))["k"]).otherwise(F.get(cells, F.lit(0))).alias("label"),
        F.when(is_soft, F.map_from_entries(pairs)).alias("label_dist"),
        _values(F.slice(cells, used + 1, F.size(cells))).alias("feats"),
        F.when(F.instr("line", "#") > 0, F.regexp_extract("line", "#(.*)$", 1)).alias("comment"),
    )


def ranked(docs: DataFrame) -> DataFrame:
    """path, group_id, pos, label, prob, feats and comment of ``label probability f[:v] …`` lines; a line with four dashes ends a group."""
    rows = lines(docs, "----")
    cells = F.filter(F.split(F.regexp_extract("line", "^([^#]*)", 1), " "), lambda c: c != "")
    rows = rows.where(F.size(cells) >= 2)
    return rows.select("path", F.col("seq_id").alias("group_id"), "pos", F.get(cells, F.lit(0)).alias("label"), F.get(cells, F.lit(1)).cast("double").alias("prob"), _values(F.slice(cells, F.lit(3), F.size(cells))).alias("feats"), F.when(F.instr("line", "#") > 0, F.regexp_replace(F.regexp_extract("line", "#(.*)$", 1), "#", "")).alias("comment"))


def class_folders(docs: DataFrame) -> DataFrame:
    """path, label and feats: the name of a file's folder, and the tokens of its text with value 1."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[^ \\r\\n\\t]+"), F.lit(0)))
    return docs.select("path", F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("label"), F.map_from_entries(F.transform(words, lambda w: F.struct(w, F.lit(1.0)))).alias("feats"))


def lexicons(docs: DataFrame) -> DataFrame:
    """lex_name and term: a file is a lexicon of its name, each whitespace-separated word a term."""
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return docs.select(name.alias("lex_name"), F.explode(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0))).alias("term")).distinct()


def word_properties(docs: DataFrame) -> DataFrame:
    """word and properties of ``word property …`` lines; a word's lines add up."""
    cells = F.regexp_extract_all("line", F.lit("\\S+"), F.lit(0))
    rows = lines(docs, r"^\s*$").select(F.get(cells, F.lit(0)).alias("word"), F.explode(F.slice(cells, F.lit(2), F.size(cells))).alias("p"))
    return rows.groupBy("word").agg(F.array_sort(F.collect_set("p")).alias("properties"))


def word_scores(docs: DataFrame) -> DataFrame:
    """word and score of ``word score`` lines; of several the greatest."""
    cells = F.regexp_extract_all("line", F.lit("\\S+"), F.lit(0))
    return lines(docs, r"^\s*$").groupBy(F.get(cells, F.lit(0)).alias("word")).agg(F.max(F.get(cells, F.lit(1)).try_cast("double")).alias("score"))


def dependencies(docs: DataFrame) -> DataFrame:
    """path, seq_id, id, form, pos_tag, gov and rel of tab-separated dependency columns; the root's head is itself."""
    rows = lines(docs, r"^\s*$")
    c = F.split("line", "\t")
    own, gov = F.get(c, F.lit(0)).cast("int"), F.get(c, F.lit(6)).cast("int")
    return rows.select("path", "seq_id", own.alias("id"), F.get(c, F.lit(1)).alias("form"), F.get(c, F.lit(3)).alias("pos_tag"), F.when(gov == 0, own).otherwise(gov).alias("gov"), F.get(c, F.lit(7)).alias("rel"))


_STANDOFF = "signal string, asets array<struct<type: string, hasID: boolean, hasSpan: boolean, attrs: array<string>, annots: array<array<string>>>>"


_STANDOFF_V2 = "signal string, asets array<struct<type: string, hasID: boolean, hasSpan: boolean, attrs: array<struct<name: string, type: string, aggregation: string>>, annots: array<array<string>>>>"


def standoff_v2(docs: DataFrame, types: tuple[str, ...] = ("ENTITY",)) -> DataFrame:
    """path, type, id, st, en, text and attrs of the annotations of some types in standoff JSON whose attributes are objects; ids, where there are any, follow the offsets."""
    rows = docs.select("path", F.from_json("text", _STANDOFF_V2).alias("d")).select("path", "d.signal", F.explode("d.asets").alias("a")).where(F.col("a.type").isin(*types))
    rows = rows.select("path", "signal", "a.type", F.coalesce("a.hasID", F.lit(False)).alias("has_id"), F.transform("a.attrs", lambda x: x["name"]).alias("names"), F.explode("a.annots").alias("x"))
    st, en = F.get("x", F.lit(0)).cast("int"), F.get("x", F.lit(1)).cast("int")
    first = F.when(F.col("has_id"), 4).otherwise(3)
    attrs = F.map_from_arrays("names", F.slice("x", first, F.size("names")))
    return rows.select("path", "type", F.when(F.col("has_id"), F.get("x", F.lit(2))).alias("id"), st.alias("st"), en.alias("en"), F.substring(F.col("signal"), st + 1, en - st).alias("text"), attrs.alias("attrs"))


def _plain(text: Column) -> Column:
    """Text of XML with its five named entities resolved."""
    for name, mark in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(mark))
    return text


def posts(docs: DataFrame) -> DataFrame:
    """path, post, attrs and toks of each ``<Post …>`` element; the tags inside are dropped, named entities of XML resolved."""
    whole = F.regexp_extract_all("text", F.lit("(?s)<Post\\b[^<>]*>.*?</Post>"), F.lit(0))
    rows = docs.select("path", F.posexplode(whole).alias("post", "p"))
    head = F.regexp_extract("p", "^<Post\\b([^<>]*)>", 1)
    keys, values = (F.regexp_extract_all(head, F.lit('([A-Za-z_:-]+)="([^"]*)"'), F.lit(i)) for i in (1, 2))
    body = F.regexp_replace("p", "<[^<>]+>", " ")
    return rows.select("path", "post", F.map_from_arrays(keys, F.transform(values, _plain)).alias("attrs"), F.transform(F.regexp_extract_all(body, F.lit("[^ \\r\\n\\t]+"), F.lit(0)), _plain).alias("toks"))


def standoff(docs: DataFrame) -> DataFrame:
    """path, type, st, en, text and attrs of each annotation of standoff JSON with string attributes."""
    row = F.from_json("text", _STANDOFF)
    rows = docs.select("path", row.alias("d")).select("path", "d.signal", F.explode("d.asets").alias("a"))
    rows = rows.select("path", "signal", "a.type", "a.attrs", F.explode("a.annots").alias("x"))
    st, en = F.get("x", F.lit(0)).cast("int"), F.get("x", F.lit(1)).cast("int")
    values = F.slice("x", F.lit(3), F.size("attrs"))
    return rows.select("path", "type", st.alias("st"), en.alias("en"), F.substring(F.col("signal"), st + 1, en - st).alias("text"), F.map_from_arrays("attrs", values).alias("attrs"))


def xml_sentences(docs: DataFrame) -> DataFrame:
    """path, seq_id, pos, tok, gov and attrs of the ``<lex …>`` elements in each ``<s>`` element; gov is 0 where the attribute lacks."""
    found = F.regexp_extract_all("text", F.lit("(?s)<s(?:\\s[^<>]*)?>(.*?)</s>"), F.lit(1))
    sents = docs.select("path", F.posexplode(found).alias("seq_id", "s"))
    toks = sents.select("path", "seq_id", F.posexplode(F.regexp_extract_all("s", F.lit("(?s)<lex(?:\\s[^<>]*)?>.*?</lex>"), F.lit(0))).alias("pos", "e"))
    tag = F.regexp_extract("e", "^<[^<>]+>", 0)
    name, value = (F.regexp_extract_all(tag, F.lit("([\\w:.-]+)=\"([^\"]*)\""), F.lit(i)) for i in (1, 2))
    toks = toks.withColumn("attrs", F.map_from_arrays(name, F.transform(value, _plain)))
    gov = F.coalesce(F.try_element_at("attrs", F.lit("gov")).try_cast("int"), F.lit(0))
    return toks.select("path", "seq_id", "pos", _plain(F.regexp_replace("e", "<[^<>]*>", "")).alias("tok"), gov.alias("gov"), "attrs")
