"""Conversions between inline tags, standoff spans, labels, columns and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A tag, a run without tags, or a stray opening bracket.
PIECES = "<[^<>]+>|[^<]+|<"
#: Characters of a bin of the interval join.
BIN = 1024


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^<>]+>", "")


def offsets(docs: DataFrame) -> DataFrame:
    """doc_id, pos, tok, st and en (code points, en outside) of every whitespace token."""
    piece = F.regexp_extract_all("text", F.lit("[ \\r\\n\\t]*[^ \\r\\n\\t]+"), F.lit(0))
    rows = docs.select("doc_id", F.posexplode(piece).alias("pos", "p"))
    tok = F.regexp_extract("p", "[^ \\r\\n\\t]+", 0)
    en = F.sum(F.char_length("p")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc_id", "pos", tok.alias("tok"), (en - F.char_length(tok)).alias("st"), en.alias("en"))


def label_tokens(toks: DataFrame, spans: DataFrame, outside: str = "lex", *, tasks: int | None = None) -> DataFrame:
    """``toks`` (doc_id, pos, st, en) with label and begin from the spans (doc_id, st, en, label).

    A token that ends inside a span and after its start has the span's label;
    of several the one that starts first, then the shortest. Its first token is
    begin, and so is every token outside. An interval join by bins of offsets:
    a token meets the spans of its own bin alone, whatever the document's length.
    ``tasks`` states how many tasks tokens meet spans and their neighbours in; without it
    their number follows what is shuffled, not what a task has to sort.
    """

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(tasks, *by) if tasks else rows

    s = spans.select(F.col("doc_id").alias("s_doc"), F.col("st").alias("s_st"), F.col("en").alias("s_en"), F.col("label").alias("s_label"))
    s = s.where("s_en > s_st").withColumn("s_bin", F.explode(F.sequence(F.floor(F.col("s_st") / BIN), F.floor(F.col("s_en") / BIN))))
    # a bin's spans are one row, so that a token meets them at once and is neither multiplied nor joined again
    s = dealt(s, "s_doc", "s_bin").groupBy("s_doc", "s_bin").agg(F.collect_list(F.struct("s_st", "s_en", "s_label")).alias("__spans"))
    t = dealt(toks.withColumn("__bin", F.floor(F.col("en") / BIN)), "doc_id", "__bin")
    found = t.join(s, (t["doc_id"] == s["s_doc"]) & (t["__bin"] == s["s_bin"]), "left")
    own = F.filter("__spans", lambda x: (F.col("en") <= x["s_en"]) & (F.col("en") > x["s_st"]))
    both = dealt(found.withColumn("s", F.array_min(own)).select(*toks.columns, "s"), "doc_id")
    order = Window.partitionBy("doc_id").orderBy("pos")
    new = F.col("s").isNull() | ~F.lag("s").over(order).eqNullSafe(F.col("s"))
    return both.withColumns({"begin": new, "label": F.coalesce("s.s_label", F.lit(outside))}).drop("s")


def zoned(toks: DataFrame, zones: DataFrame, ends: str = "[.?!]+[\"']*$") -> DataFrame:
    """The tokens (doc_id, pos, tok, st, en) that lie in a zone (doc_id, st, en; zones of a document are apart), with seq_id and place: a sequence ends with its zone or a sentence-final token."""
    # zones are apart, so a token can only lie in the last one that starts before it: one window, no bins
    z = zones.where("doc_id IS NOT NULL").select("doc_id", F.col("st").alias("__at"), F.struct(F.col("st").alias("st"), F.col("en").alias("en")).alias("__zone"))
    both = toks.withColumn("__at", F.col("st")).unionByName(z, allowMissingColumns=True)
    sweep = Window.partitionBy("doc_id").orderBy("__at", F.col("__zone").isNull(), F.col("__zone.en")).rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("__last", F.last("__zone", True).over(sweep)).where((F.col("__zone").isNull()) & (F.col("en") <= F.col("__last.en"))).withColumn("z_st", F.col("__last.st"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    new = F.lag("z_st").over(order).isNull() | (F.lag("z_st").over(order) != F.col("z_st")) | F.lag("tok").over(order).rlike(ends)
    rows = inside.withColumn("new", new.cast("int")).withColumn("seq_id", (F.sum("new").over(order) - 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("doc_id", "seq_id").orderBy("pos")) - 1
    return rows.withColumn("place", place).select(*toks.columns, "seq_id", "place")


def outward(spans: DataFrame, toks: DataFrame) -> DataFrame:
    """``spans`` (doc_id, st, en, …) with ends inside a token (doc_id, st, en) moved outward to the token's borders."""
    t = toks.select(F.col("doc_id").alias("t_doc"), F.col("st").alias("t_st"), F.col("en").alias("t_en")).withColumn("t_bin", F.explode(F.sequence(F.floor(F.col("t_st") / BIN), F.floor(F.col("t_en") / BIN))))
    found = spans
    for end, border in (("st", "t_st"), ("en", "t_en")):
        on = (found["doc_id"] == t["t_doc"]) & (F.floor(found[end] / BIN) == t["t_bin"]) & (found[end] > t["t_st"]) & (found[end] < t["t_en"])
        found = found.join(t, on, "left").withColumn(end, F.coalesce(border, end)).select(*spans.columns)
    return found


def inline_spans(docs: DataFrame) -> DataFrame:
    """doc_id, tag, attrs, st and en (offsets in the text without tags) of every pair of an opening and a closing tag.

    A closing tag ends the latest open tag of its name; tags that stay open have no row.
    """
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("n", "p"))
    is_tag = F.col("p").rlike("^<[^<>]+>$")
    before = F.sum(F.when(is_tag, 0).otherwise(F.char_length("p"))).over(Window.partitionBy("doc_id").orderBy("n"))
    tags = rows.withColumn("at", before).where(is_tag & ~F.col("p").rlike("/>$|^<[!?]"))
    tags = tags.withColumns({"tag": F.regexp_extract("p", "^</?([^ \\r\\n\\t>]+)", 1), "open": ~F.col("p").startswith("</")})
    depth = F.sum(F.when(F.col("open"), 1).otherwise(-1)).over(Window.partitionBy("doc_id", "tag").orderBy("n"))
    tags = tags.withColumn("depth", depth + F.when(F.col("open"), 0).otherwise(1))
    level = Window.partitionBy("doc_id", "tag", "depth").orderBy("n")
    tags = tags.withColumns({"en": F.lead("at").over(level), "ends": ~F.lead("open").over(level)})
    keys, values = (F.regexp_extract_all("p", F.lit('([A-Za-z_:-]+)="([^"]*)"'), F.lit(i)) for i in (1, 2))
    pairs = F.map_from_entries(F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"].isNotNull()))
    return tags.where("open AND ends").select("doc_id", "tag", F.when(F.size(F.array_distinct(keys)) == F.size(keys), pairs).alias("attrs"), F.col("at").alias("st"), "en")


def inline_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and text with each span (doc_id, tag, st, en) as a pair of tags; closing tags go before opening ones, outer spans around inner ones.

    Spans may have ``fields``, text behind the tag's name, and ``level``: of spans with
    the same ends the lower one is outside.
    """
    level = F.col("level") if "level" in spans.columns else F.lit(0)
    start = F.concat("tag", F.coalesce("fields", F.lit(""))) if "fields" in spans.columns else F.col("tag")
    opening = spans.select("doc_id", F.col("st").alias("at"), F.lit(1).alias("kind"), (-F.col("en")).alias("rank"), level.alias("level"), F.concat(F.lit("<"), start, F.lit(">")).alias("mark"))
    closing = spans.select("doc_id", F.col("en").alias("at"), F.lit(0).alias("kind"), (-F.col("st")).alias("rank"), (-level).alias("level"), F.concat(F.lit("</"), "tag", F.lit(">")).alias("mark"))
    marks = opening.union(closing).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "rank", "level", "mark"))).alias("m"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marks, "doc_id", "left")

    def with_text(m, i):
        prior = F.when(i > 0, F.get(F.col("m"), i - 1)["at"]).otherwise(0)
        return F.concat(F.substring(F.col("text"), (prior + 1).cast("int"), (m["at"] - prior).cast("int")), m["mark"])

    rest = F.expr("substring(text, CAST(element_at(m, -1).at AS INT) + 1)")
    return rows.select("doc_id", F.when(F.col("m").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("m", with_text), ""), rest)).alias("text"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """doc_id, st, en and attrs of two annotation streams (one row a start each); at a shared start the second's end and attributes win, and what starts inside the annotation before is dropped."""
    b = second.select("doc_id", "st", F.col("en").alias("en2"), F.col("attrs").alias("attrs2"))
    both = first.join(b, ["doc_id", "st"], "full")
    old = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key("attrs2", k), F.lit(False)))
    rows = both.select("doc_id", "st", F.coalesce("en2", "en").alias("en"), F.map_concat(old, F.coalesce("attrs2", F.create_map().cast("map<string,string>"))).alias("attrs"))
    reach = F.max("en").over(Window.partitionBy("doc_id").orderBy("st").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("reach", reach).where("reach IS NULL OR st >= reach").drop("reach")


def project(alignment: DataFrame, source: DataFrame, least: float = 0.5) -> DataFrame:
    """line, pos and attr of target tokens: the attribute of the source token (line, pos, attr) that is aligned (line, tgt, src, p) with the highest p above ``least``."""
    have = alignment.where(F.col("p") > least).join(source.select("line", F.col("pos").alias("src"), "attr"), ["line", "src"])
    best = F.min_by("attr", F.struct((-F.col("p")).alias("p"), "src"))
    return have.groupBy("line", F.col("tgt").alias("pos")).agg(best.alias("attr"))


def iob_labels(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, seq_id, pos, iob) with label and begin: IOB1 and IOB2 tags alike start a span at ``B-`` or at a change of type."""
    order = Window.partitionBy("doc_id", "seq_id").orderBy("pos")
    kind = F.when(F.col("iob") == "O", "lex").otherwise(F.regexp_replace("iob", "^[BI]-", ""))
    before = F.lag(kind).over(order)
    return rows.withColumns({"label": kind, "begin": (kind == "lex") | F.col("iob").startswith("B-") | before.isNull() | (before != kind)})


def feature_numbers(features: DataFrame) -> DataFrame:
    """fname and fid: numbers from 1 by descending count, then name.

    Features are ranked within their count and the counts' sizes added up. Rare
    counts hold most features, so a count's features are dealt to 256 ranges by
    the first bytes of their name's order first.
    """
    return numbered(features.groupBy("fname").agg(F.count("*").alias("n")))


def numbered(counts: DataFrame) -> DataFrame:
    """:func:`feature_numbers` of features that are counted already (fname, n); counts are read twice."""
    range_of = F.conv(F.substring(F.rpad(F.hex("fname"), 2, "0"), 1, 2), 16, 10).cast("int")
    sized = counts.withColumn("part", range_of)
    per = sized.groupBy("n", "part").agg(F.count("*").alias("m"))
    by_count = per.groupBy("n").agg(F.sum("m").alias("m"))
    starts = by_count.select("n", (F.sum("m").over(Window.orderBy(F.desc("n"))) - F.col("m")).alias("first"))  # a row a distinct count
    within = per.select("n", "part", (F.sum("m").over(Window.partitionBy("n").orderBy("part")) - F.col("m")).alias("inside"))
    place = F.row_number().over(Window.partitionBy("n", "part").orderBy("fname"))
    found = sized.withColumn("place", place).join(within, ["n", "part"]).join(starts, "n")
    return found.select("fname", (F.col("first") + F.col("inside") + F.col("place")).cast("long").alias("fid"))


def standoff_json(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id and json: standoff JSON of the text and its spans (doc_id, type, st, en, attrs of one shared set of names a type)."""
    names = spans.select("type", F.explode(F.map_keys("attrs")).alias("k")).groupBy("type").agg(F.array_sort(F.collect_set("k")).alias("attrs_of"))
    rows = spans.join(names, "type", "left").withColumn("attrs_of", F.coalesce("attrs_of", F.array().cast("array<string>")))
    row = F.concat(F.array(F.col("st").cast("string"), F.col("en").cast("string")), F.transform("attrs_of", lambda k: F.coalesce(F.try_element_at("attrs", k), F.lit(""))))
    rows = rows.select("doc_id", "type", "attrs_of", row.alias("row"))
    sets = rows.groupBy("doc_id", "type").agg(F.first("attrs_of").alias("attrs"), F.array_sort(F.collect_list("row")).alias("annots"))
    per_doc = sets.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("type", "attrs", "annots"))).alias("asets"))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("signal")).join(per_doc, "doc_id", "left")
    asets = F.coalesce("asets", F.array().cast("array<struct<type:string,attrs:array<string>,annots:array<array<string>>>>"))
    json = F.to_json(F.struct("signal", asets.alias("asets")))
    return found.select("doc_id", F.regexp_replace(json, '\\["([0-9]+)","([0-9]+)"', "[$1,$2").alias("json"))


def _pieces(docs: DataFrame) -> DataFrame:
    """``docs`` with p: the tags and runs of text, in order; all of a document stays in its row."""
    return docs.withColumn("p", F.regexp_extract_all("text", F.lit(PIECES), F.lit(0)))


def upper_in_tags(docs: DataFrame, tags: list[str]) -> DataFrame:
    """doc_id and text: upper case for the text inside any of the tags, which stay."""
    name = lambda x: F.regexp_extract(x, "^</?([^ \\r\\n\\t>]+)[^<]*>$", 1)

    def step(state: Column, x: Column) -> Column:
        is_tag = x.rlike("^<[^<>]+>$") & name(x).isin(*tags) & ~x.endswith("/>")
        depth = F.when(is_tag & x.startswith("</"), F.greatest(state["depth"] - 1, F.lit(0))).when(is_tag, state["depth"] + 1).otherwise(state["depth"])
        shown = F.when((depth > 0) & ~x.rlike("^<[^<>]+>$"), F.upper(x)).otherwise(x)
        return F.struct(depth.alias("depth"), F.array_append(state["out"], shown).alias("out"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
    return _pieces(docs).select("doc_id", F.array_join(F.aggregate("p", start, step)["out"], "").alias("text"))


def split_docs(docs: DataFrame, tag: str) -> DataFrame:
    """doc_id, part (from 0) and text: the text without tags, cut before each start tag of the name."""
    parts = F.split("text", f"(?=<{tag}[ >])")
    return docs.select("doc_id", F.posexplode(parts).alias("part", "t")).select("doc_id", "part", strip_tags(F.col("t")).alias("text"))


def mapped_values(rows: DataFrame, column: str, mapping: DataFrame, default: str | None = None) -> DataFrame:
    """``rows`` with the column's values replaced by the mapping (source, target); others become ``default``, or stay."""
    table = mapping.select(F.col("source").alias("__source"), F.col("target").alias("__target"))
    other = F.lit(default) if default is not None else F.col(column)
    return rows.join(table, F.col(column) == F.col("__source"), "left").withColumn(column, F.coalesce("__target", other)).drop("__source", "__target")


def tagged_words(docs: DataFrame, mapping: DataFrame, default: str = "NOUN") -> DataFrame:
    """doc_id, pos, tok and tag of texts of ``word_TAG`` items: the mapped tag (source, target), or ``default``."""
    rows = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^ \\r\\n\\t]+"), F.lit(0))).alias("pos", "item"))
    cut = F.regexp_extract("item", "^(.*)_([^_]*)$", 1), F.regexp_extract("item", "^(.*)_([^_]*)$", 2)
    bare = ~F.col("item").contains("_")
    return mapped_values(rows.select("doc_id", "pos", F.when(bare, F.col("item")).otherwise(cut[0]).alias("tok"), F.when(bare, "").otherwise(cut[1]).alias("tag")), "tag", mapping, default)


def project_tags(toks: DataFrame, alignment: DataFrame, source: DataFrame, least: float = 0.5, unsure: str = "<U>") -> DataFrame:
    """line, pos and tag of all target tokens (line, pos): that of the best aligned tagged source token, none if the best is untagged, ``unsure`` if nothing is aligned with ``least`` or more.

    ``alignment`` has line, tgt, src and p, ``source`` line, pos and tag (null outside tags).
    """
    have = alignment.join(source.select("line", F.col("pos").alias("src"), "tag"), ["line", "src"])
    best = F.min_by(F.struct("tag", "p"), F.struct((-F.col("p")).alias("p"), F.col("tag").isNull().alias("none"), "src"))
    found = have.groupBy("line", F.col("tgt").alias("pos")).agg(best.alias("best"))
    sure = F.coalesce(F.col("best.p") >= least, F.lit(False))
    return toks.select("line", "pos").join(found, ["line", "pos"], "left").select("line", "pos", F.when(sure, F.col("best.tag")).otherwise(unsure).alias("tag"))


def vector_lines(rows: DataFrame) -> DataFrame:
    """id and line: the label, then ``i|value`` for each value of the i-th vector (vectors: arrays of strings); rows without a label have none."""
    fields = F.flatten(F.transform("vectors", lambda v, i: F.transform(F.filter(v, lambda x: F.trim(x) != ""), lambda x: F.concat(i.cast("string"), F.lit("|"), x))))
    label = F.replace("label", F.lit(" "), F.lit(""))
    return rows.where("label <> ''").select("id", F.concat_ws(" ", label, F.array_join(fields, " ")).alias("line"))


def dense_rows(rows: DataFrame, n: int) -> DataFrame:
    """id and row: 0 or 1 for each of the feature numbers 1 to ``n`` that a row (id, fids) has."""
    return rows.select("id", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array_contains("fids", i.cast("long")).cast("int")).alias("row"))


def column_lines(toks: DataFrame) -> DataFrame:
    """doc_id, seq_id and text: one label a line, with the comment if there is one."""
    line = F.concat_ws("\t", "label", "comment") if "comment" in toks.columns else F.col("label")
    rows = toks.groupBy("doc_id", "seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return rows.select("doc_id", "seq_id", F.array_join("l.line", "\n").alias("text"))
