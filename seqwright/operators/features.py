"""Feature vocabularies: what training data support, hashed ids, and the lookup at decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def supported(features: DataFrame) -> DataFrame:
    """fname, prv, cur and n of the features (doc_id, seq_id, pos, fname, label, edge) that training data show.

    prv is null for state features; edge features have none at a sequence's first position.
    """
    prv = F.lag("label").over(Window.partitionBy("doc_id", "seq_id", "fname", "edge").orderBy("pos"))
    rows = features.withColumn("prv", F.when(F.col("edge"), prv)).where(~F.col("edge") | F.col("prv").isNotNull())
    return rows.groupBy("fname", "prv", F.col("label").alias("cur")).agg(F.count("*").alias("n"))


def hashed(features: DataFrame, n: int) -> DataFrame:
    """``features`` with fid, the hash of fname modulo ``n``."""
    return features.withColumn("fid", F.pmod(F.xxhash64("fname"), F.lit(n)))


def type_count(features: DataFrame) -> DataFrame:
    """n_types: how many names the features have, the size that hashed ids need."""
    return features.agg(F.count_distinct("fname").alias("n_types"))


def expanded(features: DataFrame, labels: list[str]) -> DataFrame:
    """fname, prv and cur of each feature (fname, edge) with all labels, edge features with all pairs, as soft labels support them all."""
    names = F.array(*map(F.lit, labels))  # labels are few and given
    rows = features.select("fname", "edge").distinct().withColumn("cur", F.explode(names))
    return rows.withColumn("prv", F.explode(F.when(F.col("edge"), names).otherwise(F.array(F.lit(None).cast("string"))))).select("fname", "prv", "cur")


def known(features: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The features whose name the vocabulary has."""
    return features.join(vocabulary.select("fname").distinct(), "fname", "left_semi")


def composed(*vocabularies: DataFrame) -> DataFrame:
    """fname of all vocabularies, each once; :func:`convert.feature_numbers` numbers them anew."""
    rows = vocabularies[0].select("fname")
    for v in vocabularies[1:]:
        rows = rows.union(v.select("fname"))
    return rows.distinct()


def weighted(features: DataFrame, induced: DataFrame) -> DataFrame:
    """The features (…, fname) as weights of classes: a row for each class and weight (cls, w) that the induced map (fname, cls, w) gives one; others have none."""
    return features.join(induced.select("fname", "cls", "w"), "fname").drop("fname")


def adjusted(params: DataFrame, changes: DataFrame, node: str = ":U:") -> DataFrame:
    """``params`` (fname, prv, cur, w) with each label's change (cur, by) added to its node feature's weight."""
    by = F.when((F.col("fname") == node) & F.col("prv").isNull(), F.coalesce("by", F.lit(0.0))).otherwise(0.0)
    return params.join(changes.select("cur", "by"), "cur", "left").withColumn("w", F.col("w") + by).select("fname", "prv", "cur", "w")


def tag_matches(tags: DataFrame, tagset: DataFrame) -> DataFrame:
    """``tags`` (id, tag, attrs) that the tag set (tag, want: attribute -> value, ``*`` for any) names, with the attributes that the label keeps.

    A tag with all wanted values keeps the wanted ones; with some of the ``*``
    attributes it keeps these; a set tag without wants matches every tag of its
    name. Of several set tags the one with most wants counts.
    """
    rows = tags.join(F.broadcast(tagset.select("tag", "want")), "tag")  # a set is written by hand, and its few names would gather all tags in as many tasks
    entries = lambda m: F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>")))
    whole = F.forall(entries(F.col("want")), lambda e: F.coalesce(F.try_element_at("attrs", e["key"]) == e["value"], F.lit(False)))
    free = F.map_filter("attrs", lambda k, _: F.coalesce(F.try_element_at("want", k) == "*", F.lit(False)))
    rows = rows.withColumn("kept", F.when(whole, F.coalesce("want", F.create_map().cast("map<string,string>"))).when(F.size(free) > 0, free)).where("kept IS NOT NULL")
    best = F.max_by(F.map_entries("kept"), F.struct(F.size("want").alias("n"), F.array_sort(F.map_keys("want")).alias("k")))
    return rows.groupBy("id", "tag").agg(F.map_from_entries(best).alias("kept"))


def compact(params: DataFrame, least: float = 1e-39) -> DataFrame:
    """The parameters (fname, prv, cur, w) that are not as good as zero."""
    return params.where(F.abs("w") > least)
