"""Steps that have to grow no faster than their input, seen in plans and in small rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqwright.functions import spec
from seqwright.operators import arcs, context, convert, dialog, evaluate, lexer, parse, segments, tokenize
from seqwright.plans.catalogue import QUERIES
from seqwright.sources import columns

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shares_round_as_in_sql(spark):
    posts = spark.createDataFrame([(1, 0, "a", [f"w{i}" for i in range(40)]), (1, 1, "b", [f"w{i}" for i in range(23)])], "doc_id long, pos int, user string, toks array<string>")
    found = dialog.antecedent_features(dialog.candidates(posts, 1)).select("features").first().features
    assert "Overlap=0.57" in found


def test_nearest_reads_no_frame_anew(spark):
    toks = spark.createDataFrame([(1, 0, i, i in (3, 20)) for i in range(25)], "doc_id long, seq_id int, pos int, mark boolean")
    found = context.nearest(toks, F.col("mark"))
    assert "1, unboundedfollowing" not in plan(found)
    rows = {r.pos: (r.left, r.right) for r in found.collect()}
    assert rows[0] == (0, 3) and rows[3] == (3, 13) and rows[4] == (1, 13) and rows[20] == (13, 4) and rows[24] == (4, 0)
    for name in ("nearest_marks", "shape_features"):
        assert "1, unboundedfollowing" not in plan(QUERIES[name](spark, DATA))


def test_label_segments_join_nothing(spark):
    assert "Join" not in plan(QUERIES["label_segments"](spark, DATA))
    toks = spark.createDataFrame([(1, 0, p, t, lab, b) for p, t, lab, b in ((0, "a", "X", True), (1, "b", "X", False), (2, "c", "lex", True), (5, "d", "Y", True), (7, "e", "Y", False))], "doc_id long, seq_id int, pos int, tok string, label string, begin boolean")
    key = ["doc_id", "seq_id", "pos", "s", "words", "label"]
    old = segments.supported(segments.candidates(toks, 2), segments.label_sizes(toks))
    assert sorted(map(tuple, segments.shown(toks, 2).select(key).collect())) == sorted(map(tuple, old.select(key).collect()))


def test_windows_over_tokens_shuffle_texts(spark):
    for name in ("label_segments", "nearest_marks", "shape_features", "segment_features", "spec_features", "cue_lines", "label_lines", "context_features"):
        assert "tok" not in "".join(line for line in physical(QUERIES[name](spark, DATA)).splitlines() if "Exchange" in line)
        assert physical(QUERIES[name](spark, DATA)).count("Exchange hashpartitioning(doc_id") == physical(QUERIES[name](spark, DATA)).count("REPARTITION_BY_NUM"), name


def test_span_scores_join_nothing(spark):
    kind = "doc_id long, seq_id int, label string, st int, en int"
    gold = spark.createDataFrame([(1, 0, "A", 0, 1), (1, 0, "A", 3, 3), (2, 0, "A", 0, 0), (2, 0, None, 1, 1)], kind)
    system = spark.createDataFrame([(1, 0, "A", 0, 1), (1, 0, "B", 3, 3), (2, 0, "A", 0, 0), (2, 0, "A", 4, 5)], kind)
    found = evaluate.span_scores(gold, system)
    assert "Join" not in plan(found)
    assert {r.label: (round(r.precision, 6), round(r.recall, 6)) for r in found.collect()} == {"A": (0.666667, 0.666667), "TOTAL": (0.666667, 0.666667)}


def test_zones_and_labels_join_tokens_once(spark):
    toks = spark.createDataFrame([(1, i, "x." if i == 2 else "x", 2 * i, 2 * i + 2) for i in range(9)], "doc_id long, pos int, tok string, st long, en long")
    zones = spark.createDataFrame([(1, 2, 9), (1, 10, 14), (2, 0, 5)], "doc_id long, st int, en int")
    found = convert.zoned(toks, zones)
    assert "Join" not in plan(found)
    assert sorted((r.pos, r.seq_id, r.place) for r in found.collect()) == [(1, 0, 0), (2, 0, 1), (3, 1, 0), (5, 2, 0), (6, 2, 1)]
    spans = spark.createDataFrame([(1, 0, 6, "A"), (1, 4, 3000, "B"), (1, 0, 4, "C")], "doc_id long, st int, en int, label string")
    labels = convert.label_tokens(toks, spans)
    assert plan(labels).count("Join") == 1
    assert [(r.label, r.begin) for r in labels.orderBy("pos").collect()][:5] == [("C", True), ("C", False), ("A", True), ("B", True), ("B", False)]


def test_lines_are_cut_in_place(spark):
    docs = spark.createDataFrame([("f", "\n\na\nb\n\n\nc\n"), ("g", "a"), ("h", ""), ("i", None)], "path string, text string")
    found = columns.lines(docs, r"^\s*$")
    assert "Window" not in plan(found)
    assert sorted(map(tuple, found.select("path", "seq_id", "pos", "line").collect())) == [("f", 2, 0, "a"), ("f", 2, 1, "b"), ("f", 4, 0, "c"), ("g", 0, 0, "a")]


def test_texts_reach_the_scanner_in_small_parts(spark):
    texts = ["x" * 700_000, "", "y" * 700_000, "z", "w" * (2 << 20), "v"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"])
    parts = [p.column("doc_id").to_pylist() for p in lexer._small(batch)]
    assert parts == [[0, 1, 2], [3, 4], [5]]


def test_a_tag_set_is_not_joined_by_its_few_names(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = physical(QUERIES["tag_matches"](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in shown and "SortMergeJoin" not in shown


def test_totals_of_arcs_equal_features_counted_one_by_one(spark):
    words = spark.createDataFrame([(1, 0, i + 1, t, p, c, f) for i, (t, p, c, f) in enumerate([("a", "X", "x", "a"), ("bb", "Y", "y", "b"), ("|", "X", "y", ""), ("a", "Y", "x", "a"), ("c", "X", "x", "c")])] + [(2, 0, 1, "a", "X", "x", "q")], "doc_id long, seq_id int, id int, tok string, pos string, cpos string, pref string")
    for sets, reach in ((arcs.SETS, None), (("before", "between"), 2)):
        one = arcs.pairs(words, sets, reach=reach).select(F.inline(arcs.entries(sets))).groupBy("n").agg(F.count("*").alias("m"), F.sum("v").cast("long"))
        found = arcs.totals(words, sets, reach=reach)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, one.collect()))


def test_labels_meet_tokens_in_a_stated_number_of_tasks(spark):
    toks = spark.createDataFrame([(1, i, 2 * i, 2 * i + 2) for i in range(900)] + [(2, 0, 0, 2)], "doc_id long, pos int, st long, en long")
    spans = spark.createDataFrame([(1, 0, 6, "A"), (1, 4, 1500, "B"), (2, 4, 9, "C")], "doc_id long, st int, en int, label string")
    found = convert.label_tokens(toks, spans, tasks=7)
    assert found.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, found.select("doc_id", "pos", "label", "begin").collect())) == sorted(map(tuple, convert.label_tokens(toks, spans).select("doc_id", "pos", "label", "begin").collect()))
    for name in ("page_labels", "token_labels"):  # no shuffle that is made smaller by what it writes
        assert all("REPARTITION_BY_NUM" in line for line in physical(QUERIES[name](spark, DATA)).splitlines() if "Exchange hashpartitioning" in line), name


def test_sentences_are_cut_without_windows(spark):
    docs = spark.createDataFrame([("a", "x. y z w v\n! u"), ("b", None), ("c", ""), ("d", " one two?' three. "), ("e", "p q. r"), ("e", "s t."), ("f", ". . . ")], "doc_id string, text string")
    found = tokenize.sentence_arrays(docs, 3)
    assert "Window" not in plan(found)
    old = tokenize.bounded(tokenize.sentences(tokenize.tokens(docs.where("doc_id <> 'e'"))), 3)
    own = found.select("doc_id", "seq_id", F.posexplode("toks").alias("pos", "tok"))
    assert sorted(map(tuple, own.where("doc_id <> 'e'").collect())) == sorted(map(tuple, old.select("doc_id", "seq_id", "pos", "tok").collect()))
    assert sorted(map(tuple, own.where("doc_id = 'e'").collect())) == [("e", 0, 0, "p"), ("e", 0, 1, "s"), ("e", 0, 2, "q."), ("e", 1, 0, "t."), ("e", 2, 0, "r")]


def test_totals_of_arcs_unfold_no_pairs(spark):
    rng = random.Random(3)
    toks = [(i, 0, [rng.choice(["a", "b|", "cc", "d"] + [f"w{k}" for k in range(60)]) for _ in range(rng.randrange(1, 30))]) for i in range(60)]
    rows = arcs.rows(spark.createDataFrame(toks, "doc_id long, seq_id int, toks array<string>"), lambda t: {"tok": t, "pos": F.right(t, F.lit(1)), "pref": F.left(t, F.lit(1))})
    assert "Generate" not in plan(arcs._counted_keys(rows, arcs.SETS, None))
    for reach in (None, 4):
        one = arcs.pairs(rows, reach=reach).select(F.inline(arcs.entries())).groupBy("n").agg(F.count("*").alias("m"), F.sum("v").cast("long"))
        assert sorted(map(tuple, arcs.totals(rows, reach=reach).collect())) == sorted(map(tuple, one.collect()))


def test_forward_heads_are_those_of_all_arcs_without_a_row_an_arc(spark):
    rng = random.Random(4)
    kinds = ["a", "b", "b|", "|", "a|b", "cc", "ddd", ""] + [f"w{k}" for k in range(20)]
    toks = [(f"d{i}", i % 3, [rng.choice(kinds) for _ in range(rng.randrange(1, 25))]) for i in range(80)]
    sentences = spark.createDataFrame(toks, "doc_id string, seq_id int, toks array<string>")
    tag = lambda t: F.least(F.char_length(t), F.lit(2))
    found = arcs.forward_heads(sentences, tag)
    words = arcs.rows(sentences, lambda t: {"tok": t, "pos": tag(t)})
    near = arcs.features(words, ("basic",), reach=1, forward=True).where("gov = id - 1")
    weights = near.select(F.explode(F.map_keys("feats")).alias("fname")).groupBy("fname").agg(F.count("*").cast("double").alias("w"))
    want = parse.trees(arcs.weighed(arcs.features(words, ("basic",), forward=True), weights), projective=False, probable=False)
    own = found.select("doc_id", "seq_id", F.posexplode("gov").alias("id", "gov")).withColumn("id", F.col("id") + 1)
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, want.select("doc_id", "seq_id", "id", "gov").collect()))
    assert arcs.forward_heads(sentences.limit(0), tag).count() == 0
    for name in ("turn_trees", "turn_arc_labels"):  # before, pairs of words were rows of an aggregate by arc
        assert not any("gov" in line for line in physical(QUERIES[name](spark, DATA)).splitlines() if "Exchange" in line), name


def test_segments_of_sequences_are_cut_without_windows(spark):
    sequences = spark.createDataFrame([(1, 0, list("abcde")), (1, 1, ["x"]), (2, 0, []), (3, 0, None), (4, 0, ["", "y z", "q"])], "doc_id long, seq_id int, toks array<string>")
    found = segments.array_candidates(sequences.withColumn("values", F.transform("toks", lambda t: F.upper(t))), 3)
    toks = sequences.select("doc_id", "seq_id", F.posexplode("toks").alias("pos", "tok")).withColumn("attrs", F.create_map(F.lit("p1"), F.upper("tok"), F.lit("q"), F.lit("no")))
    old = segments.candidates(toks, 3)
    key = ["doc_id", "seq_id", "pos", "s", segments.phrase(F.col("words"))]
    assert sorted(map(tuple, found.select(*key, segments.value_phrase(F.col("values"))).collect())) == sorted(map(tuple, old.select(*key, segments.attribute_phrase(F.col("attrs"), "p")).collect()))
    assert "Window" not in plan(QUERIES["segment_features"](spark, DATA))


def test_features_of_sequences_equal_those_of_windows(spark):
    rng = random.Random(6)
    kinds = ["Ab", "x.", "Inc.", "Co", "ÉéZ9٣", "a", "", "Long", "w-1", "ǅß"]
    toks = [(i, i % 2, [rng.choice(kinds if i % 3 else ["a", "Ab", "b"] * 9 + ["x."]) for _ in range(rng.randrange(45))]) for i in range(40)] + [(99, 0, None)]
    sequences = spark.createDataFrame(toks, "doc_id long, seq_id int, toks array<string>")
    attrs = lambda t: F.create_map(F.lit("end"), F.when(t.rlike("[.]$"), "yes"))
    text = "cut as antiSuffixFn(2);\npre as prefixFn(9) cross wdShape;\nleft as distToLeft(end,yes);\nright as distToRight(end, yes);\ncompany as nearCorpAbbrev;\nmany as predicateFn(Long, suffixFn(3));"
    found = spec.array_features(sequences, text, attrs)
    rows = sequences.select("doc_id", "seq_id", F.posexplode("toks").alias("pos", "tok")).withColumn("attrs", attrs(F.col("tok")))
    want = spec.features(rows, text).drop("attrs")
    assert "Window" not in plan(found) and "Window" not in plan(QUERIES["shape_features"](spark, DATA))
    assert sorted(map(repr, found.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    assert {r.tok: r.s for r in rows.select("tok", spec.T.shape(F.col("tok")).alias("s")).collect()}["ÉéZ9٣"] == "XxXdd"
    with pytest.raises(ValueError):
        spec.array_features(sequences, "a as wdFn over (0, 1);")
