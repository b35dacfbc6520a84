"""Operators and readers on small rows of their own."""

from pyspark.sql import functions as F

from seqwright.functions import tokens as T
from seqwright.operators import evaluate, tokenize
from seqwright.sources import columns, sinks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "w string").select(column(F.col("w"))).first()[0]


def test_affixes(spark):
    assert one(spark, "abcd", lambda w: T.suffixes(w, 3)) == ["SUF:bcd", "SUF:cd", "SUF:d"]
    assert one(spark, "abcd", lambda w: T.prefixes(w, 3)) == ["PREF:abc", "PREF:ab", "PREF:a"]
    assert one(spark, "ab", lambda w: T.prefixes(w, 3)) == []
    assert one(spark, "abcd", lambda w: T.without_prefixes(w, 2)) == ["SUF:cd", "SUF:bcd"]
    assert one(spark, "abcd", lambda w: T.leading_grams(w, 2, 3)) == ["ab", "bc"]
    assert one(spark, "abcde", lambda w: T.trailing_grams(w, 2, 3)) == ["cd"]
    assert one(spark, "Ab-9", T.shape) == "Xx-d"


def test_span_scores(spark):
    schema = "doc_id int, seq_id int, label string, st int, en int"
    gold = spark.createDataFrame([(1, 0, "A", 0, 1)], schema)
    system = spark.createDataFrame([(1, 0, "A", 0, 1), (1, 0, "B", 3, 3)], schema)
    assert {r.label: r.f1 for r in evaluate.span_scores(gold, system).collect()} == {"A": 1.0, "TOTAL": 1.0}


def test_folds(spark):
    rows = evaluate.folds(spark.range(10), "id", 3).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in rows] == [4, 4, 2]


def test_readers(spark, tmp_path):
    def text(body):
        return spark.createDataFrame([("f", body)], "path string, text string")

    got = columns.basic_columns(text("B-PER\tw=Ada\tcap:2.5\t#:note\nlex\tw=met\n\nA=0.25\tB=0.75\tf\n++\n")).orderBy("seq_id", "pos").collect()
    assert [(r.seq_id, r.pos, r.label) for r in got] == [(0, 0, "B-PER"), (0, 1, "lex"), (1, 0, None)]
    assert got[0].feats == {"w=Ada": 1.0, "cap": 2.5} and got[0].comment == "#:note" and got[2].label_dist == {"A": 0.25, "B": 0.75}
    got = columns.attribute_values(text("2.5 spam len:0.3 hasUrl #doc17\nham x\n")).orderBy("pos").collect()
    assert [(r.label, r.weight, r.comment) for r in got] == [("spam", 2.5, "doc17"), ("ham", 1.0, None)]
    assert got[0].feats == {"len": 0.3, "hasUrl": 1.0}
    got = columns.dependencies(text("1\tShe\t_\tPRP\t_\t_\t2\tnsubj\n2\truns\t_\tVBZ\t_\t_\t0\troot\n")).orderBy("id").collect()
    assert [(r.form, r.gov, r.rel) for r in got] == [("She", 2, "nsubj"), ("runs", 2, "root")]
    body = '{"signal":"Ada met Bob.","asets":[{"type":"ENAMEX","attrs":["type"],"annots":[[0,3,"PER"],[8,11,"PER"]]}]}'
    got = columns.standoff(text(body)).orderBy("st").collect()
    assert [(r.type, r.text, r.attrs) for r in got] == [("ENAMEX", "Ada", {"type": "PER"}), ("ENAMEX", "Bob", {"type": "PER"})]
    (tmp_path / "a.txt").write_text("x")
    assert [r.text for r in columns.files(spark, str(tmp_path), "a[.]txt$").collect()] == ["x"]


def test_more_features(spark):
    from seqwright.functions import spec

    assert one(spark, "abcd", lambda w: T.without_suffixes(w, 2)) == ["PREF:ab", "PREF:abc"]
    assert one(spark, "ab", lambda w: T.without_suffixes(w, 2)) == ["SUF:ab", "PREF:a"]
    rows = [(1, 0, i, t, {"pos": p}) for i, (t, p) in enumerate([("Acme", "N"), ("Steel", "N"), ("Co.", "X"), ("said", "V")])]
    toks = spark.createDataFrame(rows, "doc_id int, seq_id int, pos int, tok string, attrs map<string,string>")
    got = spec.features(toks, "near as nearCorpAbbrev;\nleft as distToLeft(pos,N);\nright as distToRight(pos,V);\ntwo as predicateFn(Two, prefixFn(2), wdFn);").orderBy("pos").collect()
    assert [r.near for r in got] == [["nearCorpAbbrev"], ["nearCorpAbbrev"], [], []]
    assert [r.left for r in got] == [["pos:NLeftWithin-0"], ["pos:NLeftWithin-1"], ["pos:NLeftWithin-1"], ["pos:NLeftWithin-2"]]
    assert [r.right for r in got] == [["pos:VRightWithin-3"], ["pos:VRightWithin-2"], ["pos:VRightWithin-1"], ["pos:VRightWithin-0"]]
    assert [r.two for r in got] == [["Two"]] * 4


def test_dictionary_files_and_folders(spark, tmp_path):
    (tmp_path / "names").write_text("Ada Lovelace\nBob")
    assert {(r.lex_name, r.term) for r in columns.lexicons(columns.files(spark, str(tmp_path))).collect()} == {("names", "Ada"), ("names", "Lovelace"), ("names", "Bob")}
    (tmp_path / "spam").mkdir()
    (tmp_path / "spam" / "1.txt").write_text("buy buy now")
    got = columns.class_folders(columns.files(spark, str(tmp_path / "spam"))).collect()
    assert [(r.label, r.feats) for r in got] == [("spam", {"buy": 1.0, "now": 1.0})]
    body = spark.createDataFrame([("p", "run V X\nrun N\n\nbad 1.5x\nbad 2\n")], "path string, text string")
    assert {r.word: r.properties for r in columns.word_properties(body).collect()} == {"run": ["N", "V", "X"], "bad": ["1.5x", "2"]}
    assert {r.word: r.score for r in columns.word_scores(body).collect()} == {"run": None, "bad": 2.0}


def test_validated_folds(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "id int, label int")
    found = evaluate.validated(rows, "id", 3, lambda d: d.count(), lambda d, m: d.withColumn("learnt", F.lit(m)))
    assert sorted((r.id, r.fold, r.learnt) for r in found.collect()) == [(i, i // 10, 20) for i in range(30)]


def test_posts_of_markup(spark):
    text = '<Post user="a" dialog-act="ask">What <b>is</b>\nthis?</Post> x <Post>y</Post>'
    got = columns.posts(spark.createDataFrame([("f", text)], "path string, text string")).orderBy("post").collect()
    assert [(r.post, r.attrs, r.toks) for r in got] == [(0, {"user": "a", "dialog-act": "ask"}, ["What", "is", "this?"]), (1, {}, ["y"])]


def test_posts_round_trip_with_marks(spark):
    rows = spark.createDataFrame([("f", 0, {"user": 'a"<b>&amp;'}, ["x<y", "</Post>", "&lt;", '"q"', "a>b"]), ("f", 1, {"user": "u"}, [])], "path string, post int, attrs map<string,string>, toks array<string>")
    back = columns.posts(sinks.post_markup(rows)).orderBy("post").collect()
    assert [(r.attrs, r.toks) for r in back] == [({"user": 'a"<b>&amp;'}, ["x<y", "</Post>", "&lt;", '"q"', "a>b"]), ({"user": "u"}, [])]


def test_sentences_then_bound(spark):
    toks = spark.createDataFrame([(1, i, t) for i, t in enumerate("a b. c d! e f g h".split())] + [(2, 0, "x")], "doc_id int, pos int, tok string")
    found = tokenize.bounded(tokenize.sentences(toks), 3).orderBy("doc_id", "seq_id", "pos").collect()
    assert [(r.doc_id, r.seq_id, r.pos, r.tok) for r in found] == [(1, 0, 0, "a"), (1, 0, 1, "b."), (1, 1, 0, "c"), (1, 1, 1, "d!"), (1, 2, 0, "e"), (1, 2, 1, "f"), (1, 2, 2, "g"), (1, 3, 0, "h"), (2, 0, 0, "x")]
