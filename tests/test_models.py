"""Maximum entropy, conditional random fields, conversions and the feature language on small rows of their own."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqwright.functions import spec
from seqwright.operators import convert, crf, maxent, optimize, sharded
from seqwright.sources import columns

SCORES = np.array([[0.5, -1.0, 0.2], [1.5, 0.3, -0.2], [0.0, 0.7, 0.1], [-0.4, 0.6, 0.9]])
TRANSITIONS = np.array([[0.3, -0.2, 0.0], [0.1, 0.5, -0.6], [-0.1, 0.2, 0.4]])


def total(path):
    return sum(SCORES[i, y] for i, y in enumerate(path)) + sum(TRANSITIONS[a, b] for a, b in itertools.pairwise(path))


def test_chain_equals_enumeration():
    paths = list(itertools.product(range(3), repeat=4))
    z, node, edge = crf.marginals(SCORES, TRANSITIONS)
    weight = {p: math.exp(total(p) - z) for p in paths}
    assert math.isclose(sum(weight.values()), 1, rel_tol=1e-9)
    for i, y in itertools.product(range(4), range(3)):
        assert math.isclose(node[i, y], sum(w for p, w in weight.items() if p[i] == y), rel_tol=1e-9)
    assert math.isclose(edge[0, 1], sum(w * sum(q == (0, 1) for q in itertools.pairwise(p)) for p, w in weight.items()), rel_tol=1e-9)
    assert tuple(crf.best_path(SCORES, TRANSITIONS)) == max(paths, key=total)


def test_segments_equal_enumeration():
    def ways(n):
        if n == 0:
            yield []
        for first in range(max(0, n - 2), n):
            for rest in ways(first):
                for y in range(3):
                    yield [*rest, (first, n - 1, y)]

    def value(segments):
        return sum(SCORES[a : b + 1, y].sum() for a, b, y in segments) + sum(TRANSITIONS[p[2], q[2]] for p, q in itertools.pairwise(segments))

    assert crf.best_segments(SCORES, TRANSITIONS, 2) == max(ways(4), key=value)


@pytest.mark.parametrize("y", [[0, 1, 1], [0, None, 2]])
def test_chain_gradient_equals_differences(y):
    row = {"fids": [[0, 1], [2], []], "vals": [[1.0, 0.5], [2.0], []], "y": y}
    x = np.random.default_rng(1).normal(size=3 * 3 + 9)
    one, grad = crf.term(3), np.zeros(18)
    one(row, x, grad)
    for i in range(18):
        step = np.eye(18)[i] * 1e-5
        slope = (one(row, x + step, np.zeros(18)) - one(row, x - step, np.zeros(18))) / 2e-5
        assert math.isclose(grad[i], slope, abs_tol=1e-6)


def test_lbfgs_finds_the_least_value():
    found = optimize.lbfgs(lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3)), np.zeros(2))
    assert np.allclose(found, 3, atol=1e-4)


def test_chain_learns(spark):
    rows = [(d, 0, i, "AB"[(d + i) % 2], {"odd" if (d + i) % 2 else "even": 1.0}) for d in range(12) for i in range(5)]
    toks = spark.createDataFrame(rows, "doc_id int, seq_id int, pos int, label string, feats map<string,double>")
    seqs = crf.sequences(toks, ["A", "B"], buckets=64)
    for how in ({"steps": 10}, {"method": "sgd", "steps": 3, "l1": 0.001}):
        found = crf.decode(seqs, crf.fit(seqs, ["A", "B"], buckets=64, **how)).join(toks, ["doc_id", "seq_id", "pos"])
        assert found.where("label_pred <> label").count() == 0 and found.count() == 60
    assert crf.decode(seqs.limit(0), crf.Model(["A"], np.zeros((64, 1)), np.zeros((1, 1)))).count() == 0


def test_maxent_learns_and_takes_nulls(spark):
    rows = [(i, "xy"[i % 2], 1.0, {"f" if i % 2 else "g": 1.0}) for i in range(20)] + [(20, None, None, None)]
    rows = spark.createDataFrame(rows, "id int, label string, weight double, feats map<string,double>")
    found = {r.id: r for r in maxent.predict(rows, maxent.fit(rows, buckets=64)).collect()}
    assert len(found) == 21 and all(found[i].label_pred == "xy"[i % 2] and found[i].prob > 0.5 for i in range(20))
    assert maxent.predict(rows, maxent.fit(rows.limit(0), buckets=64)).where("label_pred IS NULL AND prob = 0").count() == 21


def test_inline_round_trip(spark):
    docs = spark.createDataFrame([(1, '<s><N type="PER">Ada L</N> met <N>Bob</N> .</s> < x'), (2, "none"), (3, None), (4, "")], "doc_id int, text string")
    spans = convert.inline_spans(docs)
    assert sorted((r.tag, r.st, r.en, (r.attrs or {}).get("type")) for r in spans.collect()) == [("N", 0, 5, "PER"), ("N", 10, 13, None), ("s", 0, 15, None)]
    bare = docs.withColumn("text", convert.strip_tags(F.col("text")))
    back = {r.doc_id: r.text for r in convert.inline_text(bare, spans).collect()}
    assert back == {1: "<s><N>Ada L</N> met <N>Bob</N> .</s> < x", 2: "none", 3: "", 4: ""}


def test_standoff_round_trip(spark):
    docs = spark.createDataFrame([(1, "Ada met Bob.")], "doc_id int, text string")
    spans = spark.createDataFrame([(1, "N", 0, 3, {"type": "PER"}), (1, "N", 8, 11, {"type": "PER"})], "doc_id int, type string, st int, en int, attrs map<string,string>")
    written = convert.standoff_json(docs, spans).select(F.lit("f").alias("path"), F.col("json").alias("text"))
    assert [(r.text, r.attrs) for r in columns.standoff(written).orderBy("st").collect()] == [("Ada", {"type": "PER"}), ("Bob", {"type": "PER"})]


def test_merged_and_iob(spark):
    schema = "doc_id int, st int, en int, attrs map<string,string>"
    a = spark.createDataFrame([(1, 0, 3, {"k": "a"}), (1, 4, 6, {})], schema)
    b = spark.createDataFrame([(1, 0, 5, {"k": "b"}), (1, 6, 8, {"j": "c"})], schema)
    assert [(r.st, r.en, r.attrs) for r in convert.merged(a, b).orderBy("st").collect()] == [(0, 5, {"k": "b"}), (6, 8, {"j": "c"})]
    rows = spark.createDataFrame([(1, 0, i, t) for i, t in enumerate(["I-P", "I-P", "B-P", "O", "I-Q"])], "doc_id int, seq_id int, pos int, iob string")
    assert [(r.label, r.begin) for r in convert.iob_labels(rows).orderBy("pos").collect()] == [("P", True), ("P", False), ("P", True), ("lex", True), ("Q", True)]


def test_specification(spark):
    toks = spark.createDataFrame([(1, 0, 0, "Ab"), (1, 0, 1, "x"), (1, 0, 2, "Ab")], "doc_id int, seq_id int, pos int, tok string")
    text = "a as suffixFn(2) over (0 to 1);\nb as (wdFn ngram (-1,0)) displaced;\nc as regexpFn(CAP,^[A-Z]) ngram (0,1);\nd as regexpFn(CAP,^[A-Z]) ngram (0,1) SUCCEED;\ne as edgeFn TRANSITION;"
    got = spec.features(toks, text).orderBy("pos").collect()
    assert got[0].a == ["0@SUF:Ab", "0@SUF:b"] and got[1].a == ["1@SUF:Ab", "1@SUF:b"]
    assert got[2].b == ["START^Ab"] and got[0].b == [] and got[0].c == [] and got[2].c == ["CAP^END"] and got[0].d == ["CAP^"] and got[0].e == [":E:"]
    assert spec.edge_names(text) == ["e"]
    with pytest.raises(ValueError):
        spec.features(toks, "a as noFn;")


def test_maxent_keeps_words_apart_and_ends_at_the_optimum(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "xy"[i % 2], {f"own{i}": 1.0, **{f"w{w}": 1.0 for w in rng.integers(0, 9, 3)}}) for i in range(40)] + [(40, None, {"unseen": 1.0})]
    rows = spark.createDataFrame(rows, "id int, label string, feats map<string,double>")
    model = maxent.fit(rows)
    assert len(model.keys) == len({f for r in rows.where("label IS NOT NULL").collect() for f in r.feats}) + 1
    want = np.zeros_like(model.weights)
    at = {k: i for i, k in enumerate(model.keys.tolist())}
    # At the optimum the weights equal the prior's variance times the residuals of their features.
    for r in maxent._hashed(rows.where("label IS NOT NULL"), None).collect():
        s = sum(model.weights[at[f]] for f in r.fids)
        miss = np.eye(2)["xy".index(r.label)] - np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        for f in r.fids:
            want[at[f]] += miss
    assert np.allclose(model.weights, want, atol=0.02)
    assert maxent.predict(rows, model).count() == 41


def test_registered_models_train_until_convergence(spark, monkeypatch):
    from seqwright.plans import catalogue

    ends = []

    def seen(objective, start, *, steps=200, **how):
        x = lbfgs(objective, start, steps=steps, **how)
        ends.append((steps, objective(x)[0], objective(lbfgs(objective, x, steps=3, **how))[0]))
        return x

    lbfgs = optimize.lbfgs
    monkeypatch.setattr(optimize, "lbfgs", seen)
    met = []
    minimise = sharded.minimise

    def sharded_end(problem, **how):
        state, values = minimise(problem, **how)
        met.append(values[-1])
        return state, values

    monkeypatch.setattr(sharded, "minimise", sharded_end)
    fitted = []
    monkeypatch.setattr(sharded, "fit", lambda rows, fit=sharded.fit: fitted.append(rows) or fit(rows))
    for name in ("crf_events", "maxent_quality"):
        assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    maxent.fit(fitted[0])  # the same objective with a vector on the driver
    assert len(ends) == 2 and len(met) == 1 and met[0] - ends[1][2] <= 1e-3 * abs(met[0])
    for steps, value, further in ends:
        assert steps == 200 and value - further <= 1e-3 * abs(value)
