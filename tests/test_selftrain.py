"""Self-training against plain sums, and on words that no labelled row has."""

import random

import pytest
from pyspark.sql import functions as F

from seqwright.operators import maxent, selftrain


def table(spark, rows):
    return spark.createDataFrame([(i, label, None if words is None else {w: 1.0 for w in words}) for i, label, words in rows], "id long, label string, feats map<string,double>")


def test_induced_features_equal_plain_sums(spark):
    r = random.Random(5)
    rows = [(i, None, r.sample(["a", "b", "A", "B", "c", "new"], r.randint(0, 4))) for i in range(30)] + [(30, None, None)]
    masses = {(w, c): r.random() * 3 for w in "abABc" for c in "xy"}
    df = spark.createDataFrame([(w, c, m) for (w, c), m in masses.items()], "fname string, cls string, mass double")
    kind = lambda f: F.when(F.upper(f) == f, "upper").otherwise("lower")
    found = {x.id: x.feats for x in selftrain.induced(table(spark, rows), df, ["x", "y"], kind).collect()}
    assert len(found) == len(rows)
    for i, _, words in rows:
        want = {w: 1.0 for w in words or ()}
        for name, own in (("upper", [w for w in words or () if w in "AB"]), ("lower", [w for w in words or () if w in "abc"])):
            if own:
                m = {c: 1 + sum(masses[w, c] for w in own) for c in "xy"}
                want |= {f"$=IND=$|{name}|{c}": m[c] / (m["x"] + m["y"]) for c in "xy"}
        assert found[i] == pytest.approx(want)


def test_rounds_reach_words_without_labels(spark):
    r = random.Random(7)
    drawn = lambda c, low, high, k: [f"{c}{r.randrange(low, high)}" for _ in range(k)]
    labelled = [(i, "xy"[i % 2], drawn("xy"[i % 2], 0, 5, 3)) for i in range(20)]
    unlabelled = [(i, None, drawn("xy"[i % 2], 0, 5, 3) + drawn("xy"[i % 2], 5, 15, 3)) for i in range(200)]
    new = [(i, "xy"[i % 2], drawn("xy"[i % 2], 5, 15, 3)) for i in range(40)]
    models = selftrain.rounds(table(spark, labelled), table(spark, unlabelled), 1, steps=15)
    assert [m.masses is None for m in models] == [True, False]
    probs = {x.id: x.probs for x in models[0].scores(table(spark, unlabelled)).collect()}
    want = {}
    for i, _, words in unlabelled:
        for w in set(words):
            for c, p in probs[i].items():
                want[w, c] = want.get((w, c), 0) + p
    assert {(x.fname, x.cls): x.mass for x in models[1].masses.collect()} == pytest.approx(want)
    right = []
    for m in models:
        found = {x.id: x.label_pred for x in m.scores(table(spark, new)).collect()}
        right.append(sum(found[i] == label for i, label, _ in new))
    assert right[0] <= 20 and right[1] == 40


def test_odd_rows(spark):
    none = table(spark, [(1, None, ["a"])])
    models = selftrain.rounds(none, none, 2)
    assert len(models) == 1 and [tuple(x) for x in models[0].scores(none).collect()] == [(1, None, None)]
    empty = none.limit(0)
    masses = spark.createDataFrame([], "fname string, cls string, mass double")
    assert selftrain.induced(empty, masses, ["x"]).count() == 0
    assert selftrain.induced(none, masses, ["x"]).first().feats == {"a": 1.0}
    assert maxent.feature_masses(empty, spark.createDataFrame([], "id long, probs map<string,double>")).count() == 0
