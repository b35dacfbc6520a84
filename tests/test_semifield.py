"""Fields over segments against enumeration, numeric gradients and labelled rows."""

import itertools
import math
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqwright.operators import segments, semifield

RNG = np.random.default_rng(7)
NODE, PAIR = RNG.normal(size=(5, 3, 2)), RNG.normal(size=(5, 3, 2, 2))
NODE[[0, 0, 1], [1, 2, 2]] = -np.inf
NODE[3, 1] = -np.inf  # no segment of the places 2 and 3


def ways(n):
    if n == 0:
        yield []
    for d in range(min(n, 3)):
        if np.isfinite(NODE[n - 1, d, 0]):
            for rest in ways(n - 1 - d):
                yield from ([*rest, (n - 1, d, y)] for y in range(2))


def value(way):
    return sum(NODE[w] for w in way) + sum(PAIR[q[0], q[1], p[2], q[2]] for p, q in itertools.pairwise(way))


def test_segmentations_equal_enumeration():
    every = list(ways(5))
    (z, other), (own, _), (pairs, _) = semifield.marginals(np.stack([NODE, -abs(NODE)]), np.stack([PAIR, PAIR]))
    assert z != other
    assert math.isclose(z, math.log(sum(math.exp(value(w)) for w in every)), rel_tol=1e-9)
    for at in itertools.product(range(5), range(3), range(2)):
        assert math.isclose(own[at], sum(math.exp(value(w) - z) for w in every if at in w), abs_tol=1e-9)
        for before in range(2):
            want = sum(math.exp(value(w) - z) for w in every if any(q == at and p[2] == before for p, q in itertools.pairwise(w)))
            assert math.isclose(pairs[at[0], at[1], before, at[2]], want, abs_tol=1e-9)
    assert semifield.best(NODE, PAIR) == max(every, key=value)


def test_ties_and_no_tiling():
    zero = np.zeros((2, 2, 2))
    zero[0, 1] = -np.inf
    assert semifield.best(zero, np.zeros((2, 2, 2, 2))) == [(0, 0, 0), (1, 0, 0)]
    gap = np.full((2, 1, 2), -np.inf)
    assert semifield.best(gap, np.zeros((2, 1, 2, 2))) == [] and semifield.marginals(gap[None], np.zeros((1, 2, 1, 2, 2)))[0][0] == -np.inf


def candidates(spark, texts="aab ba aabb abba b"):
    """Runs of a letter are segments: of two letters X, of one Y."""
    toks = [(d, 0, i + 3, c, i == 0 or t[i - 1] != c) for d, t in enumerate(texts.split()) for i, c in enumerate(t)]
    df = spark.createDataFrame(toks, "doc_id int, seq_id int, pos int, tok string, begin boolean").withColumn("label", F.lit("seg"))
    found = segments.candidates(df, 2)
    gold = segments.label_sizes(df).where("s >= 0").select("doc_id", "seq_id", "pos", "s", F.when(F.col("s") == 1, "X").otherwise("Y").alias("label"))
    named = F.array_distinct(F.array(F.concat(F.lit("p="), segments.phrase(F.col("words"))), segments.size_name(F.col("s"))))
    feats = F.map_from_entries(F.transform(named, lambda n: F.struct(n, F.lit(1.0))))
    return found.join(gold, ["doc_id", "seq_id", "pos", "s"], "left").withColumns({"feats": feats, "edges": F.create_map(segments.size_name(F.col("s"), edge=True), F.lit(0.5))})


def test_gradient_is_the_numeric_one(spark):
    seqs = semifield.sequences(candidates(spark), ["X", "Y"], 2, buckets=8, edge_buckets=3)
    batch = seqs.drop("doc_id", "seq_id").toArrow().combine_chunks().to_batches()[0]
    one, size = semifield.term(2, 2, 8), 8 * 2 + 3 * 4
    x, grad = np.random.default_rng(2).normal(size=size), np.zeros(size)
    assert one(batch, x, grad) > 0
    for i in range(size):
        e = np.eye(size)[i] * 1e-5
        assert math.isclose(grad[i], (one(batch, x + e, np.zeros(size)) - one(batch, x - e, np.zeros(size))) / 2e-5, abs_tol=1e-5)


def test_learns_whole_segments(spark):
    found = candidates(spark)
    assert semifield.longest_label(found) == 2
    seqs = semifield.sequences(found, ["X", "Y"], 2)
    model = semifield.fit(seqs, ["X", "Y"], 2)
    got = semifield.decode(seqs, model).collect()
    want = found.where("label IS NOT NULL").collect()
    assert {(r.doc_id, r.pos, r.s, r.label_pred) for r in got} == {(r.doc_id, r.pos, r.s, r.label) for r in want}
    assert all(0.5 < r.confidence <= 1 + 1e-9 for r in got)


@pytest.mark.parametrize("labelled", [True, False])
def test_odd_rows(spark, labelled):
    """Null maps, values, labels and sizes, a repeated row, a gap, a segment that starts too early; an empty table."""
    rows = [
        (1, 0, 0, 0, {"a": None}, None, "X", "x"), (1, 0, 0, 0, {"a": 1.0}, {"e": None}, "X", "x"), (1, 0, 1, 0, None, {"e": 1.0}, "Y", None), (1, 0, 1, 5, {"a": 1.0}, None, None, "x"),
        (1, 0, 1, None, {"a": 1.0}, None, None, "x"), (1, 0, None, 0, {"a": 1.0}, None, None, "x"), (2, 0, 4, 1, {"a": 1.0}, None, None, "x"), (None, None, 0, 0, {"a": 1.0}, None, None, "x"), (3, 0, 0, 0, {"a": 1.0}, None, "Z", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id int, seq_id int, pos int, s int, feats map<string,double>, edges map<string,double>, label string, y string")
    df = df if labelled else df.drop("label", "edges")
    seqs = semifield.sequences(df, ["X", "Y"], 2, buckets=16)
    model = semifield.fit(seqs, ["X", "Y"], 2, buckets=16)
    assert np.any(model.state) == labelled
    assert sorted(((r.doc_id, r.pos, r.s) for r in semifield.decode(seqs, model).collect()), key=repr) == [(1, 0, 0), (1, 1, 0), (3, 0, 0), (None, 0, 0)]
    assert semifield.decode(seqs.where("false"), model).count() == 0
    assert not np.any(semifield.fit(seqs.where("false"), ["X", "Y"], 2, buckets=16).state)


def test_a_weight_counts_a_sequence_as_often():
    one = {"n": 2, "place": [0, 1, 1], "s": [0, 0, 1], "y": [0, 1, -1], "n_f": [1, 2, 1], "n_g": [0, 1, 1], "fids": [0, 1, 2, 3], "vals": [1.0, 0.5, 1.0, 2.0], "gids": [0, 1], "gvals": [1.0, 0.5]}
    other = one | {"y": [-1, -1, 0], "fids": [3, 2, 2, 0]}
    x, weighted, plain = RNG.normal(size=4 * 2 + 2 * 4), np.zeros(16), np.zeros(16)
    term = semifield.term(2, 2, 4)
    loss = term(pa.RecordBatch.from_pylist([one | {"weight": 3.0}, other | {"weight": 1.0}]), x, weighted)
    assert math.isclose(loss, term(pa.RecordBatch.from_pylist([one, other, one, one]), x, plain)) and np.allclose(weighted, plain)
    pieces = [pickle.loads(pickle.dumps((found, found.gold()))) for found in semifield.lattices(pa.RecordBatch.from_pylist([one | {"weight": 3.0}, other | {"weight": 1.0}]), 2, 2)]
    again = np.zeros(16)
    assert math.isclose(loss, sum(semifield.piece_term(2, 2, 4)(p, x, again) for p in pieces)) and np.allclose(again, plain)


def test_equal_features_of_candidates_are_one_set(spark):
    """Scores and sums over candidates grow with kinds of features, not with candidates; each cell has its own features nonetheless."""
    seqs = semifield.sequences(candidates(spark, "aab aab ab aab"), ["X", "Y"], 2, buckets=64)
    batch = seqs.drop("doc_id", "seq_id").toArrow().combine_chunks().to_batches()[0]
    for found in semifield.lattices(batch, 2, 2):
        assert found.sets <= 5 and found.edge_sets == 2 and len(found.cells) == len(found.rows) * (2 * found.n - 1)
        assert np.all(found.block[[0, *range(1, found.n)], 0] >= 0)
    own = semifield._sets(np.array([2, 0, 0, 2, 3]), np.array([5, 1, 5, 1, 1]), np.array([2.0, 1.0, 2.0, 1.0, 1.0]), 4)
    assert own[1] == 4 and len(own[2]) == 5 and len(set(own[0])) == 4


def test_labels_meet_candidates_without_a_join(spark):
    toks = [(d, 0, i, c, i == 0 or t[i - 1] != c) for d, t in enumerate(["aab", "ba"]) for i, c in enumerate(t)]
    df = spark.createDataFrame(toks, "doc_id int, seq_id int, pos int, tok string, begin boolean").withColumn("label", F.upper("tok"))
    sized = segments.label_sizes(df)
    key = ["doc_id", "seq_id", "pos", "s", "words", "label"]
    found = segments.labelled(sized, 2)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = segments.candidates(df, 2).join(sized.where("s >= 0").select(*key[:4], "label"), key[:4], "left")
    assert sorted(map(tuple, found.select(key).collect()), key=repr) == sorted(map(tuple, want.select(key).collect()), key=repr)


def test_equal_days_are_each_found(spark, tmp_path, monkeypatch):
    from seqwright.plans import catalogue

    day = "timestamp'2024-01-0{} 0{}:00:00'"
    rows = [f"({u * 10 + h}, {day.format(1 + u % 2, h)}, {u if u else 'CAST(NULL AS INT)'}, '{t}', {v})" for u in range(6) for h, (t, v) in enumerate([("x", 5.0), ("x", 25.0), ("y", 45.0)] if u < 5 else [("y", 5.0)])]
    spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(event_id, ts, user_id, event_type, value)").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    fit = semifield.fit
    monkeypatch.setattr(semifield, "fit", lambda seqs, *a, **b: seen.append(sorted(r.weight for r in seqs.collect())) or fit(seqs, *a, **b))
    found = catalogue.event_runs(spark, str(tmp_path)).collect()
    assert seen == [[1.0, 5.0]]
    assert sorted({(repr(r.doc_id), r.seq_id) for r in found}) == sorted({(repr(u or None), 8766 + u % 2) for u in range(6)})
    assert sum(r.s + 1 for r in found) == 16 and len({(r.pos, r.s, r.label_pred) for r in found if r.doc_id in (None, 1, 2, 3, 4)}) == len([r for r in found if r.doc_id == 1])
