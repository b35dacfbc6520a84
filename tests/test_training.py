"""Segment and soft-label fields, posteriors and parsers against enumeration and numeric gradients."""

import itertools
import math
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqwright.operators import crf, maxent, optimize, parse, scope, segments

SCORES = np.array([[0.5, -1.0], [1.5, 0.3], [0.0, 0.7], [-0.4, 0.6]])
TRANSITIONS = np.array([[0.3, -0.2], [0.1, 0.5]])
ARCS = np.random.default_rng(3).normal(size=(5, 5))
ARCS[:, 0] = -np.inf
ARCS[range(5), range(5)] = -np.inf


def trees(projective):
    for heads in itertools.product(range(5), repeat=4):
        def up(v, heads=heads):
            for _ in range(5):
                v = heads[v - 1] if v else 0
            return v == 0
        arcs = [(min(h, v), max(h, v)) for v, h in enumerate(heads, 1)]
        crossing = any(a < c < b < d for (a, b), (c, d) in itertools.permutations(arcs, 2))
        if all(h != v for v, h in enumerate(heads, 1)) and all(up(v) for v in range(1, 5)) and not (projective and crossing):
            yield list(heads), sum(ARCS[h, v] for v, h in enumerate(heads, 1))


@pytest.mark.parametrize("projective", [True, False])
def test_arc_probabilities_equal_enumeration(projective):
    ways = list(trees(projective))
    z = math.log(sum(math.exp(s) for _, s in ways))
    found, p = parse.projective_probabilities(ARCS) if projective else (parse.log_partition(ARCS), parse.arc_probabilities(ARCS))
    assert math.isclose(found, z, rel_tol=1e-9)
    assert np.allclose(p[:, 1:].sum(axis=0), 1)
    for h, v in itertools.product(range(5), range(1, 5)):
        assert math.isclose(p[h, v], sum(math.exp(s - z) for heads, s in ways if heads[v - 1] == h), abs_tol=1e-9)


def test_best_trees_equal_enumeration():
    ways = sorted(trees(False), key=lambda w: -w[1])
    found = parse.best_heads(ARCS, 12)
    assert [h for _, h in found] == [h for h, _ in ways[:12]]
    assert len(parse.best_heads(ARCS, 10_000)) == len(ways)
    assert parse.best_heads(np.full((3, 3), -np.inf), 2) == []


def segmentations(n, longest):
    if n == 0:
        yield []
    for first in range(max(0, n - longest), n):
        for rest in segmentations(first, longest):
            for y in range(2):
                yield [*rest, (first, n - 1, y)]


def test_segment_marginals_equal_enumeration():
    ways = list(segmentations(4, 3))
    value = [sum(SCORES[i, y] for a, b, y in w for i in range(a, b + 1)) + sum(TRANSITIONS[p[2], q[2]] for p, q in itertools.pairwise(w)) for w in ways]
    z, node, edge = crf.segment_marginals(SCORES, TRANSITIONS, 3)
    assert math.isclose(z, math.log(sum(map(math.exp, value))), rel_tol=1e-9)
    for i, y in itertools.product(range(4), range(2)):
        assert math.isclose(node[i, y], sum(math.exp(v - z) for w, v in zip(ways, value) if any(a <= i <= b and k == y for a, b, k in w)), rel_tol=1e-9)
    for pair in itertools.product(range(2), repeat=2):
        assert math.isclose(edge[pair], sum(math.exp(v - z) * sum((p[2], q[2]) == pair for p, q in itertools.pairwise(w)) for w, v in zip(ways, value)), rel_tol=1e-9)


ROW = {"fids": [[0], [0, 1], [2], [1]], "vals": [[1.0], [0.5, 2.0], [1.0], [1.5]], "y": [0, 0, 1, 1], "begin": [True, False, False, True], "p": [[0.2, 0.8], [0.6, 0.4], [0.5, 0.5], [1.0, 0.0]]}
SENTENCE = {"a": [{"gov": g, "id": i, "gold": (g, i) in ((0, 2), (2, 1), (2, 3)), "fids": [(g * 3 + i) % 6], "vals": [1.0 + g / 2]} for g in range(4) for i in range(1, 4) if g != i]}


@pytest.mark.parametrize(("one", "row", "size"), [(crf.segment_term(2, 2), ROW, 10), (crf.soft_term(2), ROW, 10), (parse.arc_term(), SENTENCE, 6), (parse.arc_term(projective=False), SENTENCE, 6)])
def test_gradients_are_numeric_ones(one, row, size):
    x, grad, step = np.random.default_rng(1).normal(size=size), np.zeros(size), 1e-5
    one(row, x, grad)
    for i in range(size):
        e = np.eye(size)[i] * step
        assert math.isclose(grad[i], (one(row, x + e, np.zeros(size)) - one(row, x - e, np.zeros(size))) / (2 * step), abs_tol=1e-6)


def test_training_learns(spark):
    toks = spark.createDataFrame([(d, 0, i, w, "A" if w == "a" else "lex", {w: 1.0}) for d in range(6) for i, w in enumerate("aabcab"[d % 3 :])], "doc_id int, seq_id int, pos int, tok string, label string, feats map<string,double>")
    seqs = crf.sequences(toks, ["A", "lex"], buckets=64)
    begins = seqs.withColumn("begin", F.transform("y", lambda y: y == 1))
    model, longest = crf.fit_segments(begins, ["A", "lex"], buckets=64)
    assert longest == 2
    soft = crf.fit_soft(seqs.withColumn("p", F.transform("y", lambda y: F.when(y == 0, F.array(F.lit(0.9), F.lit(0.1))).otherwise(F.array(F.lit(0.1), F.lit(0.9))))), ["A", "lex"], buckets=64)
    found = {(r.doc_id, r.pos): r.probs for r in crf.posteriors(seqs, soft).collect()}
    for r in toks.collect():
        assert (found[r.doc_id, r.pos]["A"] > 0.5) == (r.tok == "a")
        assert math.isclose(sum(found[r.doc_id, r.pos].values()), 1, rel_tol=1e-9)
    sure = crf.decode(seqs, model)
    assert {(r.doc_id, r.pos): r.label_pred for r in sure.collect()} == {(r.doc_id, r.pos): r.label for r in toks.collect()}
    key = F.struct("doc_id", "seq_id", "pos").alias("id")
    masses = {(r.fname, r.cls): r.share for r in maxent.feature_masses(toks.select(key, "feats"), crf.posteriors(seqs, soft).select(key, "probs")).collect()}
    assert masses["a", "A"] > 0.5 > masses["b", "A"]


@pytest.mark.parametrize("projective", [True, False])
def test_parser_learns(spark, projective):
    gold = {1: 2, 2: 0, 3: 2}
    arcs = spark.createDataFrame([(d, 0, g, i, gold[i] == g, {f"{'r' if g == 0 else g - i}": 1.0, f"h{g == 2}": 1.0}) for d in range(4) for g in range(4) for i in range(1, 4) if g != i], "doc_id int, seq_id int, gov int, id int, gold boolean, feats map<string,double>")
    weights = parse.fit(arcs, projective=projective, buckets=256)
    found = parse.trees(parse.scored(arcs, weights), projective=projective).collect()
    assert len(found) == 12 and all(r.gov == gold[r.id] for r in found)


def test_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id int, seq_id int, pos int, tok string, attrs map<string,string>, s int")
    assert segments.candidates(none.drop("s"), 3).count() == 0 and scope.cues(none).count() == 0 and scope.default_scopes(none).count() == 0
    odd = spark.createDataFrame([(1, 0, 0, None, None, 7), (1, 0, 1, "b", {"type": "x"}, 7), (None, 0, 0, "c", {}, 7)], none.schema)
    found = {(r.doc_id, r.pos, r.s): r for r in segments.candidates(odd, 2).withColumn("a", segments.attribute_phrase(F.col("attrs"), "t")).collect()}
    assert found[1, 1, 1].words == ["", "b"] and found[1, 1, 1].a == "attrs=_x_" and len(found) == 4
    assert [(r.cue, r.en) for r in scope.default_scopes(odd).collect()] == [(1, 1)]
    assert {r.cue_start for r in scope.cues(odd).where("doc_id = 1").collect()} == {1}


def test_adapted_steps_equal_a_plain_loop(spark):
    values = [3.0, -1.0, 2.0, 5.0, 0.5, -2.0, 1.0, 4.0, 4.0, 1.0, 0.0, 2.0]

    def term(row, x, grad):
        grad[0] += x[0] - row["v"]
        grad[1] += 2 * (x[1] + row["v"])
        return 0.0

    x, etas, moved = [0.0] * 3, [0.1] * 3, [0.0] * 3
    for _ in range(2):
        start, middle = x[:], x[:]
        moved = [0.0] * 3
        for t in range(6):
            pair = values[2 * t : 2 * t + 2]
            for i, g in enumerate([sum(x[0] - v for v in pair), sum(2 * (x[1] + v) for v in pair)]):
                moved[i] = etas[i] * g + 0.5 * moved[i]
                x[i] -= moved[i]
            if t % 4 == 3:
                high, low = 1.9899 * 0.95 / 0.0099, 0.0002 * 0.95 / 0.0099
                for i in range(3):
                    first, second = middle[i] - start[i], x[i] - middle[i]
                    etas[i] *= 0.9999 if first == 0 else (high + max(-0.95, min(0.95, second / first))) / (high + 0.95 + low)
                start = x[:]
            elif t % 2 == 1:
                middle = x[:]
    rows = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    found = optimize.averaged_sgd(rows, term, np.zeros(3), epochs=2, momentum=0.5, batch=2, period=2)
    assert np.allclose(found, x, rtol=1e-6)


def test_chains_together_equal_sequences_one_by_one():
    rng = np.random.default_rng(3)
    rows = []
    for n, known in ((3, True), (1, True), (5, False), (3, False), (2, True)):
        y = [int(v) if known or i % 2 else None for i, v in enumerate(rng.integers(0, 2, n))]
        rows.append({"y": y, "fids": [[], *([int(f) for f in rng.integers(0, 4, 2)] for _ in range(n - 1))], "vals": [[], *([0.5, -1.5] for _ in range(n - 1))], "weight": float(1 + n % 3)})
    batch = pa.RecordBatch.from_pylist(rows)
    for x in (rng.normal(size=12), np.append(rng.normal(size=8), [400.0, -400.0, 3.0, 2.0])):
        want, got = np.zeros(12), np.zeros(12)
        loss = 0.0
        for row in rows:
            own = np.zeros(12)
            loss += row["weight"] * crf.term(2)(row, x, own)
            want += row["weight"] * own
        found = sum(crf.piece_term(2)(piece, x, got) for _, _, piece in crf.chains(batch, 2))
        assert np.isclose(found, loss) and np.allclose(got, want)
        for row, (_, _, piece) in ((r, next(crf.chains(batch.slice(i, 1), 2))) for i, r in enumerate(rows)):
            scores = crf._scores(row, x[:8].reshape(4, 2))
            assert piece.best(piece.scores(x[:8].reshape(4, 2)), x[8:].reshape(2, 2))[piece.to].tolist() == crf.best_path(scores, x[8:].reshape(2, 2))


def test_equal_sequences_are_evaluated_once(spark):
    rows = spark.createDataFrame([([0], [[1]], [[1.0]])] * 50 + [([1], [[2]], [[1.0]])], "y array<int>, fids array<array<int>>, vals array<array<double>>")
    pieces = optimize.packed(rows, F.size("y"), lambda batch: (p for _, _, p in crf.chains(batch, 2)))
    found = [pickle.loads(r.piece) for r in pieces.collect()]
    assert pieces.rdd.getNumPartitions() == 1 and sum(len(p.weight) for p in found) == 2 and sum(p.weight.sum() for p in found) == 51
