"""Ranking training against the same objective in numpy."""

import random

import numpy as np
import pytest

from seqwright.operators import maxent, ranking

SCHEMA = "group_id string, alt_id int, prob double, feats map<string,double>, score string"


def alternatives():
    rng = random.Random(11)
    rows = []
    for g in range(30):
        for a in range(60 if g == 0 else rng.randrange(1, 6)):
            feats = {f"w{rng.randrange(12)}": rng.choice([1.0, -0.5, 2.0]) for _ in range(rng.randrange(4))}
            good = rng.random() < 0.4
            rows.append((f"g{g}", a, rng.choice([0.5, 2.0]) if good else rng.choice([0.0, None]), feats | ({"good": 1.0} if good else {}) if rng.random() < 0.9 else None, "x"))
    return rows


def objective(rows, w, deviation):
    loss, groups = sum(x * x for x in w.values()) / (2 * deviation**2), {}
    for g, _, p, feats, _ in rows:
        groups.setdefault(g, []).append((p or 0.0, sum(v * w.get(f, 0.0) for f, v in (feats or {}).items())))
    for alts in groups.values():
        t, s = np.array(alts).T
        if t.sum() > 0:
            loss += float((t / t.sum()) @ (np.log(np.exp(s - s.max()).sum()) + s.max() - s))
    return loss


@pytest.mark.parametrize("sizes", [{}, {"shard_features": 5, "block_rows": 9}])
def test_gradient_and_end(spark, sizes):
    """The loss and its fall are the objective's, with groups whole or split among blocks, and no parameter can better the end."""
    rows = alternatives()
    df = spark.createDataFrame(rows, SCHEMA)
    problem = ranking.Problem(df, 1.0, **sizes)
    _, value, dots = problem.evaluated(problem.start(), None)
    assert np.isclose(value, objective(rows, {}, 1.0), rtol=1e-9)
    names = sorted({f for r in rows for f in r[3] or {}})
    slopes = [(objective(rows, {f: 1e-5}, 1.0) - objective(rows, {f: -1e-5}, 1.0)) / 2e-5 for f in names]
    assert np.isclose(dots[0, 0], np.dot(slopes, slopes), rtol=1e-5)
    if not sizes:
        return
    w = {r.fname: r.w for r in ranking.fit(df, **sizes).collect()}
    assert sorted(w) == names and w["good"] > 0.5
    for f in names:
        assert abs(objective(rows, w | {f: w[f] + 1e-4}, 1.0) - objective(rows, w | {f: w[f] - 1e-4}, 1.0)) / 2e-4 < 0.1


def test_odd_rows_and_ranks(spark):
    rows = [("a", 0, None, {"x": 1.0}, "x"), ("a", 1, 1.0, {"y": 1.0, "x": None}, "x"), ("a", 1, 1.0, {"y": 1.0}, "x"), ("b", 0, 0.0, {"x": 1.0}, "x"), (None, 0, 1.0, {"z": 1.0}, "x"), ("c", 5, -1.0, None, "x"), ("c", 4, 1.0, None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    params = ranking.fit(df)
    w = {r.fname: r.w for r in params.collect()}
    assert set(w) == {"x", "y"} and w["y"] > 0 > w["x"]
    found = {(r.group_id, r.alt_id): r for r in maxent.rank(ranking.scores(df, params)).collect()}
    assert found["a", 1].best and not found["a", 0].best and found["c", 4].best and found["c", 5].prob == 0.5
    assert ranking.fit(df.where("false")).count() == 0
