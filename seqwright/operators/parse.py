"""Dependency trees from arc scores: arcs (doc_id, seq_id, gov, id, score), words numbered from 1, gov 0 for the root.

A sentence's arcs are one row, its tree is found in a task. Scores are log
weights; pairs without an arc can't be in a tree. A sentence whose words can't
all be reached has no tree, and its words null heads.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwright.operators import optimize


def eisner(scores: np.ndarray) -> list[int]:
    """Heads of the words of the best projective tree, by Eisner's chart."""
    n = len(scores)
    whole, part = np.full((2, n, n), -np.inf), np.full((2, n, n), -np.inf)
    cut_whole, cut_part = np.zeros((2, n, n), int), np.zeros((n, n), int)
    whole[:, range(n), range(n)] = 0
    for width in range(1, n):
        for i in range(n - width):
            j = i + width
            ways = whole[1, i, i:j] + whole[0, i + 1 : j + 1, j]
            k = int(ways.argmax())
            cut_part[i, j] = i + k
            part[0, i, j], part[1, i, j] = ways[k] + scores[j, i], ways[k] + scores[i, j]
            left, right = whole[0, i, i:j] + part[0, i:j, j], part[1, i, i + 1 : j + 1] + whole[1, i + 1 : j + 1, j]
            cut_whole[0, i, j], cut_whole[1, i, j] = i + int(left.argmax()), i + 1 + int(right.argmax())
            whole[0, i, j], whole[1, i, j] = left.max(), right.max()
    heads, todo = [0] * n, [(1, 0, n - 1, True)]
    while todo:
        side, i, j, full = todo.pop()
        if i == j:
            continue
        if full:
            k = int(cut_whole[side, i, j])
            todo += [(0, i, k, True), (0, k, j, False)] if side == 0 else [(1, i, k, False), (1, k, j, True)]
        else:
            heads[i if side == 0 else j] = j if side == 0 else i
            k = int(cut_part[i, j])
            todo += [(1, i, k, True), (0, k + 1, j, True)]
    return heads[1:]


def maximum_tree(scores: np.ndarray) -> list[int]:
    """Heads of the words of the best tree, crossing arcs or not, by contracting cycles of best arcs."""
    s = scores.copy()
    n = len(s)
    s[range(n), range(n)] = -np.inf
    s[:, 0] = -np.inf
    heads = s.argmax(axis=0)
    heads[0] = -1
    seen = np.full(n, -1)
    for start in range(1, n):
        at, walk = start, []
        while at > 0 and seen[at] < 0:
            seen[at] = start
            walk.append(at)
            at = heads[at]
        if at > 0 and seen[at] == start:
            cycle = walk[walk.index(at) :]
            break
    else:
        return heads[1:].tolist()
    rest = [v for v in range(n) if v not in cycle]
    inside = np.array([s[heads[v], v] for v in cycle])
    small = np.full((len(rest) + 1, len(rest) + 1), -np.inf)
    small[:-1, :-1] = s[np.ix_(rest, rest)]
    small[-1, :-1] = s[np.ix_(cycle, rest)].max(axis=0)
    entering = s[np.ix_(rest, cycle)] - inside
    small[:-1, -1] = entering.max(axis=1)
    found = [-1, *maximum_tree(small)]
    enter = found[-1]
    broken = cycle[int(entering[enter].argmax())]
    for v, h in zip(rest[1:], found[1:-1]):
        heads[v] = rest[h] if h < len(rest) else cycle[int(s[cycle, v].argmax())]
    heads[broken] = rest[enter]
    return heads[1:].tolist()


def arc_probabilities(scores: np.ndarray) -> np.ndarray:
    """Probability of each arc (gov, id) over all trees, by the matrix-tree theorem."""
    n = len(scores)
    s = scores.copy()
    s[range(n), range(n)] = -np.inf
    s[:, 0] = -np.inf
    w = np.zeros((n, n))
    w[:, 1:] = np.exp(s[:, 1:] - s[:, 1:].max(axis=0))
    laplacian = np.diag(w[:, 1:].sum(axis=0)) - w[1:, 1:]
    inverse = np.linalg.inv(laplacian)
    found = np.zeros((n, n))
    found[0, 1:] = w[0, 1:] * np.diag(inverse)
    found[1:, 1:] = w[1:, 1:] * (np.diag(inverse)[None, :] - inverse.T)
    return found


def _lse(ways: np.ndarray) -> float:
    top = ways.max() if len(ways) else -np.inf
    return float(top + np.log(np.exp(ways - top).sum())) if np.isfinite(top) else -np.inf


def projective_probabilities(scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition over the projective trees and the probability of each arc (gov, id), by inside and outside charts.

    Spans are as in :func:`eisner`, with one derivation a tree: ``part`` holds an arc
    between its ends, ``whole`` a head at one end with all it governs on that side.
    The outside of a span is its derivative, so the charts are run backward.
    """
    n = len(scores)
    whole, part = np.full((2, n, n), -np.inf), np.full((2, n, n), -np.inf)
    whole[:, range(n), range(n)] = 0
    for width in range(1, n):
        for i in range(n - width):
            j = i + width
            inner = _lse(whole[1, i, i:j] + whole[0, i + 1 : j + 1, j])
            part[0, i, j], part[1, i, j] = inner + scores[j, i], inner + scores[i, j]
            whole[0, i, j] = _lse(whole[0, i, i:j] + part[0, i:j, j])
            whole[1, i, j] = _lse(part[1, i, i + 1 : j + 1] + whole[1, i + 1 : j + 1, j])
    d_whole, d_part, found = np.zeros((2, n, n)), np.zeros((2, n, n)), np.zeros((n, n))
    d_whole[1, 0, n - 1] = 1.0

    def share(d: float, ways: np.ndarray, total: float) -> np.ndarray:
        return d * np.exp(ways - total) if d > 0 and np.isfinite(total) else np.zeros(len(ways))

    for width in range(n - 1, 0, -1):
        for i in range(n - width):
            j = i + width
            left = share(d_whole[0, i, j], whole[0, i, i:j] + part[0, i:j, j], whole[0, i, j])
            d_whole[0, i, i:j] += left
            d_part[0, i:j, j] += left
            right = share(d_whole[1, i, j], part[1, i, i + 1 : j + 1] + whole[1, i + 1 : j + 1, j], whole[1, i, j])
            d_part[1, i, i + 1 : j + 1] += right
            d_whole[1, i + 1 : j + 1, j] += right
            found[j, i], found[i, j] = d_part[0, i, j], d_part[1, i, j]
            ways = whole[1, i, i:j] + whole[0, i + 1 : j + 1, j]
            both = share(d_part[0, i, j] + d_part[1, i, j], ways, _lse(ways))
            d_whole[1, i, i:j] += both
            d_whole[0, i + 1 : j + 1, j] += both
    return float(whole[1, 0, n - 1]), found


def log_partition(scores: np.ndarray) -> float:
    """Log of the summed weight of all trees, crossing arcs or not, by the matrix-tree theorem."""
    s = scores.copy()
    s[range(len(s)), range(len(s))] = -np.inf
    top = s[:, 1:].max(axis=0)
    w = np.exp(s[:, 1:] - top)
    return float(np.linalg.slogdet(np.diag(w.sum(axis=0)) - w[1:])[1] + top.sum())


def best_heads(scores: np.ndarray, k: int) -> list[tuple[float, list[int]]]:
    """Scores and heads of the ``k`` best trees, best first; fewer where there are no more.

    The trees that a found one leaves are dealt to parts that share no tree: for each
    word, those with the same heads before it and another head of its own.
    """

    def best(s: np.ndarray) -> tuple[float, list[int]] | None:
        if not np.isfinite(s[:, 1:].max(axis=0)).all():
            return None
        heads = maximum_tree(s)
        value = float(s[heads, range(1, len(s))].sum())
        return (value, heads) if np.isfinite(value) else None

    first = scores.astype(float).copy()
    first[range(len(first)), range(len(first))] = -np.inf
    first[:, 0] = -np.inf
    came, found, number = best(first), [], 0
    queue = [(-came[0], number, came[1], first, 1)] if came else []
    while queue and len(found) < k:
        loss, _, heads, s, free = heapq.heappop(queue)
        found.append((-loss, heads))
        for v in range(free, len(s)):
            other = s.copy()
            other[heads[v - 1], v] = -np.inf
            new = best(other)
            if new:
                number += 1
                heapq.heappush(queue, (-new[0], number, new[1], other, v))
            kept = np.full(len(s), -np.inf)
            kept[heads[v - 1]] = s[heads[v - 1], v]
            s = s.copy()
            s[:, v] = kept
    return found


def best_trees(arcs: DataFrame, k: int) -> DataFrame:
    """doc_id, seq_id, place (from 1), score, id and gov of the ``k`` best trees of every sentence (arcs: doc_id, seq_id, gov, id, score); none where no tree reaches all words."""
    rows = arcs.groupBy("doc_id", "seq_id").agg(F.collect_list(F.struct("gov", "id", F.col("score").cast("double").alias("score"))).alias("a"))

    def run(batches):
        for batch in batches:
            out = []
            for own in batch.column("a").to_pylist():
                found = best_heads(_matrix(own), k)
                out.append([{"place": place, "score": value, "id": i, "gov": int(h)} for place, (value, heads) in enumerate(found, 1) for i, h in enumerate(heads, 1)])
            kind = pa.list_(pa.struct([("place", pa.int32()), ("score", pa.float64()), ("id", pa.int32()), ("gov", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq_id"), pa.array(out, kind)], names=["doc_id", "seq_id", "t"])

    types = [rows.schema[c].dataType.simpleString() for c in ("doc_id", "seq_id")]
    return rows.mapInArrow(run, f"doc_id {types[0]}, seq_id {types[1]}, t array<struct<place:int,score:double,id:int,gov:int>>").select("doc_id", "seq_id", F.inline("t"))


def _matrix(arcs: list[dict]) -> np.ndarray:
    s = np.full((max(a["id"] for a in arcs) + 1,) * 2, -np.inf)
    for a in arcs:
        s[a["gov"], a["id"]] = a["score"]
    return s


def arc_term(*, projective: bool = True):
    """Loss and gradient of a sentence's arcs: gov, id, gold, fids and vals of each, as :func:`optimize.summed` asks for."""

    def one(row: dict, x: np.ndarray, grad: np.ndarray) -> float:
        arcs = row["a"]
        own = [(a["gov"], a["id"], np.array(a["fids"], int), np.array(a["vals"], float)) for a in arcs]
        s = np.full((max(a["id"] for a in arcs) + 1,) * 2, -np.inf)
        for gov, word, fids, vals in own:
            s[gov, word] = vals @ x[fids]
        z, p = projective_probabilities(s) if projective else (log_partition(s), arc_probabilities(s))
        for (gov, word, fids, vals), a in zip(own, arcs):
            np.add.at(grad, fids, vals * (p[gov, word] - bool(a["gold"])))
            if a["gold"]:
                z -= s[gov, word]
        return z

    return one


def fit(arcs: DataFrame, *, projective: bool = True, buckets: int = 1 << 12, deviation: float = 10.0, steps: int = 200) -> np.ndarray:
    """Weights of ``buckets`` hashed features of arcs (doc_id, seq_id, gov, id, gold, feats name -> value), by L-BFGS until it converges.

    A sentence, one row with all its arcs, needs a gold arc to each word; gold trees with
    crossing arcs are outside what ``projective`` sums over.
    """
    rows = _hashed_arcs(arcs, buckets, "gold").persist(StorageLevel.MEMORY_AND_DISK)
    one = arc_term(projective=projective)
    x = optimize.lbfgs(optimize.with_prior(lambda x: optimize.summed(rows, one, x), deviation), np.zeros(buckets), steps=steps)
    rows.unpersist()
    return x


def scored(arcs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, seq_id, gov, id and score of arcs (…, feats) under the weights of :func:`fit`."""
    shared = arcs.sparkSession.sparkContext.broadcast(weights)  # as long as the buckets

    def run(batches):
        for batch in batches:
            sums = [float(np.array(v) @ shared.value[np.array(f, int)]) if f else 0.0 for f, v in zip(batch.column("fids").to_pylist(), batch.column("vals").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "seq_id", "gov", "id")], pa.array(sums, pa.float64())], names=["doc_id", "seq_id", "gov", "id", "score"])

    rows = _with_fids(arcs, len(weights)).select("doc_id", "seq_id", "gov", "id", "fids", "vals")
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "seq_id", "gov", "id"))
    return rows.mapInArrow(run, f"{types}, score double")


def _with_fids(arcs: DataFrame, buckets: int) -> DataFrame:
    return arcs.withColumns({"fids": F.transform(F.map_keys("feats"), lambda k: F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int")), "vals": F.map_values("feats")})


def _hashed_arcs(arcs: DataFrame, buckets: int, *more: str) -> DataFrame:
    return _with_fids(arcs, buckets).groupBy("doc_id", "seq_id").agg(F.collect_list(F.struct("gov", "id", "fids", "vals", *more)).alias("a"))


def trees(arcs: DataFrame, *, projective: bool = True, probable: bool = True) -> DataFrame:
    """doc_id, seq_id, id, gov and, unless ``probable`` is false, prob (the arc's probability over all trees) of every word."""
    rows = arcs.groupBy("doc_id", "seq_id").agg(F.collect_list(F.struct("gov", "id", F.col("score").cast("double").alias("score"))).alias("a"))
    best = eisner if projective else maximum_tree
    kind = [("id", pa.int32()), ("gov", pa.int32()), *([("prob", pa.float64())] if probable else [])]

    def run(batches):
        for batch in batches:
            a = batch.column("a")
            gov, word, score = (x.to_numpy(zero_copy_only=False) for x in a.flatten().flatten())
            ends = np.append(0, np.cumsum(a.value_lengths().to_numpy(zero_copy_only=False)))
            out: list[list[np.ndarray]] = [[] for _ in kind]
            for low, high in zip(ends[:-1], ends[1:]):
                s = np.full((int(word[low:high].max()) + 1,) * 2, -np.inf)
                s[gov[low:high], word[low:high]] = score[low:high]
                n = np.arange(1, len(s))
                heads = best(s) if np.isfinite(s[:, 1:].max(axis=0)).all() else None
                reached = heads is not None and np.isfinite(s[heads, n]).all()
                p = arc_probabilities(s) if reached and probable else None
                for to, x in zip(out, (n, heads if reached else np.full(len(n), -1), *([p[heads, n] if reached else np.full(len(n), np.nan)] if probable else []))):
                    to.append(np.asarray(x))
            none = np.zeros(0, int)
            flat = [np.concatenate([none, *x]) for x in out]
            lost = flat[1] < 0
            values = pa.StructArray.from_arrays([pa.array(x, t, mask=lost if i else None) for i, (x, (_, t)) in enumerate(zip(flat, kind))], names=[n for n, _ in kind])
            sizes = np.append(0, np.cumsum([len(x) for x in out[0]])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("seq_id"), pa.ListArray.from_arrays(pa.array(sizes), values)], names=["doc_id", "seq_id", "t"])

    types = [rows.schema[c].dataType.simpleString() for c in ("doc_id", "seq_id")]
    return rows.mapInArrow(run, f"doc_id {types[0]}, seq_id {types[1]}, t array<struct<id:int,gov:int{',prob:double' if probable else ''}>>").select("doc_id", "seq_id", F.inline("t"))
