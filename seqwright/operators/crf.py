"""Linear-chain conditional random fields over sequences of hashed features.

A row is a sequence: fids and vals (an array a position) and y (label numbers,
null where unknown). Parameters are state weights (buckets, labels) and
transitions (labels, labels), one bounded vector. One sequence is one row; the
sources end sequences at marks, lines or days only, so that a long text without
any is one long row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwright.operators import optimize

BUCKETS = 1 << 12
#: Numbers in the largest table of a piece of sequences; a longer sequence is a piece of its own.
CELLS = 1 << 20


@dataclass(frozen=True)
class Model:
    labels: list[str]
    state: np.ndarray
    transitions: np.ndarray


def sequences(toks: DataFrame, labels: list[str], *, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, seq_id, pos, y, fids and vals of each sequence from tokens (doc_id, seq_id, pos, label, feats name -> value)."""
    names = F.array(*map(F.lit, labels))
    y = F.when(F.col("label").isin(labels), F.array_position(names, F.col("label")) - 1).cast("int")
    fids = F.transform(F.map_keys("feats"), lambda k: F.pmod(F.xxhash64(k), F.lit(buckets)).cast("int"))
    rows = toks.groupBy("doc_id", "seq_id").agg(F.array_sort(F.collect_list(F.struct("pos", y.alias("y"), fids.alias("fids"), F.map_values("feats").alias("vals")))).alias("s"))
    return rows.select("doc_id", "seq_id", *[F.col(f"s.{c}").alias(c) for c in ("pos", "y", "fids", "vals")])


def _scores(row: dict, state: np.ndarray) -> np.ndarray:
    return np.array([np.array(v) @ state[f] if len(f) else np.zeros(state.shape[1]) for f, v in zip(row["fids"], row["vals"])])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(scores: np.ndarray, transitions: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partition, label probabilities a position, and expected transitions of one sequence."""
    ahead, back = scores.copy(), np.zeros_like(scores)
    for i in range(1, len(scores)):
        ahead[i] += _lse(ahead[i - 1][:, None] + transitions, 0)
    for i in range(len(scores) - 2, -1, -1):
        back[i] = _lse(transitions + scores[i + 1] + back[i + 1], 1)
    z = float(_lse(ahead[-1], 0))
    pairs = ahead[:-1, :, None] + transitions + (scores + back)[1:, None, :] - z
    return z, np.exp(ahead + back - z), np.exp(pairs).sum(axis=0)


def best_path(scores: np.ndarray, transitions: np.ndarray) -> list[int]:
    """The label sequence of the highest score; the first label wins ties."""
    top, came = scores[0], []
    for s in scores[1:]:
        ways = top[:, None] + transitions
        came.append(ways.argmax(axis=0))
        top = ways.max(axis=0) + s
    path = [int(top.argmax())]
    for c in reversed(came):
        path.append(int(c[path[-1]]))
    return path[::-1]


@dataclass(frozen=True)
class Chains:
    """Sequences by falling length, their positions by place: those of place i are ``off[i]`` to ``off[i + 1]``, in the sequences' order.

    ``to`` is where each position of the source lies, ``rank`` a position's sequence, ``last`` a sequence's
    last position, and ``of`` the position of a feature; y is -1 where a label is unknown.
    """

    off: np.ndarray
    to: np.ndarray
    rank: np.ndarray
    last: np.ndarray
    y: np.ndarray
    of: np.ndarray
    fids: np.ndarray
    vals: np.ndarray
    weight: np.ndarray

    def scores(self, state: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.of, self.vals * w[self.fids], minlength=len(self.to)) for w in state.T], axis=1)

    def blocks(self) -> list[tuple[int, int, int]]:
        """(start of the place before, start, end) of every place but the first."""
        return list(zip(self.off[:-2].tolist(), self.off[1:-1].tolist(), self.off[2:].tolist()))

    def later(self) -> tuple[np.ndarray, np.ndarray]:
        """The positions behind the first of their sequence, and those before them."""
        here = np.arange(self.off[1], self.off[-1])
        return np.concatenate([np.arange(a, a + c - b) for a, b, c in self.blocks()] or [here]), here

    def marginals(self, scores: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log partitions of the sequences, label probabilities of the positions, and expected transitions summed by the sequences' weights."""
        ahead, back, most = scores.copy(), np.zeros_like(scores), transitions.max()
        near = most - transitions.min() < 300  # then sums of shifted exponentials lose nothing, as one of each is above exp(-300)
        w = np.exp(transitions - most)

        def shifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            top = x.max(axis=1, keepdims=True)
            return top, np.exp(x - top)

        def through(x: np.ndarray, along: np.ndarray, e: np.ndarray) -> np.ndarray:
            """Log sums over the labels of ``x`` on one side of the transitions."""
            if not near:
                return _lse(x[:, :, None] + along, 1)
            top, own = shifted(x)
            return top + most + np.log(own @ e)

        for a, b, c in self.blocks():
            ahead[b:c] += through(ahead[a : a + c - b], transitions, w)
        for a, b, c in reversed(self.blocks()):
            back[a : a + c - b] = through(scores[b:c] + back[b:c], transitions.T, w.T)
        z = _lse(ahead[self.last], 1)
        before, here = self.later()
        left, right, weight = ahead[before], scores[here] + back[here] - z[self.rank[here], None], self.weight[self.rank[here]]
        if near:
            (low, left), (high, right) = shifted(left), shifted(right)
            edge = (left * np.exp(low + high + most) * weight[:, None]).T @ right * w
        else:
            edge = np.tensordot(weight, np.exp(left[:, :, None] + transitions + right[:, None, :]), 1)
        return z, np.exp(ahead + back - z[self.rank, None]), edge

    def best(self, scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
        """Labels of the positions in the best sequences; the first label wins ties."""
        top, came = scores.copy(), np.zeros(scores.shape, int)
        for a, b, c in self.blocks():
            ways = top[a : a + c - b, :, None] + transitions
            came[b:c] = ways.argmax(axis=1)
            top[b:c] += ways.max(axis=1)
        path = top.argmax(axis=1)
        for a, b, c in reversed(self.blocks()):
            path[a : a + c - b] = came[np.arange(b, c), path[b:c]]
        return path


def chains(batch: pa.RecordBatch, labels: int) -> Iterator[tuple[int, int, Chains]]:
    """(first, end, chains) of the batch's rows, as many together as ``CELLS`` numbers hold; y and weight may lack."""
    lens = batch.column("fids").value_lengths().to_numpy(zero_copy_only=False).astype(int)
    first = 0
    while first < batch.num_rows:
        held = np.cumsum(lens[first:]) * labels * labels <= CELLS
        end = first + max(1, int(held.sum()))
        yield first, end, _chains(batch.slice(first, end - first), lens[first:end])
        first = end


def _chains(batch: pa.RecordBatch, lens: np.ndarray) -> Chains:
    order = np.argsort(-lens, kind="stable")
    places = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
    ranks = np.empty(len(lens), int)
    ranks[order] = np.arange(len(lens))
    rank = np.repeat(ranks, lens)
    off = np.append(0, np.cumsum(np.bincount(places)))
    to = off[places] + rank
    by_place = np.empty(len(to), int)
    by_place[to] = rank
    fids, vals = (batch.column(c).flatten() for c in ("fids", "vals"))
    of = np.repeat(to, fids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    y = np.full(len(to), -1)
    if "y" in batch.schema.names:
        y[to] = batch.column("y").flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    weight = batch.column("weight").to_numpy()[order] if "weight" in batch.schema.names else np.ones(len(lens))
    sized = lens[order]
    return Chains(off, to, by_place, off[sized - 1] + np.arange(len(sized)), y, of, fids.flatten().to_numpy(zero_copy_only=False), vals.flatten().fill_null(0.0).to_numpy(zero_copy_only=False), weight)


def piece_term(labels: int):
    """Loss and gradient of :class:`Chains`, as those of :func:`term` for each sequence."""

    def one(piece: Chains, x: np.ndarray, grad: np.ndarray) -> float:
        cut = len(x) - labels * labels
        state, transitions = x[:cut].reshape(-1, labels), x[cut:].reshape(labels, labels)
        scores, y = piece.scores(state), piece.y
        z, node, edge = piece.marginals(scores, transitions)
        known = np.flatnonzero(y >= 0)
        if len(known) == len(y):
            before, here = piece.later()
            loss = z @ piece.weight - scores[known, y] @ piece.weight[piece.rank] - transitions[y[before], y[here]] @ piece.weight[piece.rank[here]]
            node[known, y] -= 1
            edge -= np.bincount(y[before] * labels + y[here], piece.weight[piece.rank[here]], minlength=labels * labels).reshape(labels, labels)
        else:
            held = scores.copy()
            held[known] -= 1e9
            held[known, y[known]] = scores[known, y[known]]
            z_held, node_held, edge_held = piece.marginals(held, transitions)
            loss, node, edge = (z - z_held) @ piece.weight, node - node_held, edge - edge_held
        node *= piece.weight[piece.rank, None]
        own = grad[:cut].reshape(-1, labels)
        for c in range(labels):
            own[:, c] += np.bincount(piece.fids, piece.vals * node[piece.of, c], minlength=len(own))
        grad[cut:] += edge.ravel()
        return float(loss)

    return one


def best_segments(scores: np.ndarray, transitions: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(first, last, label) of the best segmentation into segments of up to ``longest`` positions.

    A segment scores the sum of its positions' scores, and its label's transition from the segment before.
    """
    n, labels = scores.shape
    total = np.vstack([np.zeros(labels), scores.cumsum(axis=0)])
    top, came = np.full((n, labels), -np.inf), {}
    for end in range(n):
        for first in range(max(0, end - longest + 1), end + 1):
            own = total[end + 1] - total[first]
            ways = top[first - 1][:, None] + transitions if first else np.zeros((1, labels))
            new, prv = ways.max(axis=0) + own, ways.argmax(axis=0)
            for y in np.flatnonzero(new > top[end]):
                top[end, y], came[end, y] = new[y], (first, int(prv[y]))
    found, end, y = [], n - 1, int(top[-1].argmax()) if n else 0
    while end >= 0:
        first, prv = came[end, y]
        found.append((first, end, y))
        end, y = first - 1, prv
    return found[::-1]


def segment_marginals(scores: np.ndarray, transitions: np.ndarray, longest: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Log partition over segmentations, each position's expected label and expected transitions between segments, scored as in :func:`best_segments`."""
    n, labels = scores.shape
    total = np.vstack([np.zeros(labels), scores.cumsum(axis=0)])
    spans = [(first, end, total[end + 1] - total[first]) for end in range(n) for first in range(max(0, end - longest + 1), end + 1)]
    ahead, back = np.full((n, labels), -np.inf), np.full((n, labels), -np.inf)
    back[-1] = 0

    def before(first: int) -> np.ndarray:
        return _lse(ahead[first - 1][:, None] + transitions, 0) if first else np.zeros(labels)

    for first, end, own in spans:
        ahead[end] = np.logaddexp(ahead[end], before(first) + own)
    for first, end, own in sorted(spans, key=lambda s: -s[1]):
        if first:
            back[first - 1] = np.logaddexp(back[first - 1], _lse(transitions + own + back[end], 1))
    z, node, edge = float(_lse(ahead[-1], 0)), np.zeros((n + 1, labels)), np.zeros((labels, labels))
    for first, end, own in spans:
        p = np.exp(before(first) + own + back[end] - z)
        node[first] += p
        node[end + 1] -= p
        if first:
            edge += np.exp(ahead[first - 1][:, None] + transitions + own + back[end] - z)
    return z, node.cumsum(axis=0)[:-1], edge


def _given(row: dict, x: np.ndarray, labels: int) -> tuple[np.ndarray, np.ndarray]:
    """A sequence's scores and the transitions under the parameters."""
    cut = len(x) - labels * labels
    return _scores(row, x[:cut].reshape(-1, labels)), x[cut:].reshape(labels, labels)


def _add(row: dict, grad: np.ndarray, node: np.ndarray, edge: np.ndarray) -> None:
    """Adds the gradient of a sequence from that of its labels and transitions."""
    labels = len(edge)
    cut = len(grad) - labels * labels
    own = grad[:cut].reshape(-1, labels)
    for f, v, d in zip(row["fids"], row["vals"], node):
        np.add.at(own, np.array(f, int), np.array(v)[:, None] * d)
    grad[cut:] += edge.ravel()


def segment_term(labels: int, longest: int):
    """Loss and gradient of one labelled sequence (y, begin) over all segmentations; a gold segment starts at a begin or another label."""

    def one(row: dict, x: np.ndarray, grad: np.ndarray) -> float:
        scores, transitions = _given(row, x, labels)
        z, node, edge = segment_marginals(scores, transitions, longest)
        y, begin = np.array(row["y"]), np.array(row["begin"], bool)
        starts = np.flatnonzero((np.arange(len(y)) == 0) | begin | (y != np.roll(y, 1)))
        pairs = y[starts[:-1]], y[starts[1:]]
        z -= scores[np.arange(len(y)), y].sum() + transitions[pairs].sum()
        node[np.arange(len(y)), y] -= 1
        np.add.at(edge, pairs, -1)
        _add(row, grad, node, edge)
        return float(z)

    return one


def soft_term(labels: int):
    """Loss and gradient of one sequence whose positions have distributions ``p`` of labels; neighbours count as independent."""

    def one(row: dict, x: np.ndarray, grad: np.ndarray) -> float:
        scores, transitions = _given(row, x, labels)
        z, node, edge = marginals(scores, transitions)
        p = np.array(row["p"], float)
        pairs = p[:-1].T @ p[1:]
        _add(row, grad, node - p, edge - pairs)
        return float(z - (p * scores).sum() - (pairs * transitions).sum())

    return one


def term(labels: int):
    """Loss and gradient of one sequence: all labelled, or, where y is null, over every label that could stand there."""

    def one(row: dict, x: np.ndarray, grad: np.ndarray) -> float:
        cut = len(x) - labels * labels
        state, transitions = x[:cut].reshape(-1, labels), x[cut:].reshape(labels, labels)
        scores = _scores(row, state)
        y = row["y"]
        held = scores.copy()
        for i, own in enumerate(y):
            if own is not None:
                held[i, np.arange(labels) != own] = -1e9
        z, node, edge = marginals(scores, transitions)
        z_held, node_held, edge_held = marginals(held, transitions)
        own_state = grad[:cut].reshape(-1, labels)
        for f, v, d in zip(row["fids"], row["vals"], node - node_held):
            np.add.at(own_state, np.array(f, int), np.array(v)[:, None] * d)
        grad[cut:] += (edge - edge_held).ravel()
        return z - z_held

    return one


def fit(seqs: DataFrame, labels: list[str], *, buckets: int = BUCKETS, deviation: float = 10.0, steps: int = 200, method: str = "lbfgs", rate: float = 0.1, l1: float = 0.0, **how) -> Model:
    """Train by L-BFGS, or by ``method="sgd"`` (averaged over tasks; L1 penalty, momentum, batches and step-size adaptation as in :func:`optimize.averaged_sgd`). Sequences without any label teach nothing."""
    rows = seqs.where(F.exists("y", lambda v: v.isNotNull())).select("y", "fids", "vals")
    n = len(labels)
    if method == "lbfgs":
        pieces = optimize.packed(rows, F.size("y"), lambda batch: (piece for _, _, piece in chains(batch, n)))
        return _trained(pieces, optimize.unpacked(piece_term(n)), labels, buckets=buckets, deviation=deviation, steps=steps, whole=True)
    return _trained(rows, term(n), labels, buckets=buckets, deviation=deviation, steps=steps, method=method, rate=rate, l1=l1, **how)


def fit_soft(seqs: DataFrame, labels: list[str], *, buckets: int = BUCKETS, **how) -> Model:
    """Train on distributions of labels (p: an array of arrays); sequences that lack one at a place teach nothing."""
    rows = seqs.where(F.forall("p", lambda d: d.isNotNull() & (F.size(d) == len(labels))) & (F.size("p") > 0)).select("p", "fids", "vals")
    return _trained(rows, soft_term(len(labels)), labels, buckets=buckets, **how)


def fit_segments(seqs: DataFrame, labels: list[str], *, buckets: int = BUCKETS, **how) -> tuple[Model, int]:
    """Train over segmentations of labelled sequences (y, begin: arrays); also the longest segment they show, for :func:`best_segments`.

    Sequences with an unknown label at any place teach nothing.
    """
    rows = seqs.where(F.forall("y", lambda v: v.isNotNull()) & (F.size("y") > 0)).select("y", "begin", "fids", "vals")
    places = F.transform("y", lambda y, i: F.struct(y.alias("y"), F.get("begin", i).alias("b"), (F.get("y", i - 1) == y).alias("same")))
    run = F.aggregate(places, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, x: _longer(a, x))
    longest = rows.agg(F.max(run["most"])).first()[0] or 1
    return _trained(rows, segment_term(len(labels), longest), labels, buckets=buckets, **how), longest


def _longer(a: Column, x: Column) -> Column:
    now = F.when(F.coalesce(x["same"], F.lit(False)) & ~F.coalesce(x["b"], F.lit(False)), a["now"] + 1).otherwise(1)
    return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))


def _trained(rows: DataFrame, one, labels: list[str], *, buckets: int, deviation: float = 10.0, steps: int = 200, method: str = "lbfgs", rate: float = 0.1, l1: float = 0.0, whole: bool = False, **how) -> Model:
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    n = len(labels)
    start = np.zeros(buckets * n + n * n)
    if method == "sgd":
        x = optimize.averaged_sgd(rows, one, start, epochs=steps, rate=rate, l1=l1, **how)
    else:
        x = optimize.lbfgs(optimize.with_prior(lambda x: optimize.summed(rows, one, x, whole=whole), deviation), start, steps=steps)
    rows.unpersist()
    return Model(labels, x[: buckets * n].reshape(buckets, n), x[buckets * n :].reshape(n, n))


def decode(seqs: DataFrame, model: Model) -> DataFrame:
    """doc_id, seq_id, pos, label_pred and confidence (the label's probability at its position) of every token."""
    shared = seqs.sparkSession.sparkContext.broadcast(model)  # buckets and labels are bounded parameters
    keys = ["doc_id", "seq_id"]

    def run(batches):
        own = shared.value
        names = np.array(own.labels, dtype=object)
        for batch in batches:
            labels, sure = [], []
            for _, _, piece in chains(batch, len(names)):
                scores = piece.scores(own.state)
                path = piece.best(scores, own.transitions)[piece.to]
                labels.append(names[path])
                sure.append(piece.marginals(scores, own.transitions)[1][piece.to, path])
            if batch.num_rows:
                ends = pa.array(np.append(0, np.cumsum(batch.column("pos").value_lengths().to_numpy(zero_copy_only=False))).astype(np.int32))
                found = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((labels, pa.string()), (sure, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "pos")], *found], names=[*keys, "pos", "label_pred", "confidence"])

    types = {f.name: f.dataType.simpleString() for f in seqs.schema}
    found = seqs.select(*keys, "pos", "fids", "vals").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in (*keys, "pos")) + ", label_pred array<string>, confidence array<double>")
    return found.select(*keys, F.inline(F.arrays_zip("pos", "label_pred", "confidence")))


def posteriors(seqs: DataFrame, model: Model) -> DataFrame:
    """doc_id, seq_id, pos and probs (label -> probability) of every token; :func:`maxent.feature_masses` sums them by feature for self-training."""
    shared = seqs.sparkSession.sparkContext.broadcast(model)  # buckets and labels are bounded parameters
    keys = ["doc_id", "seq_id", "pos"]

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [marginals(_scores(row, own.state), own.transitions)[1].tolist() for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(found, pa.list_(pa.list_(pa.float64())))], names=[*keys, "p"])

    types = ", ".join(f"{c} {seqs.schema[c].dataType.simpleString()}" for c in keys)
    found = seqs.where(F.size("pos") > 0).select(*keys, "fids", "vals").mapInArrow(run, f"{types}, p array<array<double>>")
    found = found.select("doc_id", "seq_id", F.inline(F.arrays_zip("pos", "p")))
    return found.select(*keys, F.map_from_arrays(F.array(*map(F.lit, model.labels)), "p").alias("probs"))


def viterbi(seqs: DataFrame, transitions: list[list[float]]) -> DataFrame:
    """doc_id, seq_id, pos and y of the best label sequence, from rows with pos and scores (an array of label scores a position).

    A fold over the array in the JVM: the state is each label's best score and its path.
    """
    n = len(transitions)

    def step(acc, s):
        def arrive(y: int):
            ways = [acc["top"][p] + F.lit(float(transitions[p][y])) for p in range(n)]
            best, path = ways[0], acc["path"][0]
            for p in range(1, n):
                path = F.when(ways[p] > best, acc["path"][p]).otherwise(path)
                best = F.greatest(best, ways[p])
            return F.struct((best + s[y]).alias("top"), F.concat(path, F.array(F.lit(y))).alias("path"))

        come = F.array(*[arrive(y) for y in range(n)])
        return F.struct(F.transform(come, lambda c: c["top"]).alias("top"), F.transform(come, lambda c: c["path"]).alias("path"))

    first = F.struct(F.get("scores", F.lit(0)).alias("top"), F.array(*[F.array(F.lit(y)) for y in range(n)]).alias("path"))
    rest = F.slice("scores", F.lit(2), F.greatest(F.size("scores") - 1, F.lit(0)))
    done = F.aggregate(rest, first, step, lambda a: F.get(a["path"], F.array_position(a["top"], F.array_max(a["top"])).cast("int") - 1))
    return seqs.withColumn("y", done).select("doc_id", "seq_id", F.inline(F.arrays_zip("pos", "y")))
