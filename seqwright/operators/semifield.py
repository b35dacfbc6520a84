"""Semi-Markov fields: whole segments have features of their own, in training and decoding.

Candidates are segments (doc_id, seq_id, pos, s) as in :mod:`seqwright.operators.segments`,
with feats (name -> value), edges (name -> value; optional) and, to learn from, label
(null where labels do not show the segment) and weight (how often the sequence counts; optional). A segment scores its features under
its label; its edges score the pair of the label before it and its own. Parameters
are state weights (buckets, labels) and edge weights (edge buckets, labels, labels)
of hashed names, one bounded vector. A sequence is one row of all its candidates.

Null feats, edges and values count as none. Rows that name the same segment add
their features up; candidates without a position or size are left out, as are
those that start before the sequence does. A sequence that candidates cannot tile
teaches nothing and gets no segments; one that its labels do not tile teaches
nothing. An empty table gives parameters of 0 and no segments; further columns
play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqwright.operators import optimize

BUCKETS, EDGE_BUCKETS = 1 << 12, 1 << 6
#: Numbers in the largest table of a group of sequences; a longer sequence is a group of its own.
CELLS = 1 << 20


@dataclass(frozen=True)
class Model:
    labels: list[str]
    longest: int
    state: np.ndarray
    edges: np.ndarray


@dataclass(frozen=True)
class Lattices:
    """Sequences of ``n`` places and how often each counts; a cell is a place, a size and a sequence, numbered in this order.

    ``cells`` are those with a candidate, ``y`` their labels and ``own`` their sets of features; equal sets are one, and
    ``of`` is the set of a feature. ``which`` is the set of edge features of every cell, ``block`` that of a place and
    size if its sequences share it, else -1. ``pos`` has the positions of places, by sequence.
    """

    rows: np.ndarray
    n: int
    cells: np.ndarray
    y: np.ndarray
    own: np.ndarray
    sets: int
    of: np.ndarray
    fids: np.ndarray
    vals: np.ndarray
    which: np.ndarray
    block: np.ndarray
    edge_sets: int
    edge_of: np.ndarray
    gids: np.ndarray
    gvals: np.ndarray
    weight: np.ndarray
    pos: np.ndarray | None

    def scores(self, state: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of segments (place, size, sequence, label), -inf where there is none, and of label pairs (set of edge features, before, label)."""
        labels, flat = state.shape[1], edges.reshape(len(edges), -1)
        own = np.stack([np.bincount(self.of, self.vals * w[self.fids], minlength=self.sets) for w in state.T], axis=1)
        node = np.full((self.which.size, labels), -np.inf)
        node[self.cells] = own[self.own]
        table = np.stack([np.bincount(self.edge_of, self.gvals * w[self.gids], minlength=self.edge_sets) for w in flat.T], axis=1)
        return node.reshape(*self.which.shape, labels), table.reshape(-1, labels, labels)

    def gold(self) -> tuple[np.ndarray, ...]:
        """Sequences, places, sizes and labels of the labelled segments, in order, of those sequences that they tile."""
        at = np.flatnonzero(self.y >= 0)
        place, size, seq = np.unravel_index(self.cells[at], self.which.shape)
        by = np.lexsort((size, place, seq))
        at, place, size, seq = at[by], place[by], size[by], seq[by]
        first, last = seq != np.append(-1, seq[:-1]), seq != np.append(seq[1:], -1)
        good = (place - size == np.where(first, 0, np.append(0, place[:-1] + 1)[: len(at)])) & (~last | (place == self.n - 1))
        kept = np.bincount(seq, ~good, minlength=len(self.rows))[seq] == 0
        return seq[kept], place[kept], size[kept], self.y[at][kept]


def sequences(candidates: DataFrame, labels: list[str], longest: int, *, buckets: int = BUCKETS, edge_buckets: int = EDGE_BUCKETS) -> DataFrame:
    """doc_id, seq_id and, as arrays, pos, s and y of the candidates of up to ``longest`` tokens, and their hashed features end to end."""
    none = F.create_map().cast("map<string,double>")
    names = F.array(*map(F.lit, labels)).cast("array<string>")
    label = F.col("label").cast("string") if "label" in candidates.columns else F.lit(None).cast("string")

    def hashed(name: str, n: int) -> list:
        own = F.coalesce(F.col(name), none) if name in candidates.columns else none
        ids = F.transform(F.map_keys(own), lambda k: F.pmod(F.xxhash64(k), F.lit(n)).cast("int"))
        return [ids, F.transform(F.map_values(own), lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))]

    (fids, vals), (gids, gvals) = hashed("feats", buckets), hashed("edges", edge_buckets)
    y = F.coalesce(F.when(label.isin(labels), F.array_position(names, label) - 1).cast("int"), F.lit(-1))
    one = F.struct(F.col("pos").cast("int").alias("pos"), F.col("s").cast("int").alias("s"), y.alias("y"), fids.alias("fids"), vals.alias("vals"), gids.alias("gids"), gvals.alias("gvals"))
    kept = candidates.where((F.col("s") >= 0) & (F.col("s") < longest) & F.col("pos").isNotNull())
    place = F.dense_rank().over(Window.partitionBy("doc_id", "seq_id").orderBy("pos")) - 1
    often = ["weight"] if "weight" in candidates.columns else []
    kept = kept.select("doc_id", "seq_id", place.alias("__place"), one.alias("__c"), *often)
    inside = F.when(F.col("__c.s") <= F.col("__place"), F.struct(F.col("__place").alias("place"), "__c.*"))
    rows = kept.groupBy("doc_id", "seq_id").agg((F.max("__place") + 1).alias("n"), F.array_sort(F.collect_list(inside)).alias("c"), *map(F.max, often)).toDF("doc_id", "seq_id", "n", "c", *often)
    flat = [F.flatten(F.col(f"c.{c}")).alias(c) for c in ("fids", "vals", "gids", "gvals")]
    counts = [F.transform(F.col(f"c.{c}"), F.size).alias(n) for c, n in (("fids", "n_f"), ("gids", "n_g"))]
    return rows.select("doc_id", "seq_id", "n", "c.pos", "c.place", "c.s", "c.y", *counts, *flat, *often)


def _sets(owner: np.ndarray, ids: np.ndarray, vals: np.ndarray, n: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]:
    """The set of each of ``n`` owners of features, equal sets as one; how many sets there are, and their features with the set they belong to."""
    by = np.argsort(owner, kind="stable")
    ids, vals, sizes = ids[by].astype(np.int64), np.ascontiguousarray(vals[by], float), np.bincount(owner, minlength=n)
    start, told, made, parts = np.cumsum(sizes) - sizes, np.empty(n, np.int32), 0, [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    for c in np.unique(sizes):
        at = np.flatnonzero(sizes == c)
        i = start[at][:, None] + np.arange(c)
        table = np.concatenate([ids[i], vals[i].view(np.int64)], axis=1)
        key = table @ np.random.default_rng(c).integers(1 << 62, size=2 * c, dtype=np.int64) if c else np.zeros(len(at), int)
        first, inverse = np.unique(key, return_index=True, return_inverse=True)[1:]
        if np.any(table != table[first][inverse]):  # two sets share a key
            first, inverse = np.unique(table, axis=0, return_index=True, return_inverse=True)[1:]
        told[at] = made + inverse.reshape(-1)
        parts.append((np.repeat(made + np.arange(len(first)), c), ids[i[first]].ravel(), vals[i[first]].ravel()))
        made += len(first)
    return told, made, *(np.concatenate(p) for p in zip(*parts))


def lattices(batch: pa.RecordBatch, longest: int, labels: int) -> Iterator[Lattices]:
    """The batch's sequences, those of a length together, as far as ``CELLS`` numbers hold them."""
    counts = batch.column("place").value_lengths().to_numpy()
    place, size, y, n_f, n_g, fids, vals, gids, gvals = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("place", "s", "y", "n_f", "n_g", "fids", "vals", "gids", "gvals"))
    pos = batch.column("pos").flatten().to_numpy(zero_copy_only=False) if "pos" in batch.schema.names else None  # only decoding tells positions
    weight = batch.column("weight").to_numpy() if "weight" in batch.schema.names else np.ones(batch.num_rows)
    ns, seq = batch.column("n").to_numpy(), np.repeat(np.arange(batch.num_rows), counts)
    of, edge_of = np.repeat(np.arange(len(place)), n_f), np.repeat(np.arange(len(place)), n_g)
    for n in np.unique(ns):
        sizes = min(int(n), longest)
        every, step = np.flatnonzero(ns == n), max(1, CELLS // int(n * max(sizes, labels) * labels))
        for i in range(0, len(every), step):
            rows = every[i : i + step]
            where = np.full(batch.num_rows, -1)
            where[rows] = np.arange(len(rows))
            kept = where[seq] >= 0
            new, f, g = np.cumsum(kept) - 1, kept[of], kept[edge_of]
            shape, own_seq, own_place, own_y = (int(n), sizes, len(rows)), where[seq[kept]], place[kept], y[kept]
            cells, to = np.unique(np.ravel_multi_index((own_place, size[kept], own_seq), shape), return_inverse=True)  # rows that name the same segment are one cell
            own, sets, *features = _sets(to[new[of[f]]], fids[f], vals[f], len(cells))
            edge, edge_sets, *edges = _sets(to[new[edge_of[g]]], gids[g], gvals[g], len(cells))
            known, at = np.flatnonzero(own_y >= 0)[::-1], None
            gold = np.full(len(cells), -1)
            gold[to[known]] = own_y[known]  # the first that is labelled, as it is written last
            which = np.full(shape, -1, np.int32)
            which.ravel()[cells] = edge
            low, high = np.where(which < 0, edge_sets, which).min(axis=2), which.max(axis=2)
            block = np.where(high < 0, 0, np.where(low == high, high, -1))
            if pos is not None:
                at = np.zeros((len(rows), int(n)), int)
                at[own_seq, own_place] = pos[kept]
            yield Lattices(rows, int(n), cells, gold, own, sets, *features, np.maximum(which, 0), block, max(1, edge_sets), *edges, weight[rows], at)


def _lse(x: np.ndarray, axis) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _shifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = x.max(axis=1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    return top, np.exp(x - top)


def flow(node: np.ndarray, table: np.ndarray, which: np.ndarray, block: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partitions of sequences, probabilities of segments (place, size, sequence, label) and, summed by the sequences' weights, of label pairs (set of edge features, before, label); zeros where nothing tiles."""
    (n, longest, rows, labels), most = node.shape, table.max()
    near = most - table.min() < 300  # then sums of shifted exponentials lose nothing, as one of each is above exp(-300)
    w = np.exp(table - most)
    ahead, back, came = np.full((n, rows, labels), -np.inf), np.zeros((n, rows, labels)), np.full(node.shape, -np.inf)
    top, lin = np.zeros((n, rows, 1)), np.zeros((n, rows, labels))

    def at(e: int, d: int):
        return which[e, d] if block[e, d] < 0 else block[e, d]

    with np.errstate(divide="ignore"):
        for e in range(n):
            for d in range(min(e, longest)):
                u, b = at(e, d), e - 1 - d
                if not near:
                    came[e, d] = _lse(ahead[b][:, :, None] + table[u], 1)
                else:
                    came[e, d] = top[b] + most + np.log(lin[b] @ w[u] if np.ndim(u) == 0 else np.einsum("kl,klm->km", lin[b], w[u]))
            if e < longest:
                came[e, e] = 0
            k = min(e + 1, longest)
            ahead[e] = _lse(came[e, :k] + node[e, :k], 0) if k > 1 else came[e, 0] + node[e, 0]
            top[e], lin[e] = _shifted(ahead[e])
        z = _lse(ahead[-1], 1)
        shift = np.where(np.isfinite(z), z, np.inf)[:, None]
        pairs = np.zeros(table.shape)
        for e in range(n - 1, -1, -1):  # back[e] is known here
            for d in range(min(e, longest)):
                u, b = at(e, d), e - 1 - d
                after = node[e, d] + back[e]
                if near:
                    left, right = lin[b] * weight[:, None], np.exp(after + (top[b] + most - shift))
                    if np.ndim(u) == 0:
                        pairs[u] += left.T @ right
                    else:
                        np.add.at(pairs, u, left[:, :, None] * right[:, None, :])
                else:
                    p = np.exp(ahead[b][:, :, None] + table[u] + (after - shift)[:, None, :]) * weight[:, None, None]
                    np.add.at(pairs, u, p if np.ndim(u) else p.sum(axis=0))
            if e:
                ways = []
                for d in range(min(longest, n - e)):
                    u, after = at(e + d, d), node[e + d, d] + back[e + d]
                    if not near:
                        ways.append(_lse(table[u] + after[:, None, :], 2))
                    else:
                        high, right = _shifted(after)
                        ways.append(high + most + np.log(right @ w[u].T if np.ndim(u) == 0 else np.einsum("km,klm->kl", right, w[u])))
                back[e - 1] = _lse(np.stack(ways), 0) if len(ways) > 1 else ways[0]
    return z, np.exp(came + node + back[:, None] - shift), pairs * w if near else pairs


def _own_tables(node: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, ...]:
    """What :func:`flow` and :func:`paths` read of tables by sequence, place and size, each cell with label pairs of its own."""
    rows, n, longest, labels = node.shape
    which = np.arange(rows * n * longest).reshape(n, longest, rows)
    return node.transpose(1, 2, 0, 3), pair.transpose(1, 2, 0, 3, 4).reshape(-1, labels, labels), which, np.full((n, longest), -1)


def marginals(node: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partitions of sequences, probabilities of segments (sequence, place, size, label) and of segments with the label before; -inf and zeros where nothing tiles."""
    rows, n, longest, labels = node.shape
    z, own, pairs = flow(*_own_tables(node, pair), np.ones(rows))
    return z, own.transpose(2, 0, 1, 3), pairs.reshape(n, longest, rows, labels, labels).transpose(2, 0, 1, 3, 4)


def paths(node: np.ndarray, table: np.ndarray, which: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sequences, places, sizes and labels of the best segmentations; of ties the shortest segment, then the first label wins, from the end back."""
    n, longest, rows, labels = node.shape
    top, size, before = np.full((n, rows, labels), -np.inf), np.zeros((n, rows, labels), int), np.zeros(node.shape, int)
    for e in range(n):
        came = np.full((min(e + 1, longest), rows, labels), -np.inf)
        for d in range(min(e, longest)):
            ways = top[e - 1 - d][:, :, None] + table[which[e, d] if block[e, d] < 0 else block[e, d]]
            came[d], before[e, d] = ways.max(axis=1), ways.argmax(axis=1)
        if e < longest:
            came[e] = 0
        came += node[e, : len(came)]
        size[e], top[e] = came.argmax(axis=0), came.max(axis=0)
    row, found = np.flatnonzero(np.isfinite(top[-1].max(axis=1))), []
    e, y = np.full(len(row), n - 1), top[-1].argmax(axis=1)[row]
    while len(row):
        d = size[e, row, y]
        found.append((row, e, d, y))
        going, y = e - d > 0, before[e, d, row, y]
        row, e, y = row[going], (e - d - 1)[going], y[going]
    seq, place, d, y = (np.concatenate(x) for x in zip(*found)) if found else np.zeros((4, 0), int)
    by = np.lexsort((place, seq))
    return seq[by], place[by], d[by], y[by]


def best(node: np.ndarray, pair: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, size, label) of the best segmentation of one sequence, as of :func:`paths`."""
    return list(zip(*(x.tolist() for x in paths(*_own_tables(node[None], pair[None]))[1:])))


def _parts(x: np.ndarray, labels: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    cut = buckets * labels
    return x[:cut].reshape(buckets, labels), x[cut:].reshape(-1, labels, labels)


def piece_term(labels: int, longest: int, buckets: int):
    """Loss and gradient of a piece: the lattices of some sequences and their gold segments."""

    def one(piece: tuple[Lattices, tuple[np.ndarray, ...]], x: np.ndarray, grad: np.ndarray) -> float:
        (state, edges), (state_grad, edge_grad) = _parts(x, labels, buckets), _parts(grad, labels, buckets)
        found, (seq, place, size, y) = piece
        node, table = found.scores(state, edges)
        taught = np.zeros(len(found.rows))
        taught[seq] = found.weight[seq]
        z, own, pairs = flow(node, table, found.which, found.block, taught)
        later = np.flatnonzero(place - size > 0)
        edge, often = found.which[place[later], size[later], seq[later]], taught[seq[later]]
        loss = z[taught > 0] @ taught[taught > 0] - node[place, size, seq, y] @ taught[seq] - table[edge, y[later - 1], y[later]] @ often
        own = own.reshape(-1, labels)[found.cells] * taught[found.cells % len(taught), None]
        gold = found.own[np.searchsorted(found.cells, np.ravel_multi_index((place, size, seq), found.which.shape))] if len(seq) else seq
        by_set = np.stack([np.bincount(found.own, p, minlength=found.sets) for p in own.T], axis=1)
        by_set -= np.bincount(gold * labels + y, taught[seq], minlength=by_set.size).reshape(by_set.shape)
        for c in range(labels):
            state_grad[:, c] += np.bincount(found.fids, found.vals * by_set[found.of, c], minlength=buckets)
        pairs -= np.bincount((edge * labels + y[later - 1]) * labels + y[later], often, minlength=pairs.size).reshape(pairs.shape)
        np.add.at(edge_grad, found.gids, found.gvals[:, None, None] * pairs[found.edge_of])
        return float(loss)

    return one


def term(labels: int, longest: int, buckets: int):
    """Loss and gradient of a record batch of :func:`sequences`."""
    one = piece_term(labels, longest, buckets)
    return lambda batch, x, grad: sum(one((found, found.gold()), x, grad) for found in lattices(batch, longest, labels))


def longest_label(candidates: DataFrame) -> int:
    """Tokens of the longest labelled candidate; 1 if there is none."""
    found = candidates.where("label IS NOT NULL").agg(F.max("s")).first()[0]
    return 1 if found is None else int(found) + 1


def fit(seqs: DataFrame, labels: list[str], longest: int, *, buckets: int = BUCKETS, edge_buckets: int = EDGE_BUCKETS, deviation: float = 10.0, steps: int = 200) -> Model:
    """Maximum likelihood of the labelled segmentations with a Gaussian prior, by L-BFGS over Spark jobs; equal sequences are one that counts as often."""
    n = len(labels)
    told = seqs.where(F.exists("y", lambda y: y >= 0)).drop("doc_id", "seq_id", "pos")
    rows = optimize.packed(told, F.col("n"), lambda batch: ((found, found.gold()) for found in lattices(batch, longest, n))).persist(StorageLevel.MEMORY_AND_DISK)
    one = optimize.unpacked(piece_term(n, longest, buckets))
    x = optimize.lbfgs(optimize.with_prior(lambda x: optimize.summed(rows, one, x, whole=True), deviation), np.zeros(buckets * n + edge_buckets * n * n), steps=steps)
    rows.unpersist()
    return Model(labels, longest, *_parts(x, n, buckets))


def weighted(spark: SparkSession, labels: list[str], longest: int, state: dict[str, list[float]], edges: dict[str, list[list[float]]], *, buckets: int = BUCKETS, edge_buckets: int = EDGE_BUCKETS) -> Model:
    """A model of given weights: a list by label of each feature, a table by label before and label of each edge."""
    n = len(labels)
    own, pairs = np.zeros((buckets, n)), np.zeros((edge_buckets, n, n))
    for table, weights, size in ((own, state, buckets), (pairs, edges, edge_buckets)):
        if weights:
            names = spark.createDataFrame([(k,) for k in weights], "name string")  # as many as weights are given
            for name, at in names.select("name", F.pmod(F.xxhash64("name"), F.lit(size))).collect():
                table[at] += np.array(weights[name])
    return Model(labels, longest, own, pairs)


def decode(seqs: DataFrame, model: Model) -> DataFrame:
    """doc_id, seq_id, pos, s, label_pred and confidence (the segment's probability) of each sequence's best segments."""
    shared = seqs.sparkSession.sparkContext.broadcast(model)  # buckets and labels are bounded parameters
    keys = ["doc_id", "seq_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.labels, dtype=object)
        for batch in batches:
            for own in lattices(batch, model.longest, len(names)):
                tables = (*own.scores(model.state, model.edges), own.which, own.block)
                seq, place, size, y = paths(*tables)
                sure = flow(*tables, own.weight)[1][place, size, seq, y]
                found = [pa.array(own.pos[seq, place], pa.int32()), pa.array(size, pa.int32()), pa.array(names[y], pa.string()), pa.array(sure)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(own.rows[seq])) for c in keys], *found], names=[*keys, "pos", "s", "label_pred", "confidence"])

    types = ", ".join(f"{c} {seqs.schema[c].dataType.simpleString()}" for c in keys)
    return seqs.where(F.size("pos") > 0).mapInArrow(run, f"{types}, pos int, s int, label_pred string, confidence double")
