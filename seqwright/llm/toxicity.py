"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are whether it holds a hashed n-gram of 3 to 5 characters
(code points; ASCII letters folded) at least once, twice and three times, for a
stem that is harmless once may mark a text that dwells on it. Each feature is scaled by the log ratio of its
smoothed frequency in toxic and other texts, and a logistic regression with an
L2 penalty is fitted on the scaled features by L-BFGS. Spark keeps the sample's
features and sums counts and gradients; the driver holds vectors of one number a
feature.

Null and empty texts have no features and score the intercept. Rows without an
id have no label. Repeated rows are scored, and learnt from, each by itself; an
id with two labels is two examples. Empty tables give empty results; with no
labels of either class every text scores the share of the classes. Columns
called score or predicted are replaced, other further columns stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm import kernels
from seqwright.llm.common import chosen, held_out, table
from seqwright.scratch import discard, written

GRAM_SIZES = range(3, 6)
GRAM_BITS = 18
#: A gram has a feature for each of these counts that a text reaches.
LEVELS = (1, 2, 3)
_LEVEL_STEP = 0x9E37
#: Labelled texts of each class that the model is fitted on, about.
SAMPLE_TOXIC = 1500
SAMPLE_OTHER = 2500
SMOOTHING = 4.0
PENALTY = 3.0
ROUNDS = 40
#: Tasks over the sample in an evaluation of the objective.
FIT_TASKS = 8
#: Bytes of one long text that are looked at together.
PIECE = 1 << 21


@dataclass(frozen=True)
class Model:
    """The weight of each gram code (its ratio times its coefficient) and the intercept."""

    weights: np.ndarray
    bias: float


def text_codes(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, the distinct feature codes in order) of each text."""
    size = 1 << GRAM_BITS
    seen, rank = np.zeros(size, bool), np.zeros(size, np.int64)

    def leveled(codes: np.ndarray, times: np.ndarray) -> np.ndarray:
        for k, level in enumerate(LEVELS):
            seen[codes[times >= level] ^ (k * _LEVEL_STEP & size - 1)] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        return found

    def told(parts: list[np.ndarray]) -> np.ndarray:
        for codes in parts:
            seen[codes] = True
        own = np.flatnonzero(seen)
        seen[own] = False
        rank[own] = np.arange(len(own))  # so that only the text's own codes are counted
        return leveled(own, sum((np.bincount(rank[codes], minlength=len(own)) for codes in parts), np.zeros(len(own), np.int64)))

    for low, high, data, offsets in kernels.chunks(column):
        if high - low == 1 and len(data) > PIECE:
            at, times = 0, np.zeros(size, np.int64)
            while at < len(data):
                after = min(at + PIECE, len(data))
                while after < len(data) and data[after] & 0xC0 == 0x80:
                    after += 1
                stop = min(after + 4 * GRAM_SIZES.stop, len(data))  # the next characters too, so that no gram is missed
                while stop < len(data) and data[stop] & 0xC0 == 0x80:
                    stop += 1
                points, ends = kernels.code_points(kernels.folded(data[at:stop]), np.array([0, stop - at]))
                own = np.count_nonzero(data[at:after] & 0xC0 != 0x80)  # grams that start behind these are the next piece's
                for codes, first in kernels.gram_codes(points, ends, GRAM_SIZES, GRAM_BITS):
                    times += np.bincount(codes[first < own], minlength=size)
                at = after
            yield low, leveled(np.flatnonzero(times), times[times > 0])
            continue
        points, ends = kernels.code_points(kernels.folded(data), offsets)
        found = [(codes, np.searchsorted(at, ends).tolist()) for codes, at in kernels.gram_codes(points, ends, GRAM_SIZES, GRAM_BITS)]
        for i in range(high - low):
            yield low + i, told([codes[at[i] : at[i + 1]] for codes, at in found])


def minimise(fn: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:
    """L-BFGS with a backtracking line search."""
    value, slope = fn(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, kept = -slope, []
        for s, y, rho in reversed(steps):
            kept.append(a := rho * s.dot(way))
            way = way - a * y
        if steps:
            s, y, _ = steps[-1]
            way *= s.dot(y) / y.dot(y)
        else:
            way /= max(1.0, float(np.linalg.norm(slope)))
        for (s, y, rho), a in zip(steps, reversed(kept), strict=True):
            way = way + (a - rho * y.dot(way)) * s
        size, fall = 1.0, float(slope.dot(way))
        while size > 1e-8:
            value_new, slope_new = fn(x + size * way)
            if value_new <= value + 1e-4 * size * fall:
                break
            size /= 2
        else:
            break
        s, y = size * way, slope_new - slope
        if (curve := float(s.dot(y))) > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / curve)]
        x, done = x + s, abs(value - value_new) <= 1e-6 * max(1.0, abs(value))
        value, slope = value_new, slope_new
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, *, toxic: int = SAMPLE_TOXIC, other: int = SAMPLE_OTHER) -> Model:
    """Fit on about ``toxic`` and ``other`` texts of the classes 1 and 0; ``docs`` has doc_id and text, ``labels`` doc_id and toxic.

    Label rows are picked by a hash of the id, so only the sample meets the
    texts; the intercept is moved back to the class shares of all label rows.
    Rows without a label are no examples. With one class only, every text
    scores that class's share.
    """
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    prior = float(np.log((n1 + 0.5) / (n0 + 0.5)))
    if not n1 or not n0:
        return Model(np.zeros(1 << GRAM_BITS, np.float32), prior)
    point = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.where(point < F.when(F.col("toxic") == 1, min(1.0, toxic / n1)).otherwise(min(1.0, other / n0)))
    picked = docs.join(F.broadcast(sample), "doc_id")  # toxic + other rows: bounded by the parameters

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [codes.astype("<u4").tobytes() for _, codes in text_codes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(packed, pa.binary())], names=["toxic", "codes"])

    found = picked.select(F.col("toxic").cast("int"), "text").mapInArrow(features, "toxic int, codes binary")
    sample = written(found.repartition(FIT_TASKS), "toxicity-sample")  # toxic + other rows: bounded by the parameters
    model = fit_codes(sample, prior)
    discard(sample)
    return model


def fit_codes(sample: DataFrame, prior: float) -> Model:
    """Fit on ``sample`` (toxic, codes: the distinct gram codes as uint32); ``prior`` is the log odds of a toxic text among all."""
    dim, context = 1 << GRAM_BITS, sample.sparkSession.sparkContext

    def summed(of_rows: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all rows of vectors that ``of_rows`` makes of labels, codes and the codes' row numbers; a vector a task reaches the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                y = batch.column("toxic").to_numpy().astype(np.float64)
                parts = [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column("codes")]
                if len(y):
                    own = of_rows(y, np.concatenate(parts), np.repeat(np.arange(len(y)), [len(x) for x in parts]))
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

        got = [np.frombuffer(r["v"], np.float64) for r in sample.mapInArrow(run, "v binary").collect()]
        return np.sum(got, axis=0) if got else np.zeros(2 * dim + 2)

    def counts(y: np.ndarray, codes: np.ndarray, row: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(codes, weights=y[row], minlength=dim), np.bincount(codes, weights=1 - y[row], minlength=dim), [y.sum(), (1 - y).sum()]])

    told = summed(counts)
    n1, n0 = told[-2:]
    if not n1 or not n0:
        return Model(np.zeros(dim, np.float32), prior)
    ratio = np.log((told[:dim] + SMOOTHING) / (n1 + 2 * SMOOTHING)) - np.log((told[dim : 2 * dim] + SMOOTHING) / (n0 + 2 * SMOOTHING))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        shared = context.broadcast((ratio * w[:-1], float(w[-1])))

        def of_rows(y: np.ndarray, codes: np.ndarray, row: np.ndarray) -> np.ndarray:
            weights, bias = shared.value
            sign = 2 * y - 1
            margin = sign * (np.bincount(row, weights=weights[codes], minlength=len(y)) + bias)
            pull = -sign * np.exp(-np.logaddexp(0, margin))
            return np.concatenate([np.bincount(codes, weights=pull[row], minlength=dim), [pull.sum(), np.logaddexp(0, -margin).sum()]])

        found = summed(of_rows)
        shared.destroy()
        return float(found[-1] + PENALTY / 2 * w[:-1].dot(w[:-1])), np.append(found[:dim] * ratio + PENALTY * w[:-1], found[dim])

    w = minimise(loss, np.zeros(dim + 1), ROUNDS)
    shift = prior - float(np.log(n1 / n0))
    return Model((ratio * w[:-1]).astype(np.float32), float(w[-1]) + shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, any other columns but the text, score and predicted, from the text alone; null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB: bounded by GRAM_BITS
    kept = [c for c in docs.columns if c not in ("text", "score", "predicted")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            total = np.full(len(batch), own.bias)
            for row, codes in text_codes(batch.column("text")):
                total[row] += own.weights[codes].sum(dtype=np.float64)
            chance = np.round(1 / (1 + np.exp(-np.clip(total, -500, 500))), 6)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(chance), pa.array((chance >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col("text")).mapInArrow(run, f"{schema}, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = chosen(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    labels = chosen(table(spark, sf_dir, "labels"), doc_id="doc_id", toxic="toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    model = fit(docs, labels)
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model).select("doc_id", "held_out", "score", "predicted")
