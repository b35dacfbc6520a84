"""Minimisers: the parameters are one bounded vector on the driver, each evaluation is a Spark job over all rows."""

from __future__ import annotations

import itertools
import pickle
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwright.scratch import written

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


#: Tasks whose sums the driver adds up itself: a shuffle of so few takes longer than the sums.
FEW = 8


def summed(rows: DataFrame, term: Callable[..., float], x: np.ndarray, *, whole: bool = False) -> tuple[float, np.ndarray]:
    """Loss and gradient at ``x`` summed over all rows.

    ``term(row, x, grad)`` adds a row's gradient to ``grad`` and returns its loss; with ``whole``, that of a record batch.
    A task sums its own rows and yields what is not zero; Spark adds the tasks'
    sums by parameter, so the driver gets one number a parameter at most, or, of rows
    that :func:`packed` has put into up to ``FEW`` tasks, one a parameter and task.
    """
    shared = rows.sparkSession.sparkContext.broadcast(x)  # as long as the parameters, which their owners bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, loss = np.zeros(len(shared.value)), 0.0
        for batch in batches:
            for row in [batch] if whole else batch.to_pylist():
                loss += term(row, shared.value, grad)
        at = np.flatnonzero(grad)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(grad[at], loss))], names=["at", "g"])

    found = rows.mapInArrow(run, "at long, g double")
    found = (found if getattr(rows, "_seqwright_tasks", FEW + 1) <= FEW else found.groupBy("at").agg(F.sum("g").alias("g"))).toArrow()
    shared.unpersist()
    at, g = found.column("at").to_numpy(), found.column("g").to_numpy()
    return float(g[at < 0].sum()), np.bincount(at[at >= 0], g[at >= 0], minlength=len(x))


#: Places of a task in :func:`packed`, about.
PLACES = 1 << 15


def packed(rows: DataFrame, places: Column, cut: Callable[[pa.RecordBatch], Iterator]) -> DataFrame:
    """``rows`` as the pieces that ``cut`` makes of a record batch, a row each: evaluations read arrays as they are instead of building them anew.

    Equal rows are one, with ``weight``: how many there are, or the sum of their own weights. Tasks
    are as many as the rows' ``places`` need, since an evaluation costs some time a task.
    """
    often = F.sum("weight") if "weight" in rows.columns else F.count("*")
    told = written(rows.groupBy(*[c for c in rows.columns if c != "weight"]).agg(often.cast("double").alias("weight")), "training-rows")
    tasks = max(1, -(-int(told.agg(F.sum(places)).first()[0] or 0) // PLACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(piece, 5) for piece in cut(batch)], pa.binary())], names=["piece"])

    found = told.repartition(tasks).mapInArrow(run, "piece binary")
    found._seqwright_tasks = tasks
    return found


def unpacked(term: Callable[..., float]) -> Callable[..., float]:
    """``term(piece, x, grad)`` for record batches of :func:`packed`."""
    return lambda batch, x, grad: sum(term(pickle.loads(piece.as_buffer()), x, grad) for piece in batch.column("piece"))


def with_prior(objective: Objective, deviation: float) -> Objective:
    """``objective`` and a Gaussian prior of the deviation on every parameter."""

    def both(x: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = objective(x)
        return loss + float(x @ x) / (2 * deviation**2), grad + x / deviation**2

    return both


def lbfgs(objective: Objective, start: np.ndarray, *, memory: int = 6, tolerance: float = 1e-5, past: int = 3, delta: float = 1e-5, steps: int = 200, tries: int = 40) -> np.ndarray:
    """Limited-memory BFGS; steps shrink by 0.5 and grow by 2.1 until both Wolfe conditions hold."""
    x = start.astype(float)
    value, grad = objective(x)
    pairs: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    values = [value]
    for _ in range(steps):
        if np.linalg.norm(grad) <= tolerance * max(1.0, np.linalg.norm(x)):
            break
        way, kept = -grad, []
        for s, y in reversed(pairs):
            kept.append((s @ way) / (s @ y))
            way = way - kept[-1] * y
        if pairs:
            s, y = pairs[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(kept)):
            way = way + (a - (y @ way) / (s @ y)) * s
        slope, step = float(grad @ way), 1.0 if pairs else 1.0 / np.linalg.norm(grad)
        for _ in range(tries):
            at = x + step * way
            new_value, new_grad = objective(at)
            if new_value > value + 1e-4 * step * slope:
                step *= 0.5
            elif new_grad @ way < 0.9 * slope:
                step *= 2.1
            else:
                break
        if new_value > value:
            break
        if (at - x) @ (new_grad - grad) > 0:
            pairs.append((at - x, new_grad - grad))
        x, value, grad = at, new_value, new_grad
        values.append(value)
        if len(values) > past and values[-1 - past] - value <= delta * abs(value):
            break
    return x


#: Fixed values of the step-size adaptation: the largest and the smallest factor of a step, and the bound of the ratio of moves.
MOST, LEAST, BOUND = 0.9999, 0.99, 0.95


def step_factors(start: np.ndarray, middle: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Factors of the step sizes from the parameters before, between and after two periods: near ``MOST`` where the two moves agree, near ``LEAST`` where they turn back."""
    first, second = middle - start, now - middle
    high, low = (MOST + LEAST) * BOUND / (MOST - LEAST), 2 * (1 - MOST) * BOUND / (MOST - LEAST)
    ratio = np.divide(second, first, out=np.zeros_like(first), where=first != 0)
    found = (high + np.clip(ratio, -BOUND, BOUND)) / (high + BOUND + low)
    return np.where(first == 0, np.where(second < 0, LEAST, MOST), found)


def averaged_sgd(rows: DataFrame, term: Callable[[dict, np.ndarray, np.ndarray], float], start: np.ndarray, *, epochs: int = 10, rate: float = 0.1, l1: float = 0.0, momentum: float = 0.0, batch: int = 1, period: int = 0) -> np.ndarray:
    """Stochastic descent: in each epoch every task descends over its own rows from the shared parameters, then tasks are averaged by their rows.

    A step takes the gradients of ``batch`` rows. With ``l1``, parameters move toward
    zero by their step times ``l1`` a step and stop there (cumulative penalty). With
    ``momentum``, that share of a parameter's last move is added. With ``period``, each
    parameter has a step size of its own, adapted every two periods by :func:`step_factors`.
    """
    x, etas = start.astype(float), np.full(len(start), float(rate))
    for _ in range(epochs):
        shared = rows.sparkSession.sparkContext.broadcast((x, etas))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own, steps = (a.copy() for a in shared.value)
            grad, paid, due, moved = (np.zeros(len(own)) for _ in range(4))
            before, middle, n, t = own.copy(), own.copy(), 0, 0
            todo = (row for b in batches for row in b.to_pylist())
            while part := list(itertools.islice(todo, batch)):
                grad[:] = 0
                for row in part:
                    term(row, own, grad)
                n, t = n + len(part), t + 1
                at = np.flatnonzero(grad)
                moved[at] = steps[at] * grad[at] + momentum * moved[at]
                own[at] -= moved[at]
                if l1:
                    due += steps * l1
                    was = own.copy()
                    own = np.where(own > 0, np.maximum(0, own - (due + paid)), np.where(own < 0, np.minimum(0, own + (due - paid)), own))
                    paid += own - was
                if period and t % (2 * period) == 0:
                    steps *= step_factors(before, middle, own)
                    before = own.copy()
                elif period and t % period == 0:
                    middle = own.copy()
            changed = steps - shared.value[1]
            at = np.flatnonzero((own != 0) | (changed != 0)) if n else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(own[at] * n, n)), pa.array(np.append(changed[at] * n, 0.0))], names=["at", "g", "e"])

        found = rows.mapInArrow(run, "at long, g double, e double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("e").alias("e")).toPandas()
        n = float(found.loc[found["at"] < 0, "g"].sum())
        shared.unpersist()
        if not n:
            return x
        found = found[found["at"] >= 0]
        x, at = np.zeros(len(x)), found["at"].to_numpy()
        x[at] = found["g"].to_numpy() / n
        etas[at] += found["e"].to_numpy() / n
    return x
