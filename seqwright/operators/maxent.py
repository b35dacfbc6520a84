"""Maximum entropy: scores by joins with a parameter table, training over numbered or hashed features, ranking of alternatives.

Instances have id, label, weight and feats (name -> value). Null feats count as
none, a null weight as 1; rows without a label teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqwright.operators import optimize

BIAS = "$=BIAS=$"


def softmax(scores: Column) -> Column:
    """An array of scores as probabilities, shifted by the largest."""
    exps = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, x: a + x))


def class_scores(instances: DataFrame, params: DataFrame, classes: list[str]) -> DataFrame:
    """id, label_pred and probs (class -> probability) under the parameters (fname, cls, w); the first class wins ties.

    Features are joined a row each and summed a class in one aggregate, so
    neither an instance nor the parameters pass through one place.
    """
    one = F.explode_outer(F.map_concat(F.coalesce("feats", F.create_map().cast("map<string,double>")), F.create_map(F.lit(BIAS), F.lit(1.0))))
    rows = instances.select("id", one.alias("fname", "v"))
    table = params.groupBy("fname").agg(*[F.sum(F.when(F.col("cls") == c, F.col("w"))).alias(f"w{i}") for i, c in enumerate(classes)])
    sums = [F.coalesce(F.sum(F.col("v") * F.col(f"w{i}")), F.lit(0.0)) for i in range(len(classes))]
    scored = rows.join(table, "fname", "left").groupBy("id").agg(F.array(*sums).alias("s"))
    return chosen(scored, classes)


def chosen(scored: DataFrame, classes: list[str]) -> DataFrame:
    """id, label_pred and probs of rows (id, s: a score a class); the first class wins ties."""
    names = F.array(*map(F.lit, classes))
    return scored.withColumn("p", softmax(F.col("s"))).select("id", F.get(names, F.array_position("s", F.array_max("s")).cast("int") - 1).alias("label_pred"), F.map_from_arrays(names, "p").alias("probs"))


@dataclass(frozen=True)
class Model:
    """Weights (features, classes): a row a bucket, or a row each of ``keys``, the features' 64-bit hashes in order."""

    classes: list[str]
    weights: np.ndarray
    keys: np.ndarray | None = None


def _hashed(instances: DataFrame, buckets: int | None) -> DataFrame:
    """``instances`` with fids (buckets, or whole hashes if None) and vals, the bias among them."""
    fid = (lambda k: F.xxhash64(k)) if buckets is None else (lambda k: F.pmod(F.xxhash64(k), F.lit(buckets)))
    feats = F.coalesce("feats", F.create_map().cast("map<string,double>"))
    return instances.withColumns({
        "fids": F.transform(F.concat(F.map_keys(feats), F.array(F.lit(BIAS))), fid),
        "vals": F.concat(F.map_values(feats), F.array(F.lit(1.0))),
    })


def fit(instances: DataFrame, *, buckets: int | None = None, deviation: float = 1.0, steps: int = 200) -> Model:
    """Maximum conditional likelihood with a Gaussian prior, by L-BFGS over Spark jobs until it converges, ``steps`` at most.

    Every feature of the labelled rows has its own weights, or shares those of its bucket where ``buckets`` bounds
    the parameters on the driver. Features that only other rows have would keep the prior's 0.
    """
    labelled = instances.where("label IS NOT NULL")
    classes = sorted(r[0] for r in labelled.select(F.col("label").cast("string")).distinct().collect())  # classes are few
    if not classes:
        return Model([], np.zeros((buckets or 0, 0)), np.zeros(0, np.int64) if buckets is None else None)
    weight = F.coalesce("weight", F.lit(1.0)) if "weight" in instances.columns else F.lit(1.0)
    rows = _hashed(labelled, buckets).select((F.array_position(F.array(*map(F.lit, classes)), F.col("label").cast("string")) - 1).cast("int").alias("y"), weight.alias("weight"), "fids", "vals")
    n, keys = len(classes), None
    if buckets is None:
        keys = np.sort(rows.select(F.explode("fids").alias("k")).distinct().toArrow().column("k").to_numpy())
        shared = instances.sparkSession.sparkContext.broadcast(keys)  # 8 bytes a feature, as the weights of a class

        def number(batches):
            import pyarrow as pa

            for batch in batches:
                fids = batch.column("fids")
                fids = pa.ListArray.from_arrays(np.append(0, np.cumsum(fids.value_lengths().to_numpy())).astype(np.int32), np.searchsorted(shared.value, fids.flatten().to_numpy()))
                yield pa.RecordBatch.from_arrays([fids if name == "fids" else batch.column(name) for name in batch.schema.names], names=batch.schema.names)

        rows = rows.mapInArrow(number, "y int, weight double, fids array<long>, vals array<double>")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    size = buckets if keys is None else len(keys)

    def term(batch, x: np.ndarray, grad: np.ndarray) -> float:
        if not batch.num_rows:
            return 0.0
        fids = batch.column("fids")
        at, v = fids.flatten().to_numpy(), batch.column("vals").flatten().to_numpy(zero_copy_only=False)
        y, weight, sizes = batch.column("y").to_numpy(), batch.column("weight").to_numpy(), fids.value_lengths().to_numpy()
        rows = np.arange(len(y))
        s = np.add.reduceat(v[:, None] * x.reshape(-1, n)[at], np.cumsum(sizes) - sizes)  # no row is without the bias
        s = s - s.max(axis=1, keepdims=True)
        log_p = s - np.log(np.exp(s).sum(axis=1, keepdims=True))
        miss = np.exp(log_p)
        miss[rows, y] -= 1
        miss, own = weight[:, None] * miss, grad.reshape(-1, n)
        for c in range(n):
            own[:, c] += np.bincount(at, v * np.repeat(miss[:, c], sizes), minlength=len(own))
        return -float((weight * log_p[rows, y]).sum())

    x = optimize.lbfgs(optimize.with_prior(lambda x: optimize.summed(rows, term, x, whole=True), deviation), np.zeros(size * n), steps=steps)
    rows.unpersist()
    return Model(classes, x.reshape(size, n), keys)


def predict(instances: DataFrame, model: Model) -> DataFrame:
    """id, label_pred and its probability; null and 0 if nothing was learned."""
    n, shared = len(model.classes), instances.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for batch in batches:
            names, probs = [], []
            for fids, vals in zip(batch.column("fids").to_pylist(), batch.column("vals").to_pylist()):
                fids, vals = np.array(fids), np.array(vals)
                if n and own.keys is not None:
                    at = np.minimum(np.searchsorted(own.keys, fids), len(own.keys) - 1)
                    known = own.keys[at] == fids
                    fids, vals = at[known], vals[known]
                s = vals @ own.weights[fids] if n else np.zeros(1)
                names.append(own.classes[int(s.argmax())] if n else None)
                probs.append(float(1 / np.exp(s - s.max()).sum()) if n else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(probs, pa.float64())], names=["id", "label_pred", "prob"])

    rows = _hashed(instances, None if model.keys is not None else len(model.weights)).select("id", "fids", "vals")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label_pred string, prob double")


def feature_masses(instances: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """fname, cls, mass and share: the classes' probabilities (id, probs: class -> probability) summed over the instances (id, feats) that have a feature, and their share in it.

    For self-training; a feature whose masses are all 0 keeps shares of 0. Instances that have probs
    of their own need no scores.
    """
    rows = instances.select("id", F.map_keys("feats").alias("f"), *(["probs"] if scores is None else []))
    rows = rows if scores is None else rows.join(scores.select("id", "probs"), "id")
    rows = rows.select(F.explode("f").alias("fname"), "probs").select("fname", F.explode("probs").alias("cls", "p"))
    found = rows.groupBy("fname", "cls").agg(F.sum("p").alias("mass"))
    total = F.sum("mass").over(Window.partitionBy("fname"))  # a row a class
    return found.withColumn("share", F.when(total > 0, F.col("mass") / total).otherwise(0.0))


def rank(alternatives: DataFrame) -> DataFrame:
    """``alternatives`` (group_id, alt_id, score) with prob, the softmax over the group, and best, true for its best one (smallest alt_id of ties)."""
    group = Window.partitionBy("group_id")
    exps = F.exp(F.col("score") - F.max("score").over(group))
    found = alternatives.withColumn("__e", exps).withColumn("prob", F.col("__e") / F.sum("__e").over(group))
    return found.withColumn("best", F.row_number().over(group.orderBy(F.desc("score"), "alt_id")) == 1).drop("__e")
