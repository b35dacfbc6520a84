"""Ranking: training over groups of alternatives with target probabilities, parameters in tables.

Alternatives have group_id, alt_id, prob (the target) and feats (name -> value).
The objective is the cross entropy of each group's targets, renormalised to 1, and
the softmax of its scores, with a Gaussian prior. Rows are dealt to blocks whatever
their group: a block tells the largest score and the sum of exponentials of its
part of a group, and gets the whole group's back, so no group meets in one task.

Null or negative targets count as 0; a group without any target, and rows without
a group, teach nothing. Null feats and values count as none, an alternative
without features scores 0. Repeated rows are alternatives of their own. An empty
table gives no parameters; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqwright.operators import sharded
from seqwright.scratch import discard, written

#: A feature that every alternative has, so that no block lacks a row; it moves all scores of a group alike and keeps the weight 0.
EVERY = "$=EVERY=$"


class Problem(sharded.Problem):
    """The cells, vocabulary and targets of alternatives as tables."""

    def __init__(self, alternatives: DataFrame, deviation: float, shard_features: int = sharded.SHARD_FEATURES, block_rows: int = sharded.BLOCK_ROWS):
        self.deviation = deviation
        self.classes = ["score"]
        self._made: list[DataFrame] = []
        feats = F.coalesce("feats", F.create_map().cast("map<string,double>"))
        feats = F.map_concat(F.map_filter(feats, lambda k, v: v.isNotNull() & (k != EVERY)), F.create_map(F.lit(EVERY), F.lit(1.0)))
        target = F.greatest(F.coalesce(F.col("prob").cast("double"), F.lit(0.0)), F.lit(0.0))
        rows = alternatives.where("group_id IS NOT NULL").select(F.col("group_id").cast("string").alias("group"), target.alias("target"), feats.alias("feats"))
        self.rows = rows.count()
        self._tables(rows, self.rows, {"group": F.col("group"), "target": F.col("target")}, shard_features, block_rows)

    def missed(self, scores: DataFrame) -> DataFrame:
        def parts(own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            groups, at = np.unique(np.asarray(told["group"].iloc[0], object), return_inverse=True)
            s, target = sharded.added(own["s"], len(at), 1)[:, 0], np.asarray(told["target"].iloc[0], float)
            top = np.full(len(groups), -np.inf)
            np.maximum.at(top, at, s)
            found = pd.DataFrame({"group": groups, "top": top, "z": np.bincount(at, np.exp(s - top[at])), "mass": np.bincount(at, target)})
            return pd.DataFrame({"block": [told["block"].iloc[0]], "s": [sharded._packed(s)], "parts": [found.to_dict("records")]})

        def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for block, s, group, target, back in zip(b["block"], b["s"], b["group"], b["target"], b["back"], strict=True):
                    told = {r["group"]: (r["whole"], r["mass"]) for r in back}
                    whole, mass = np.array([told[g] for g in group]).T
                    s = np.frombuffer(s)
                    target = np.divide(np.asarray(target, float), mass, out=np.zeros(len(s)), where=mass > 0)
                    miss = np.where(mass > 0, np.exp(s - whole) - target, 0.0)
                    out.append((block, sharded._packed(miss), float((target * (whole - s)).sum())))
                yield pd.DataFrame(out, columns=["block", "miss", "loss"])

        kind = "array<struct<group:string,top:double,z:double,mass:double>>"
        found = scores.groupBy("block").cogroup(self.labels.groupBy("block")).applyInPandas(parts, f"block long, s binary, parts {kind}")
        found = written(found, "ranking-scores")
        self._made.append(found)
        every = found.select("block", F.inline("parts"))
        top = every.groupBy("group").agg(F.max("top").alias("highest"), F.sum("mass").alias("whole_mass"))
        whole = every.join(top, "group").groupBy("group").agg((F.max("highest") + F.log(F.sum(F.col("z") * F.exp(F.col("top") - F.col("highest"))))).alias("whole"), F.max("whole_mass").alias("mass"))
        back = every.select("block", "group").join(whole, "group").groupBy("block").agg(F.collect_list(F.struct("group", "whole", "mass")).alias("back"))
        rows = found.select("block", "s").join(self.labels, "block").join(back, "block")
        return rows.mapInPandas(residuals, "block long, miss binary, loss double")

    def evaluated(self, state, factors):
        found = super().evaluated(state, factors)
        discard(*self._made)
        self._made.clear()
        return found


def fit(alternatives: DataFrame, *, deviation: float = 1.0, steps: int = 200, **sizes) -> DataFrame:
    """Parameters (fname, w) of least cross entropy with a Gaussian prior; ``sizes`` are those of :class:`Problem`."""
    problem = Problem(alternatives, deviation, **sizes)
    if not problem.rows:
        return alternatives.sparkSession.createDataFrame([], "fname string, w double")
    found = sharded.parameters(problem, sharded.minimise(problem, steps=steps)[0])
    return found.where(F.col("fname") != EVERY).select("fname", "w")


def scores(alternatives: DataFrame, params: DataFrame) -> DataFrame:
    """group_id, alt_id and score under the parameters, for :func:`maxent.rank`; rows of one alternative add up."""
    one = F.explode_outer("feats").alias("fname", "v")
    rows = alternatives.select("group_id", "alt_id", one).join(params.groupBy("fname").agg(F.sum("w").alias("w")), "fname", "left")
    return rows.groupBy("group_id", "alt_id").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("score"))
