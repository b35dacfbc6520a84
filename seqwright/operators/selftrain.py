"""Self-training of maximum entropy: what a model says of unlabelled rows becomes features of labelled ones.

A round scores the unlabelled instances (id, feats), sums the classes'
probabilities by feature, and trains anew on the labelled instances with
induced features: a value a class for each kind of feature, the smoothed share
of the class in the masses of the instance's features. A round's masses and
parameters are tables in the shared folder, so that no round is worked out
again for a later one. Ids are unique; null feats count as none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwright.operators import maxent, sharded
from seqwright.scratch import written

Kind = Callable[[Column], Column]


def one_kind(fname: Column) -> Column:
    return F.lit("")


def shares(instances: DataFrame, masses: DataFrame, classes: list[str], kind: Kind = one_kind) -> DataFrame:
    """id, kind and shares (an array by class): (1 + the class's mass) / (classes + all masses), summed over an instance's features of a kind.

    ``masses`` (fname, cls, mass) as of :func:`maxent.feature_masses`. Features without masses count for
    nothing; kinds without any other have no row.
    """
    table = masses.groupBy("fname").agg(*[F.sum(F.when(F.col("cls") == c, F.col("mass")).otherwise(0.0)).alias(f"m{i}") for i, c in enumerate(classes)])
    rows = instances.select("id", F.explode(F.map_keys("feats")).alias("fname")).join(table, "fname")
    sums = rows.groupBy("id", kind(F.col("fname")).alias("kind")).agg(*[(F.sum(f"m{i}") + 1.0).alias(f"m{i}") for i in range(len(classes))])
    total = sum((F.col(f"m{i}") for i in range(1, len(classes))), F.col("m0"))
    return sums.select("id", "kind", F.array(*[F.col(f"m{i}") / total for i in range(len(classes))]).alias("shares"))


def induced(instances: DataFrame, masses: DataFrame, classes: list[str], kind: Kind = one_kind) -> DataFrame:
    """``instances`` with the shares of each kind as features ``$=IND=$|kind|class`` beside their own."""
    names = lambda k: F.array(*[F.concat_ws("|", F.lit("$=IND=$"), k, F.lit(c)) for c in classes])
    found = shares(instances, masses, classes, kind)
    entries = F.flatten(F.collect_list(F.arrays_zip(names(F.col("kind")).alias("n"), F.col("shares").alias("v"))))  # a row a kind, of which there are few
    found = found.groupBy("id").agg(F.map_from_entries(entries).alias("__induced"))
    none = F.create_map().cast("map<string,double>")
    feats = F.map_concat(F.coalesce("feats", none), F.coalesce("__induced", none))
    return instances.join(found, "id", "left").withColumn("feats", feats).drop("__induced")


@dataclass(frozen=True)
class Trained:
    """A model after some rounds: parameters (fname, cls, w) and the masses that its induced features come from, None before the first round."""

    classes: list[str]
    params: DataFrame
    masses: DataFrame | None
    kind: Kind

    def features(self, instances: DataFrame) -> DataFrame:
        return instances if self.masses is None else induced(instances, self.masses, self.classes, self.kind)

    def scores(self, instances: DataFrame) -> DataFrame:
        """id, label_pred and probs of instances (id, feats); of none if nothing was learnt."""
        if not self.classes:
            return instances.select("id", F.lit(None).cast("string").alias("label_pred"), F.lit(None).cast("map<string,double>").alias("probs"))
        return maxent.class_scores(self.features(instances), self.params, self.classes)


def rounds(labelled: DataFrame, unlabelled: DataFrame, n: int, *, kind: Kind = one_kind, fit: Callable[..., tuple[list[str], DataFrame]] = sharded.fit, **how) -> list[Trained]:
    """The model of the labelled rows alone, and the one after each of ``n`` rounds.

    ``fit`` takes instances and ``how`` and gives classes and a table of parameters. Labelled rows that
    share no feature with unlabelled ones get no induced features. Without any label all models are empty.
    """
    classes, params = fit(labelled, **how)
    found = [Trained(classes, params, None, kind)]
    for _ in range(n if classes else 0):
        masses = written(maxent.feature_masses(unlabelled, found[-1].scores(unlabelled)).select("fname", "cls", "mass"), "masses")
        classes, params = fit(induced(labelled, masses, found[-1].classes, kind), **how)
        found.append(Trained(classes, params, masses, kind))
    return found
