"""Hierarchical word clusters by mutual information of neighbouring clusters.

The most frequent words are a cluster each. The other words join by bands of
their frequency, each band as many words as came before: every word of a band
takes the cluster that keeps most mutual information, by the counts so far.
Last, the clusters are merged pair by pair into one tree, whose branches are
the words' bit strings. Spark counts and assigns; the driver holds a square
matrix of the number of clusters, a parameter. A band's words join at the same
time, where one-by-one insertion would let each see the ones before it. Each
bigram is read into counts once, in the band of its rarer word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqwright.operators.convert import numbered
from seqwright.scratch import new_path, remove


def _information(n: np.ndarray, left: np.ndarray, right: np.ndarray, total: float) -> np.ndarray:
    """n / N log2(n N / (left right)); 0 where n is 0."""
    ratio = np.divide(n * total, left * right, out=np.ones(np.broadcast_shapes(n.shape, np.shape(left * right))), where=n > 0)
    return n / total * np.log2(ratio)


def _change(counts: np.ndarray, a_row: np.ndarray, a_column: np.ndarray, a_self: float, a_left: float, a_right: float, total: float, apart: int | None = None) -> np.ndarray:
    """Mutual information gained (mostly lost) by merging an item with each cluster; ``apart`` is the item's own number among the clusters."""
    n = len(counts)
    left, right = counts.sum(axis=1), counts.sum(axis=0)
    if apart is None:  # the item's counts are not in the clusters' margins
        left, right = left + a_column, right + a_row
    old = _information(counts, left[:, None], right[None, :], total)
    rows, columns = a_row[None, :] + counts, a_column[None, :] + counts.T
    new_rows = _information(rows, (a_left + left)[:, None], right[None, :], total)
    new_columns = _information(columns, (a_right + right)[:, None], left[None, :], total)
    own_row, own_column = _information(a_row, a_left, right, total), _information(a_column, left, a_right, total)
    own = _information(np.array(a_self), np.array(a_left), np.array(a_right), total)
    for m in (new_rows, new_columns):
        m[range(n), range(n)] = 0
        if apart is not None:
            m[:, apart] = 0
    both = counts.diagonal() + a_row + a_column + a_self
    gained = new_rows.sum(axis=1) + new_columns.sum(axis=1) + _information(both, a_left + left, a_right + right, total)
    lost = old.sum(axis=1) + old.sum(axis=0) - old.diagonal() + own_row.sum() + own_column.sum() + own
    if apart is not None:
        lost = lost - own_row - own_column - 2 * own
    return gained - lost


def _f(x: np.ndarray) -> np.ndarray:
    """x log2(x), 0 at 0."""
    return x * np.log2(x, out=np.zeros(np.shape(x)), where=x > 0)


def _changes(counts: np.ndarray, n: int, item: np.ndarray, side: np.ndarray, k: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``_change`` of ``n`` items outside the clusters with each cluster, times N: a row an item.

    The items' counts come sparse and in the order of items: ``c`` with cluster ``k`` after (side 0) or before (1)
    the item, or with itself (2). With N fixed, mutual information is the sum of x log2(x) over cells less that over
    margins, so that only the cells of an item's neighbours and two margins change.
    """
    size = len(counts)
    dense = np.zeros((3, n, size))
    np.add.at(dense, (side, item, k), c)
    ahead, behind, own = dense[0], dense[1], dense[2, :, 0]
    gained = np.zeros((n, size))
    cells = np.stack([counts.T, counts])  # by side and neighbour, a row of all clusters
    near = np.flatnonzero(side < 2)
    for low in range(0, len(near), 1 << 14):
        at = near[low : low + (1 << 14)]
        there, more = cells[side[at], k[at]], c[at][:, None]
        new = _f(there + more) - _f(there) - _f(more)
        new[np.arange(len(at)), k[at]] = 0  # the cell of the cluster with itself
        first = np.flatnonzero(np.diff(item[at], prepend=-1))
        gained[item[at][first]] += np.add.reduceat(new, first)
    self_cells = counts.diagonal()
    gained += _f(self_cells + ahead + behind + own[:, None]) - _f(self_cells) - _f(ahead) - _f(behind) - _f(own)[:, None]
    for margin, out in ((counts.sum(axis=1) + behind, ahead.sum(axis=1) + own), (counts.sum(axis=0) + ahead, behind.sum(axis=1) + own)):
        gained -= _f(margin + out[:, None]) - _f(margin) - _f(out)[:, None]
    return gained


def paths(counts: np.ndarray) -> list[str]:
    """The bit string of each cluster: greedy merges of the pair that loses least, each a branch (0 for the lower number)."""
    groups = [[i] for i in range(len(counts))]
    bits = [""] * len(counts)
    counts = counts.astype(float)
    total = max(counts.sum(), 1.0)
    while len(groups) > 1:
        best = (-np.inf, 0, 1)
        for a in range(len(groups) - 1):
            change = _change(counts, counts[a], counts[:, a], counts[a, a], counts[a].sum(), counts[:, a].sum(), total, a)[a + 1 :]
            b = int(change.argmax())
            best = max(best, (float(change[b]), a, a + 1 + b), key=lambda t: t[0])
        _, a, b = best
        for bit, group in (("0", groups[a]), ("1", groups[b])):
            for i in group:
                bits[i] = bit + bits[i]
        counts[a] += counts[b]
        counts[:, a] += counts[:, b]
        counts = np.delete(np.delete(counts, b, 0), b, 1)
        groups[a] += groups.pop(b)
    return bits


def clusters(toks: DataFrame, n: int) -> DataFrame:
    """tok, cluster and path of every token of the table (doc_id, pos, tok), in at most ``n`` clusters."""
    after = F.lead("tok").over(Window.partitionBy("doc_id").orderBy("pos"))
    return clusters_of(toks.select(F.col("tok").alias("a"), after.alias("b")), n)


def array_clusters(docs: DataFrame, n: int) -> DataFrame:
    """:func:`clusters` of documents whose tokens, none of them null, are an array each (toks): neighbours are next to each other already, so nothing is dealt or sorted."""
    after = F.slice("toks", F.lit(2), F.greatest(F.size("toks"), F.lit(0)))
    return clusters_of(docs.select(F.inline(F.arrays_zip(F.col("toks").alias("a"), after.alias("b")))), n)


def clusters_of(pairs: DataFrame, n: int) -> DataFrame:
    """tok, cluster and path of every token a, from rows of a token and the one after it (a, b; b is null at a document's end)."""
    spark = pairs.sparkSession
    folder = new_path(spark, "clusters")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    bigrams = written(pairs.groupBy("a", "b").agg(F.count("*").alias("c")), "bigrams")  # the one look at the texts: tokens' counts are sums of it
    ids = written(numbered(written(bigrams.groupBy(F.col("a").alias("fname")).agg(F.sum("c").alias("n")), "counts")), "ids")
    words = bigrams.where("b IS NOT NULL").join(ids.select(F.col("fname").alias("a"), F.col("fid").alias("x")), "a").join(ids.select(F.col("fname").alias("b"), F.col("fid").alias("y")), "b")
    words = written(words.select("x", "y", "c", F.greatest("x", "y").alias("top")).sortWithinPartitions("top"), "words")  # sorted, so that a band reads its own pages
    remove(spark, [f"{folder}/{name}" for name in ("bigrams", "counts")])
    size = ids.count()
    done = min(n, size)
    counts = np.zeros((done, done))
    joined = spark.range(1, done + 1).select(F.col("id").alias("fid"), (F.col("id") - 1).cast("int").alias("cluster"))

    def add(cells: DataFrame) -> None:
        found = cells.groupBy("i", "j").agg(F.sum("c").alias("c")).toPandas()  # n squared at most
        counts[found["i"].to_numpy(int), found["j"].to_numpy(int)] += found["c"].to_numpy(float)

    add(words.where(F.col("top") <= done).select((F.col("x") - 1).alias("i"), (F.col("y") - 1).alias("j"), "c"))
    schema = "fid long, cluster int, k int, c double"
    joined.select("fid", "cluster", F.lit(None).cast("int").alias("k"), F.lit(None).cast("double").alias("c")).write.parquet(f"{folder}/known/band=0")
    number = 0
    while done < size:
        number += 1
        known = spark.read.schema(schema).parquet(*[f"{folder}/known/band={b}" for b in range(number)]).where("fid IS NOT NULL").select("fid", "cluster")
        band = ids.where((F.col("fid") > done) & (F.col("fid") <= 2 * done)).select("fid")
        pairs = words.where((F.col("top") > done) & (F.col("top") <= 2 * done))
        sides = pairs.where(F.least("x", "y") <= done).select(F.col("top").alias("to"), F.least("x", "y").alias("fid"), (F.col("y") > F.col("x")).cast("int").alias("side"), "c")
        sides = sides.join(known, "fid").groupBy(F.col("to").alias("fid"), "side", F.col("cluster").alias("k")).agg(F.sum("c").alias("c"))
        own = pairs.where("x = y").select(F.col("x").alias("fid"), F.lit(2).alias("side"), F.lit(0).alias("k"), "c")
        seen = sides.unionByName(own).groupBy("fid").agg(F.collect_list(F.struct("side", "k", "c")).alias("s"))  # 2 n + 1 a word at most
        shared = spark.sparkContext.broadcast(counts.copy())

        def choose(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """The band's words with their clusters, then what they add to the matrix: rows without a fid."""
            names = ["fid", "cluster", "k", "c"]
            added = np.zeros_like(shared.value)
            for batch in batches:
                column, rows = batch.column("s"), batch.num_rows
                side, k, c = (e.to_numpy(zero_copy_only=False) for e in column.flatten().flatten())
                c = c.astype(float)
                item = np.repeat(np.arange(rows), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                picked = _changes(shared.value, rows, item, side, k, c).argmax(axis=1).astype(np.int32)
                to = picked[item]
                np.add.at(added, (np.where(side == 1, k, to), np.where(side == 0, k, to)), c)
                yield pa.RecordBatch.from_arrays([batch.column("fid"), pa.array(picked), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.float64())], names=names)
            i, j = np.nonzero(added)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int64()), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(added[i, j])], names=names)

        found = written(band.join(seen, "fid", "left").mapInArrow(choose, schema), f"known/band={number}")
        add(found.where("fid IS NULL").select(F.col("cluster").alias("i"), F.col("k").alias("j"), "c"))
        new = found.where("fid IS NOT NULL").select("fid", "cluster")
        add(pairs.where((F.least("x", "y") > done) & (F.col("x") != F.col("y"))).join(new.toDF("x", "i"), "x").join(new.toDF("y", "j"), "y").select("i", "j", "c"))
        shared.unpersist()
        done *= 2
    bits = paths(counts) if size else []
    names = spark.createDataFrame(list(enumerate(bits)), "cluster int, path string")  # a row a cluster
    known = spark.read.schema(schema).parquet(*[f"{folder}/known/band={b}" for b in range(number + 1)]).where("fid IS NOT NULL").select("fid", "cluster")
    return known.join(ids, "fid").join(names, "cluster").select(F.col("fname").alias("tok"), "cluster", "path")
