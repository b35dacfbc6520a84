"""Trees and clusters against enumeration."""

import itertools

import numpy as np
import pytest

from seqwright.operators import cluster, parse


def all_trees(n):
    for heads in itertools.product(range(n), repeat=n - 1):
        for v in range(1, n):
            at, steps = v, 0
            while at and steps <= n:
                at, steps = heads[at - 1], steps + 1
            if at:
                break
        else:
            yield list(heads)


def projective(heads):
    arcs = [(min(h, v), max(h, v)) for v, h in enumerate(heads, 1)]
    return not any(a < c < b < d for a, b in arcs for c, d in arcs)


@pytest.mark.parametrize("seed", range(12))
def test_trees_equal_enumeration(seed):
    n = 2 + seed % 4
    scores = np.random.default_rng(seed).normal(size=(n, n)) * 2

    def value(heads):
        return sum(scores[h, v] for v, h in enumerate(heads, 1))

    trees = list(all_trees(n))
    assert parse.maximum_tree(scores) == max(trees, key=value)
    assert parse.eisner(scores) == max(filter(projective, trees), key=value)
    want, z = np.zeros((n, n)), sum(np.exp(value(t)) for t in trees)
    for t in trees:
        for v, h in enumerate(t, 1):
            want[h, v] += np.exp(value(t)) / z
    assert np.allclose(parse.arc_probabilities(scores), want)


def test_tree_rows(spark):
    rows = [(1, 0, 0, 1, 1.0), (1, 0, 1, 2, 2.0), (1, 0, 0, 2, 1.0), (1, 0, 2, 1, 0.0), (2, 0, 2, 1, 1.0), (2, 0, 1, 2, 1.0)]
    arcs = spark.createDataFrame(rows, "doc_id int, seq_id int, gov int, id int, score double")
    for how in (True, False):
        found = {(r.doc_id, r.id): r.gov for r in parse.trees(arcs, projective=how).collect()}
        assert found == {(1, 1): 0, (1, 2): 1, (2, 1): None, (2, 2): None}
    assert parse.trees(arcs.limit(0)).count() == 0


def information(counts):
    total = counts.sum()
    left, right = counts.sum(axis=1), counts.sum(axis=0)
    return sum(counts[i, j] / total * np.log2(counts[i, j] * total / (left[i] * right[j])) for i in range(len(counts)) for j in range(len(counts)) if counts[i, j])


def merge(counts, a, b):
    counts = counts.copy()
    counts[a] += counts[b]
    counts[:, a] += counts[:, b]
    return np.delete(np.delete(counts, b, 0), b, 1)


def test_change_equals_recount():
    counts = np.random.default_rng(3).integers(0, 9, (5, 5)).astype(float)
    inside = cluster._change(counts, counts[1], counts[:, 1], counts[1, 1], counts[1].sum(), counts[:, 1].sum(), counts.sum(), 1)
    for b in (0, 2, 3, 4):
        assert np.isclose(inside[b], information(merge(counts, 1, b)) - information(counts))
    small = counts[:4, :4]
    outside = cluster._change(small, counts[4, :4], counts[:4, 4], counts[4, 4], counts[4].sum(), counts[:, 4].sum(), counts.sum())
    for b in range(4):
        assert np.isclose(outside[b], information(merge(counts, b, 4)) - information(counts))
    assert sorted(cluster.paths(counts))[0].startswith("0") and len(set(cluster.paths(counts))) == 5


def test_clusters_keep_like_words_together(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng, text = np.random.default_rng(5), []
    for d in range(60):
        words = [(("a1", "a2", "a3", "a4"), ("b1", "b2", "b3", "b4"))[i % 2][int(rng.choice(4, p=[0.4, 0.3, 0.2, 0.1]))] for i in range(20)]
        text += [(d, i, w) for i, w in enumerate(words)]
    found = {r.tok: r for r in cluster.clusters(spark.createDataFrame(text, "doc_id int, pos int, tok string"), 4).collect()}
    assert len(found) == 8 and len({r.cluster for r in found.values()}) == 4
    assert {r.path[0] for w, r in found.items() if w[0] == "a"} != {r.path[0] for w, r in found.items() if w[0] == "b"}
    assert len({r.path[0] for w, r in found.items() if w[0] == "a"}) == 1


def test_changes_equal_change():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 9, (5, 5)).astype(float)
    side, item, k = np.nonzero(rng.integers(0, 3, (3, 7, 5)).clip(0, 1) * [[[1]], [[1]], [[0]]])
    c = rng.integers(1, 9, len(k)).astype(float)
    side, item, k, c = np.append(side, 2), np.append(item, 3), np.append(k, 0), np.append(c, 4.0)
    order = np.argsort(item, kind="stable")
    found = cluster._changes(counts, 8, item[order], side[order], k[order], c[order])
    for i in range(8):  # the last has no neighbours
        near = np.zeros((3, 5))
        near[side[item == i], k[item == i]] = c[item == i]
        own, total = near[2, 0], counts.sum() + near.sum()
        assert np.allclose(found[i] / total, cluster._change(counts, near[0], near[1], own, near[0].sum() + own, near[1].sum() + own, total))


def test_registered_clusters_hold_every_document_word(spark, tmp_path):
    from seqwright.plans import catalogue

    text = ["c0 " + " ".join(f"w{(d * 7 + i * i) % 90}" for i in range(40)) for d in range(30)] + [None, ""]
    spark.createDataFrame([(d, t) for d, t in enumerate(text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "tiny part")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.word_clusters(spark, str(tmp_path)).collect()
    assert sorted(r.tok for r in found) == sorted({w for t in text if t for w in t.split()})
    assert len({r.cluster for r in found}) == len({r.path for r in found}) <= 32


def test_clusters_look_at_texts_once(spark, tmp_path):
    """Tokens' counts come from the bigrams' own table, the last token's included; arrays give what rows of tokens give."""
    texts = ["a b a b c a", "c", "", None, "b a c d d d e", "e a b"] * 3
    docs = spark.createDataFrame([(d, t.split() if t is not None else None) for d, t in enumerate(texts)], "doc_id int, toks array<string>")
    looks = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            looks.add(batch.num_rows)
            yield batch

    found = cluster.array_clusters(docs.mapInArrow(seen, docs.schema).select("toks"), 3)
    assert sorted(r.tok for r in found.collect()) == ["a", "b", "c", "d", "e"] and looks.value == len(texts)
    rows = spark.createDataFrame([(d, i, w) for d, t in enumerate(texts) for i, w in enumerate((t or "").split())], "doc_id int, pos int, tok string")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, cluster.clusters(rows, 3).collect()))
