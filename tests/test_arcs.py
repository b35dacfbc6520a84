"""Features of arcs and of their labels against a plain loop, and parsers trained with them."""

import random

import pytest
from pyspark.sql import functions as F

from seqwright.operators import arcs, crf, parse

SENTENCE = [("the", "D", "d", "t"), ("old", "A", "a", "old"), ("dog", "N", "n", "d"), ("barks", "V", "v", "b")]


def table(spark, sentences):
    rows = [(d, s, i, *word) for (d, s), words in sentences.items() for i, word in enumerate(words, 1)]
    return spark.createDataFrame(rows, "doc_id long, seq_id int, id int, tok string, pos string, cpos string, pref string, gov int, label string")


def plain(words, gov, i):
    """All features of one arc, by templates written out."""
    def at(k, n):
        return "<start>" if k < 1 else words[k - 1][n] if k <= len(words) else "<end>"

    h = ("<root>",) * 4 if gov == 0 else words[gov - 1]
    c = words[i - 1]
    far = abs(gov - i)
    side = -1 if gov < i else 1
    far = side * (11 if far > 10 else 6 if far > 5 else far)
    out = {}

    def add(label, *values):
        key = "|".join([label, *map(str, values)])
        out[key] = out.get(key, 0) + 1

    add("tags", h[1], c[1])
    add("words", h[0], c[0])
    if i > 1:
        add("tag before", words[i - 2][1])
        add("word before", words[i - 2][0])
    v = {"htok": h[0], "hpos": h[1], "hpref": h[3], "ctok": c[0], "cpos": c[1], "cpref": c[3]}
    for parts in ("hpos", "htok", "cpos", "ctok", "htok,hpos", "ctok,cpos"):
        own = [v[p] for p in parts.split(",")]
        add(parts, *own)
        add(parts + "~far", *own, far)
        add(parts + "~side", *own, side)
    for parts in ("hpos,cpos", "htok,ctok", "htok,hpos,cpos", "hpos,ctok,cpos", "hpos,ctok", "htok,cpos", "htok,hpos,ctok,cpos"):
        own = [v[p] for p in parts.split(",")]
        add("both:" + parts, *own)
        add("both:" + parts + "~far", *own, far)
    prefixed = ["hpref,cpref", "hpref,hpos,cpref,cpos"] if h[0] != h[3] or c[0] != c[3] else []
    prefixed += ["hpos,cpref,cpos", "hpos,cpref", "cpref,cpos", "cpref"] if c[0] != c[3] else []
    prefixed += ["hpref,hpos,cpos", "hpref,cpos", "hpref,hpos", "hpref"] if h[0] != h[3] else []
    for parts in prefixed:
        own = [v[p] for p in parts.split(",")]
        add(parts, *own)
        add(parts + "~far", *own, far)
    for k in range(min(gov, i) + 1, max(gov, i)):
        for n, level in ((1, "pos"), (2, "cpos")):
            three = (h[n], words[k - 1][n], c[n]) if gov < i else (c[n], words[k - 1][n], h[n])
            add(f"between {level}", *three)
            add(f"between {level}~far", *three, far)
            add(f"between {level}~side", *three, side)
    for name, n, level in (("surround", 1, "pos"), ("coarse_surround", 2, "cpos")):
        value = {"c-": at(i - 1, n), "c": c[n], "c+": at(i + 1, n), "h-": at(gov - 1, n), "h": h[n], "h+": at(gov + 1, n)}
        for parts in ("c- c h h+", "c- c h", "c- c h+", "c- h h+", "c h h+", "c+ c h h-", "c+ c h", "c+ c h-", "c+ h h-", "c h h-", "c- c h- h", "c+ c h+ h"):
            own = [value[p] for p in parts.split()]
            full = name + ":" + ",".join(p[0] + level + p[1:] for p in parts.split())
            add(full, *own)
            add(full + "~side", *own, side)
    return out


def drawn(seed, n):
    r = random.Random(seed)
    return [(r.choice(["a", "bb", "|", "", "é"]), r.choice("XY"), r.choice("xy"), r.choice(["a", "b", ""]), None, None) for _ in range(n)]


def test_features_equal_a_plain_loop(spark):
    sentences = {(1, 0): [(*w, None, None) for w in SENTENCE], (1, 1): drawn(1, 1), (2, 0): drawn(2, 16), (2, 1): drawn(3, 7)}
    found = {(r.doc_id, r.seq_id, r.gov, r.id): (r.feats, r.gold) for r in arcs.features(table(spark, sentences)).collect()}
    assert len(found) == sum(len(w) ** 2 for w in sentences.values())
    for (d, s, gov, i), (feats, gold) in found.items():
        assert feats == plain(sentences[d, s], gov, i)
        assert gold is None


def test_sets_reach_and_odd_rows(spark):
    words = table(spark, {(1, 0): [(*w, 2 if i == 0 else None, None) for i, w in enumerate(SENTENCE)]})
    near = arcs.features(words, ("basic",), reach=1).collect()
    assert {(r.gov, r.id) for r in near} == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (4, 3)}
    assert {r.gold for r in near if r.id == 1} == {True, False}
    assert all(len(r.feats) == 2 for r in near)
    with pytest.raises(ValueError):
        arcs.features(words, ("basics",))
    assert arcs.features(words.limit(0)).count() == 0
    bare = spark.createDataFrame([(1, 0, 1, None, None), (1, 0, 2, "x", None)], "doc_id long, seq_id int, id int, tok string, pos string")
    feats = {(r.gov, r.id): r.feats for r in arcs.features(bare).collect()}
    rows = [("", "", "", ""), ("x", "", "", "x")]
    assert feats == {(g, i): plain(rows, g, i) for g, i in ((0, 1), (0, 2), (1, 2), (2, 1))}


def test_weights_from_a_table(spark):
    feats = arcs.features(table(spark, {(1, 0): [(*w, None, None) for w in SENTENCE]}), ("basic",))
    weights = spark.createDataFrame([("tags|<root>|V", 5.0), ("words|dog|the", 2.0), ("unseen", 9.0)], "fname string, w double")
    found = {(r.gov, r.id): r.score for r in arcs.weighed(feats, weights).collect()}
    assert len(found) == 16
    assert {k: v for k, v in found.items() if v} == {(0, 4): 5.0, (3, 1): 2.0}


def grammar(seed):
    """Determiners and adjectives depend on their noun, nouns on the verb, the verb on the root."""
    r = random.Random(seed)
    words, nouns, loose = [], [], []
    verb = None
    for side in (0, 1):
        for _ in range(r.randint(1, 2)):
            start = len(words) + 1
            words += [["d%d" % r.randint(0, 2), "D", None, "det"]] * r.randint(0, 1)
            words += [["a%d" % r.randint(0, 4), "A", None, "mod"] for _ in range(r.randint(0, 2))]
            words.append(["n%d" % r.randint(0, 9), "N", None, "arg1" if side else "arg0"])
            nouns.append(len(words))
            loose += [(k, len(words)) for k in range(start, len(words))]
        if side == 0:
            words.append(["v%d" % r.randint(0, 5), "V", 0, "root"])
            verb = len(words)
    words = [list(w) for w in words]
    for k, noun in loose:
        words[k - 1][2] = noun
    for noun in nouns:
        words[noun - 1][2] = verb
    return [(w[0], w[1], w[1], w[0], w[2], w[3]) for w in words]


@pytest.mark.parametrize("projective", [True, False])
def test_a_trained_parser_finds_heads_of_unseen_sentences(spark, projective):
    sets = ("unigram", "bigram", "between", "surround")
    train = arcs.features(table(spark, {(d, 0): grammar(d) for d in range(40)}), sets)
    model = parse.fit(train, projective=projective, steps=25)
    new = {(d, 0): grammar(d) for d in range(1000, 1020)}
    found = parse.trees(parse.scored(arcs.features(table(spark, new), sets), model), projective=projective).collect()
    right = [new[r.doc_id, 0][r.id - 1][4] == r.gov for r in found]
    assert len(right) == sum(map(len, new.values()))
    assert sum(right) / len(right) > 0.95


def test_labels_of_arcs(spark):
    rows = {(r.pos): (r.label, r.feats) for r in arcs.label_features(table(spark, {(1, 0): [("the", "D", "D", "the", 2, "det"), ("dog", "N", "N", "dog", 0, "root"), ("!", ".", ".", "!", 9, None)]})).collect()}
    assert rows[0] == ("det", {"word|the": 1.0, "tag|D": 1.0, "head tag|N": 1.0, "word and head|the|dog": 1.0})
    assert rows[1] == ("root", {"word|dog": 1.0, "tag|N": 1.0, "head tag|<root>": 1.0})
    assert rows[2] == (None, {"word|!": 1.0, "tag|.": 1.0})
    labels = ["arg0", "arg1", "det", "mod", "root"]
    side = F.array(F.concat(F.lit("head is left "), (F.col("x.gov") < F.col("x.id")).cast("string")))  # tells arg0 from arg1
    train = crf.sequences(arcs.label_features(table(spark, {(d, 0): grammar(d) for d in range(40)}), side), labels)
    model = crf.fit(train, labels, steps=25)
    new = {(d, 0): grammar(d) for d in range(1000, 1020)}
    found = crf.decode(crf.sequences(arcs.label_features(table(spark, new), side), labels), model)
    right = [new[r.doc_id, 0][r.pos][5] == r.label_pred for r in found.select("doc_id", "pos", "label_pred").collect()]
    assert len(right) == sum(map(len, new.values())) and sum(right) / len(right) > 0.95


def test_forward_pairs_are_not_made_backward(spark):
    words = table(spark, {(1, 0): grammar(1), (2, 0): grammar(2)})
    key = ["doc_id", "seq_id", "gov", "id"]
    for reach in (None, 1):
        every = arcs.features(words, ("basic",), reach=reach).where("gov < id")
        found = arcs.features(words, ("basic",), reach=reach, forward=True)
        assert sorted(map(tuple, found.select(*key, F.map_keys("feats")).collect())) == sorted(map(tuple, every.select(*key, F.map_keys("feats")).collect()))


def test_trees_without_probabilities(spark):
    rows = spark.createDataFrame([(1, 0, 0, 1, 1.0), (1, 0, 1, 2, 2.0), (1, 0, 0, 2, 0.5), (2, 0, 2, 1, 1.0), (2, 0, 1, 2, 1.0)], "doc_id long, seq_id int, gov int, id int, score double")
    key = ["doc_id", "id", "gov"]
    plain = parse.trees(rows, projective=False, probable=False)
    assert plain.columns == ["doc_id", "seq_id", "id", "gov"]
    found = parse.trees(rows, projective=False)
    assert sorted(map(tuple, plain.select(key).collect()), key=str) == sorted(map(tuple, found.select(key).collect()), key=str) == [(1, 1, 0), (1, 2, 1), (2, 1, None), (2, 2, None)]
    assert {r.prob is None for r in found.where("doc_id = 2").collect()} == {True}
