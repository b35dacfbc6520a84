"""Ranked search against brute force over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from seqwright.llm import search
from seqwright.llm.queries import QUERIES

TERM = re.compile(search.TERM)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=50):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    found = []
    for item, own in asked.items():
        scored = []
        for i, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        found += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(found, key=repr)


def got(rows):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows.collect()), key=repr)


def test_query_against_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    assert got(QUERIES["op11_ranked_search"](spark, path)) == brute(docs, items)


def table(spark, docs, items, extra=True):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    if extra:  # clashing names
        d, i = [x.selectExpr("*", "1 AS shard", "'t' AS term", "2 AS rank", "3 AS score", "4 AS batch", "5 AS df") for x in (d, i)]
    return d, i


@pytest.mark.parametrize("shard_bytes", [1, 200, 1 << 20])
def test_small_shards_and_blocks(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(search, "RUN", 2)
    rng = random.Random(shard_bytes)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(rng.randrange(200), " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300])))) for _ in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 30])))) for k in range(20)]
    d, i = table(spark, docs, items)
    assert got(search.search(search.build(d, shard_bytes=shard_bytes), i, k=7)) == brute(docs, items, 7)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " -- "), (4, "Ärger a\x00b A"), (4, "Ärger a\x00b A"), (None, "a b"), (6, "a " * 5000), (7, "é" * 70000 + " a"), (None, "a b"), (8, "b,b;b"), (9, "c")]
    items = [(1, "A a"), (1, "b"), (2, None), (3, "--"), (4, "unknown"), (5, "ÄRGER ärger Ärger"), (None, "c"), (6, "a"), (6, "a")]
    d, i = table(spark, docs, items)
    assert got(search.search(search.build(d, shard_bytes=50), i)) == brute(docs, items)


def test_no_rows(spark):
    d, i = table(spark, [(1, "a")], [(1, "a")])
    assert got(search.search(search.build(d.limit(0)), i)) == []
    assert got(search.search(search.build(d), i.limit(0))) == []


def test_blocks_below_the_threshold_stay_packed():
    """One rare term in few documents: blocks of the frequent term away from them are never decompressed."""
    n = 50 * search.BLOCK
    texts = ["common" + " rare" * (k in (7, 8, 9)) for k in range(n)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows = search.shard_of(list(range(n)), data, offsets, search.Totals(n, n + 3)).to_pylist()
    factors = np.array(rows[0]["factors"])
    lists = [(search.Postings(r["df"], r["last"], r["top"], r["widths"], r["data"]), 9000 if r["term"] == b"rare" else 1) for r in rows[1:]]
    found = search.best_of(lists, factors, 3, 0)
    assert sorted(d for _, d in found) == [7, 8, 9]
    common = next(p for p, w in lists if w == 1)
    assert len(common.last) == 50 and len(common.known) < 50
    known = search.best_of([(search.Postings(r["df"], r["last"], r["top"], r["widths"], r["data"]), w) for r, (_, w) in zip(rows[1:], lists)], factors, 3, min(s for s, _ in found))
    assert sorted(known) == sorted(found)


def test_packing_round_trip():
    rng = np.random.default_rng(5)
    n = 3000
    texts = [" ".join(["x"] * int(rng.choice([1, 300, 70000], p=[0.97, 0.02, 0.01]))) if rng.random() < 0.3 else "y" for _ in range(n)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    rows = {r["term"]: r for r in search.shard_of(list(range(n)), data, offsets, search.Totals(n, 10 * n)).to_pylist()}
    r = rows[b"x"]
    p = search.Postings(r["df"], r["last"], r["top"], r["widths"], r["data"])
    found = [(int(d), int(c)) for k in range(len(p.last)) for d, c in zip(*p.block(k))]
    assert found == [(i, t.count("x")) for i, t in enumerate(texts) if "x" in t]
