"""Features of the arcs that a dependency tree may have, and of the labels of those it has.

Words are rows (doc_id, seq_id, id, tok, pos; optional cpos, pref, gov, label):
ids of a sentence run from 1 without gaps, gov 0 is the root. A coarse tag
``cpos`` that is missing is the tag, a missing ``pref`` (the word's start or its
cluster) the word; nulls count as empty strings. A sentence is one row of
arrays, from which its pairs of words are unfolded; what lies between two words
is counted by differences of running counts a tag, not by a row a word. In place
of words all functions take the rows of :func:`rows`, a sentence each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqwright.scratch import written

ROOT, START, END = "<root>", "<start>", "<end>"
SETS = ("basic", "before", "unigram", "prefix", "bigram", "between", "surround", "coarse_surround")

_UNIGRAM = [("hpos",), ("htok",), ("cpos",), ("ctok",), ("htok", "hpos"), ("ctok", "cpos")]
_BIGRAM = [("hpos", "cpos"), ("htok", "ctok"), ("htok", "hpos", "cpos"), ("hpos", "ctok", "cpos"), ("hpos", "ctok"), ("htok", "cpos"), ("htok", "hpos", "ctok", "cpos")]
#: Back-off to the start of both words, of the dependent alone, and of the head alone.
_PREFIX = [("hpref", "cpref"), ("hpref", "hpos", "cpref", "cpos")]
_PREFIX_C = [("hpos", "cpref", "cpos"), ("hpos", "cpref"), ("cpref", "cpos"), ("cpref",)]
_PREFIX_H = [("hpref", "hpos", "cpos"), ("hpref", "cpos"), ("hpref", "hpos"), ("hpref",)]


def _root() -> Column:
    return F.struct(F.lit(0).alias("id"), *[F.lit(ROOT).alias(n) for n in ("tok", "pos", "cpos", "pref")], F.lit(None).cast("int").alias("gov"), F.lit(None).cast("string").alias("label"))


def rows(sentences: DataFrame, word: Callable[[Column], dict[str, Column]], gov: str | None = None) -> DataFrame:
    """doc_id, seq_id and w: sentences (doc_id, seq_id, toks and, if named, their heads ``gov``, an array too) as rows that stand for their words.

    ``word`` makes tok, pos and optionally cpos, pref and label from a token.
    """

    def one(x: Column, i: Column) -> Column:
        own = word(x)
        own = {"cpos": own["pos"], "pref": own["tok"]} | own
        text = [F.coalesce(own[n].cast("string"), F.lit("")).alias(n) for n in ("tok", "pos", "cpos", "pref")]
        head = F.get(F.col(gov), i).cast("int") if gov else F.lit(None).cast("int")
        return F.struct((i + 1).alias("id"), *text, head.alias("gov"), own.get("label", F.lit(None)).cast("string").alias("label"))

    return sentences.select("doc_id", "seq_id", F.concat(F.array(_root()), F.transform("toks", one)).alias("w"))


def _sentences(words: DataFrame) -> DataFrame:
    """doc_id, seq_id and w: the root and the words of a sentence in order."""
    if "w" in words.columns:
        return words.select("doc_id", "seq_id", "w")
    empty = F.lit("")
    text = lambda name, other: F.coalesce(F.col(name if name in words.columns else other).cast("string"), empty).alias(name)
    head = (F.col("gov") if "gov" in words.columns else F.lit(None)).cast("int").alias("gov")
    label = (F.col("label") if "label" in words.columns else F.lit(None)).cast("string").alias("label")
    word = F.struct(F.col("id").cast("int").alias("id"), text("tok", "tok"), text("pos", "pos"), text("cpos", "pos"), text("pref", "tok"), head, label)
    # a stated number of partitions stays as it is: small sentences unfold to many pairs
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = words.repartition(parts, "doc_id", "seq_id").groupBy("doc_id", "seq_id").agg(F.array_sort(F.collect_list(word)).alias("w"))
    return rows.select("doc_id", "seq_id", F.concat(F.array(_root()), "w").alias("w"))


def _running(level: str) -> Column:
    """A row a tag of the sentence: the tag and how many words before each place have it."""
    tags = F.array_distinct(F.transform(F.slice("w", 2, F.size("w")), lambda x: x[level]))
    counts = lambda t: F.aggregate("w", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + (x[level] == t).cast("int"))))
    return F.transform(tags, lambda t: F.struct(t.alias("tag"), counts(t).alias("n")))


def pairs(words: DataFrame, sets: tuple[str, ...] = SETS, *, reach: int | None = None, forward: bool = False) -> DataFrame:
    """A row a pair of a word and what may govern it: doc_id, seq_id, gov, id, gold and what the features of ``sets`` are made of.

    gold tells whether the word's given head is this one, null where none is given. With ``reach``
    no arc is longer than so many words, but for those from the root; with ``forward`` heads stand before their words.
    """
    rows = _sentences(words)
    kinds = ("tok", "pos") if set(sets) <= {"basic"} else ("tok", "pos", "cpos", "pref")
    levels = [level for name, level in (("surround", "pos"), ("coarse_surround", "cpos"), ("before", "pos")) if name in sets]
    runs = ("fine", "coarse") if "between" in sets else ()
    if runs:
        rows = rows.withColumns({"fine": _running("pos"), "coarse": _running("cpos")})
    at = lambda i, level: F.when(i < 1, START).otherwise(F.coalesce(F.get("w", i)[level], F.lit(END)))

    def one(h: Column, c: Column) -> Column:
        low, high = F.least(h["id"], c["id"]), F.greatest(h["id"], c["id"])
        inside = lambda runs: F.filter(F.transform(runs, lambda r: F.struct(r["tag"].alias("tag"), (F.get(r["n"], high) - F.get(r["n"], low + 1)).alias("n"))), lambda r: r["n"] > 0)
        around = [at(x["id"] + by, level).alias(f"{side}{level}{sign}") for side, x in (("h", h), ("c", c)) for level in dict.fromkeys(levels) for sign, by in (("-", -1), ("+", 1))]
        own = [x[n].alias(f"{side}{n}") for side, x in (("h", h), ("c", c)) for n in kinds]
        before = F.when(c["id"] > 1, F.get("w", c["id"] - 1)["tok"]).alias("before")
        return F.struct(h["id"].alias("gov"), c["id"].alias("id"), (c["gov"] == h["id"]).alias("gold"), *own, *around, before, *[inside(F.col(r)).alias(r) for r in runs])

    near = lambda h, c: (h["id"] == 0) | (F.abs(h["id"] - c["id"]) <= reach)
    heads = lambda c: F.filter(F.slice("w", 1, c["id"]) if forward else F.col("w"), lambda h: (h["id"] != c["id"]) & (near(h, c) if reach else F.lit(True)))
    # a word's pairs are unfolded after the words themselves, so that no row holds all pairs of a sentence
    rows = rows.select("*", F.explode(F.slice("w", 2, F.size("w"))).alias("__c"))
    found = rows.select("doc_id", "seq_id", F.inline(F.transform(heads(F.col("__c")), lambda h: one(h, F.col("__c")))))
    side = F.when(F.col("gov") < F.col("id"), -1).otherwise(1)
    far = F.abs(F.col("gov") - F.col("id"))
    far = F.when(far > 10, 11).when(far > 5, 6).otherwise(far) * side  # below 0 where the head stands before the word
    return found.withColumns({"far": far.cast("string"), "side": side.cast("string")})


def _around(level: str) -> list[tuple[str, ...]]:
    """Four tags around the words' facing and outer sides with each of them left out, and the four on the same sides."""
    c, h = f"c{level}", f"h{level}"
    found = []
    for quad in ((f"{c}-", c, h, f"{h}+"), (f"{c}+", c, h, f"{h}-")):
        found += [quad, *combinations(quad, 3)]
    return [*found, (f"{c}-", c, f"{h}-", h), (f"{c}+", c, f"{h}+", h)]


def _counted(runs: str, level: str, mark: str, tail: list[str]) -> Column:
    """Each tag between two words with the tags of the words, in the sentence's order, as often as it stands there."""
    before = F.col("gov") < F.col("id")
    left, right = (F.when(before, F.col(a)).otherwise(F.col(b)) for a, b in ((f"h{level}", f"c{level}"), (f"c{level}", f"h{level}")))
    name = lambda r: F.concat_ws("|", F.lit(f"between {level}{mark}"), left, r["tag"], right, *tail)
    return F.transform(runs, lambda r: F.struct(name(r).alias("n"), r["n"].cast("double").alias("v")))


def entries(sets: tuple[str, ...] = SETS) -> Column:
    """The features of rows of :func:`pairs`, an array of names n, each once, and values v: a name is its parts, how it is split (``~far``, ``~side``), and the parts' values."""

    def named(parts: tuple[str, ...], *more: str) -> list[Column]:
        """The template plain and split by each of ``more``."""
        values = [F.col(f"`{p}`") for p in parts]
        return [F.concat_ws("|", F.lit(",".join(parts) + (f"~{m}" if m else "")), *values, *([m] if m else [])) for m in ("", *more)]

    once = lambda *own: F.array(*[F.struct(n.alias("n"), F.lit(1.0).alias("v")) for n in own])
    none = F.array().cast("array<struct<n:string,v:double>>")
    names: list[Column] = []
    arrays: list[Column] = []
    several = lambda templates, *more: [n for t in templates for n in named(t, *more)]
    if "basic" in sets:
        names += [F.concat_ws("|", F.lit("tags"), "hpos", "cpos"), F.concat_ws("|", F.lit("words"), "htok", "ctok")]
    if "before" in sets:
        own = once(F.concat_ws("|", F.lit("tag before"), F.col("`cpos-`")), F.concat_ws("|", F.lit("word before"), "before"))
        arrays.append(F.when(F.col("before").isNotNull(), own).otherwise(none))
    if "unigram" in sets:
        names += several(_UNIGRAM, "far", "side")
    if "bigram" in sets:
        names += [F.concat(F.lit("both:"), n) for n in several(_BIGRAM, "far")]
    if "prefix" in sets:
        c, h = F.col("cpref") != F.col("ctok"), F.col("hpref") != F.col("htok")
        for templates, when in ((_PREFIX, c | h), (_PREFIX_C, c), (_PREFIX_H, h)):
            arrays.append(F.when(when, once(*several(templates, "far"))).otherwise(none))
    for name, level in (("surround", "pos"), ("coarse_surround", "cpos")):
        if name in sets:
            names += [F.concat(F.lit(f"{name}:"), n) for n in several(_around(level), "side")]
    found = [*([once(*names)] if names else []), *arrays]
    if "between" in sets:
        for runs, level in (("fine", "pos"), ("coarse", "cpos")):
            found += [_counted(runs, level, mark, tail) for mark, tail in (("", []), ("~far", ["far"]), ("~side", ["side"]))]
    return F.concat(*found)


def features(words: DataFrame, sets: tuple[str, ...] = SETS, *, reach: int | None = None, forward: bool = False) -> DataFrame:
    """doc_id, seq_id, gov, id, gold and feats of every pair of :func:`pairs`, for :func:`parse.fit` and :func:`parse.scored`."""
    unknown = set(sets) - set(SETS)
    if unknown or not sets:
        raise ValueError(f"no such feature sets: {sorted(unknown)}; there are {SETS}")
    return pairs(words, tuple(sets), reach=reach, forward=forward).select("doc_id", "seq_id", "gov", "id", "gold", F.map_from_entries(entries(tuple(sets))).alias("feats"))


_LEXICAL = ("basic", "unigram", "prefix", "bigram")


class _Counts:
    """How often codes below ``space`` came and the sum of their values, in an array of that length where it is short, else by the codes that came."""

    def __init__(self, space: int, dense: int):
        self.space, self.dense = space, space <= dense
        self.m, self.v = (np.zeros(space, np.int64), np.zeros(space, np.int64)) if self.dense else (None, None)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, codes: np.ndarray, m: np.ndarray | None = None, v: np.ndarray | None = None) -> None:
        """``m`` is how often each of the codes came, once if it is missing; ``v`` its value, ``m`` if it is missing."""
        if not len(codes):
            return
        total = lambda x, size, at: np.bincount(at, x, minlength=size).astype(np.int64) if x is not None else np.bincount(at, minlength=size)  # noqa: E731  exact below 2^53
        if self.dense:
            own = total(m, self.space, codes)
            self.m += own
            self.v += own if v is None else total(v, self.space, codes)
            return
        names, at = np.unique(codes, return_inverse=True)
        own = total(m, len(names), at)
        self.parts.append((names, own, own if v is None else total(v, len(names), at)))
        if sum(len(x) for x, _, _ in self.parts[1:]) > max(1 << 22, len(self.parts[0][0])):
            self._join()

    def _join(self) -> None:
        codes, m, v = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        names, at = np.unique(codes, return_inverse=True)
        self.parts = [(names, *(np.bincount(at, x, minlength=len(names)).astype(np.int64) for x in (m, v)))]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.dense:
            codes = np.flatnonzero(self.m)
            return codes, self.m[codes], self.v[codes]
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        self._join()
        return self.parts[0]


#: Classes of distances: 1 to 5, then 6 to 10 and more.
_FAR = np.array([1, 2, 3, 4, 5, 6, 11])
#: Words whose pairs are counted together in a task.
CHUNK_WORDS = 1 << 20


def _far_class(d):
    return np.where(d > 10, 6, np.where(d > 5, 5, d - 1))


def _pairs(room: np.ndarray, own: np.ndarray, reach: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """Each distance and those of the places ``own`` that have a word so far behind them in their sentence; ``room`` is the number of words behind a place."""
    d = 1
    while reach is None or d <= reach:
        own = own[room[own] >= d]
        if not len(own):
            return
        yield d, own
        d += 1


def _chunk_totals(columns: dict[str, np.ndarray], names: list[str], size: np.ndarray, sets: tuple[str, ...], reach: int | None) -> Iterator[tuple[str, list[np.ndarray], np.ndarray, np.ndarray]]:
    """A kind of features, its key columns (places in ``names``), how many pairs have each key and the sum of its values.

    ``columns`` are the places in ``names`` of tok, pos, cpos and pref of all words, ``size`` the lengths of their sentences.
    A pair of words is met once, and counts for either of them as the head.
    """
    n, place = int(size.sum()), {x: i for i, x in enumerate(names)}
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(n) - first  # ids less one
    room = np.repeat(size, size) - 1 - at
    every, last = np.arange(n), np.flatnonzero(room == 0)
    dense = max(1 << 16, 4 * n)
    const = lambda text, like: np.full(len(like), place[text])
    far = {sign: np.array([place[str(sign * f)] for f in _FAR]) for sign in (-1, 1)}

    def coded(*own: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """A code for each combination of values that occurs, and the values of the codes."""
        code = np.zeros(len(own[0]), np.int64)
        for x in own:
            code = np.unique(code * len(names) + x, return_inverse=True)[1]
        of = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        of[code] = np.arange(len(code))
        return code, [x[of] for x in own]

    def both(kind: str, left: list[np.ndarray], right: list[np.ndarray], f: np.ndarray | None, m: np.ndarray, v: np.ndarray, *more: np.ndarray):
        for sign, h, c in ((-1, left, right), (1, right, left)):
            yield kind, [*h, *c, *([far[sign][f]] if f is not None else []), const(str(sign), m), *more], m, v

    if set(sets) & set(_LEXICAL):
        kind, values = coded(*(columns[x] for x in ("tok", "pos", "pref")))
        k = len(values[0])
        found, roots = _Counts(7 * k * k, dense), _Counts(7 * k, dense)
        for d, own in _pairs(room, every, reach):
            found.add((int(_far_class(d)) * k + kind[own]) * k + kind[own + d])
        codes, m, v = found.found()
        f, left, right = codes // (k * k), codes // k % k, codes % k
        yield from both("lexical", [x[left] for x in values], [x[right] for x in values], f, m, v)
        roots.add(_far_class(at + 1) * k + kind)
        codes, m, v = roots.found()
        yield "lexical", [*[const(ROOT, m)] * 3, *[x[codes % k] for x in values], far[-1][codes // k], const("-1", m)], m, v
    if "before" in sets:
        own = np.flatnonzero(at > 0)
        kind, values = coded(columns["pos"][own - 1], columns["tok"][own - 1])
        heads = 1 + (at + room if reach is None else np.minimum(at, reach) + np.minimum(room, reach))
        found = _Counts(len(values[0]), dense)
        found.add(kind, heads[own])
        codes, m, v = found.found()
        yield "before", [x[codes] for x in values], m, v
    for name, level in (("surround", "pos"), ("coarse_surround", "cpos")):
        if name in sets:
            tag = columns[level]
            prev, then = np.append(place[START], tag)[:-1], np.append(tag, place[END])[1:]
            prev[at == 0], then[last] = place[START], place[END]
            kind, values = coded(prev, tag, then)
            k = len(values[0])
            found = _Counts(k * k, dense)
            for d, own in _pairs(room, every, reach):
                found.add(kind[own] * k + kind[own + d])
            codes, m, v = found.found()
            yield from both(name, [x[codes // k] for x in values], [x[codes % k] for x in values], None, m, v)
            roots = _Counts(len(names) * k, dense)
            roots.add(tag[first] * k + kind)
            codes, m, v = roots.found()
            yield name, [const(START, m), const(ROOT, m), codes // k, *[x[codes % k] for x in values], const("-1", m)], m, v
    for level in ("pos", "cpos") if "between" in sets else ():
        tag, values = coded(columns[level])
        k, sentence = len(values[0]), np.repeat(np.arange(len(size)), size)
        found, roots = _Counts(7 * k**3, dense), _Counts(7 * k * k, dense)
        for t in range(k):
            has = tag == t
            before = np.append(0, np.cumsum(has))  # how many stand before each place
            there = np.zeros(len(size), bool)
            there[sentence[has]] = True
            own = np.flatnonzero(there[sentence])
            inside = before[own] - before[first[own]]
            some = own[inside > 0]
            roots.add((_far_class(at[some] + 1) * k + tag[some]) * k + t, v=inside[inside > 0])
            for d, low in _pairs(room, own, reach):
                inside = before[low + d] - before[low + 1]
                some = low[inside > 0]
                found.add(((int(_far_class(d)) * k + tag[some]) * k + tag[some + d]) * k + t, v=inside[inside > 0])
        codes, m, v = found.found()
        yield from both(f"between {level}", [values[0][codes // (k * k) % k]], [values[0][codes // k % k]], codes // k**3, m, v, values[0][codes % k])
        codes, m, v = roots.found()
        yield f"between {level}", [const(ROOT, m), values[0][codes // k % k], far[-1][codes // (k * k)], const("-1", m), values[0][codes % k]], m, v


def _counted_keys(words: DataFrame, sets: tuple[str, ...], reach: int | None) -> DataFrame:
    """kind, k, m, v: the keys of :func:`_chunk_totals` as arrays of strings, once each."""
    levels = ("tok", "pos", "cpos", "pref")
    signs = [str(s * f) for f in (*_FAR.tolist(),) for s in (-1, 1)]

    def told(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.concatenate([b.column("tok").value_lengths().to_numpy(zero_copy_only=False) for b in parts]).astype(np.int64)
        own = [pa.chunked_array([b.column(c).flatten() for b in parts]).combine_chunks() for c in levels]
        every = pa.concat_arrays([*own, pa.array([ROOT, START, END, *signs], pa.string())]).dictionary_encode()
        names, codes = every.dictionary, every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(own[0])
        columns = {c: codes[i * n : (i + 1) * n] for i, c in enumerate(levels)}
        for kind, keys, m, v in _chunk_totals(columns, names.to_pylist(), size, sets, reach):
            for low in range(0, len(m), 1 << 16):
                part = np.stack([x[low : low + (1 << 16)] for x in keys], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(keys)), names.take(pa.array(part.ravel())))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part)), lists, *(pa.array(x[low : low + len(part)]) for x in (m, v))], names=["kind", "k", "m", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            parts.append(b)
            held += len(b.column("tok").flatten())
            if held >= CHUNK_WORDS:
                yield from told(parts)
                parts, held = [], 0
        if held:
            yield from told(parts)

    own = _sentences(words).select(F.slice("w", 2, F.size("w")).alias("w")).select(*[F.col(f"w.{c}").alias(c) for c in levels])
    found = own.mapInArrow(run, "kind string, k array<string>, m long, v long")
    return found.groupBy("kind", "k").agg(F.sum("m").alias("m"), F.sum("v").alias("v"))


def totals(words: DataFrame, sets: tuple[str, ...] = SETS, *, reach: int | None = None) -> DataFrame:
    """fname, n and total of the features of all pairs: how many pairs have one, and the sum of its values.

    Pairs are counted in a task by the values that features are made of, each kind of features by
    its own and all words of a chunk at a distance at once; only what is left is named.
    """
    sides = lambda *names: [f"{side}{n}" for side in "hc" for n in names]
    keys = {
        "lexical": [*sides("tok", "pos", "pref"), "far", "side"],
        "before": ["cpos-", "before"],
        "surround": [*sides("pos-", "pos", "pos+"), "side"],
        "coarse_surround": [*sides("cpos-", "cpos", "cpos+"), "side"],
    }
    own = {"lexical": tuple(s for s in _LEXICAL if s in sets)} | {s: (s,) for s in list(keys)[1:] if s in sets}
    counted = written(_counted_keys(words, tuple(sets), reach), "arc-keys")
    named = lambda kind, columns: counted.where(F.col("kind") == kind).select(*[F.get("k", F.lit(i)).alias(c) for i, c in enumerate(columns)], "m", "v")
    found = []
    for kind, parts in own.items():
        if parts:
            found.append(named(kind, keys[kind]).select(F.explode(F.transform(entries(parts), lambda e: e["n"])).alias("fname"), F.col("m").alias("n"), F.col("v").alias("total")))
    for level in ("pos", "cpos") if "between" in sets else ():
        rows = named(f"between {level}", [*sides(level), "far", "side", "tag"])
        rows = rows.withColumns({"gov": F.when(F.col("side") == "-1", 0).otherwise(1), "id": F.when(F.col("side") == "-1", 1).otherwise(0), "__run": F.array(F.struct("tag", F.lit(1).alias("n")))})
        names = F.concat(*[_counted("__run", level, mark, tail) for mark, tail in (("", []), ("~far", ["far"]), ("~side", ["side"]))])
        found.append(rows.select(F.explode(F.transform(names, lambda e: e["n"])).alias("fname"), F.col("m").alias("n"), F.col("v").alias("total")))
    return reduce(DataFrame.union, found).groupBy("fname").agg(F.sum("n").alias("n"), F.sum("total").cast("long").alias("total"))


def weighed(arcs: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, seq_id, gov, id and score of arcs (…, feats) under a table of weights (fname, w), for vocabularies that no driver holds.

    Features meet their weights in a join and are summed by arc; features without a weight, and arcs without features, score 0.
    """
    rows = arcs.select("doc_id", "seq_id", "gov", "id", F.explode_outer("feats").alias("fname", "v"))
    found = rows.join(weights.select("fname", "w"), "fname", "left")
    return found.groupBy("doc_id", "seq_id", "gov", "id").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).cast("double").alias("score"))


#: Bits of the filter of pairs of words: 16 a pair up to 64 MB in all.
MOST_BITS = 1 << 29
#: Words of a part of the sentences, about.
PART_WORDS = 1 << 19


def _bit(head: np.ndarray, child: np.ndarray, bits: int) -> np.ndarray:
    """The place of a pair of words in the filter, from their 64-bit hashes."""
    x = head.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ child.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def _seen_pairs(weights: DataFrame) -> np.ndarray:
    """A filter of the pairs (form: head and word with a bar between) that have a weight; words with a bar in them are not in it."""
    spark = weights.sparkSession
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * weights.count()).bit_length()))
    part = min(bits, 1 << 23)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_bit(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("h", "c")), bits))
            bounds = np.searchsorted(at // part, np.arange(bits // part + 1))
            for k in np.flatnonzero(np.diff(bounds)).tolist():
                own = (at[bounds[k] : bounds[k + 1]] % part).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["slice", "x"])

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("slice").to_pylist(), b.column("x"), strict=True):
                found.setdefault(k, np.zeros(part, bool))[np.frombuffer(x.as_buffer(), np.uint32)] = True
        for k, x in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary())], names=["slice", "x"])

    plain = weights.where(F.char_length("form") - F.char_length(F.replace("form", F.lit("|"), F.lit(""))) == 1)
    ends = [F.xxhash64(F.substring_index("form", "|", k)).alias(n) for k, n in ((1, "h"), (-1, "c"))]
    found = plain.select(*ends).mapInArrow(places, "slice int, x binary").repartition(min(bits // part, spark.sparkContext.defaultParallelism), "slice")
    whole = np.zeros(bits // 8, np.uint8)
    for k, x in found.mapInArrow(filled, "slice int, x binary").collect():
        whole[k * part // 8 : (k + 1) * part // 8] = np.frombuffer(bytes(x), np.uint8)
    return whole


def _rivals(rows: pa.RecordBatch | pa.Table, tags: dict[str, int], most: int, root: int, seen: np.ndarray) -> tuple:
    """What may govern the words of sentences (tok, tag, hash: lists), from heads before them.

    Lengths, the tags' weights of the root, (distance, words, tags' weights) of other heads, and by the same
    order (the root first, distance 0) the words whose pair may have a weight of its own and the pair as places in the names given last.
    A head is left out if even the largest weight of a pair does not lift it to the best by tags alone.
    """
    lists = {c: rows.column(c).combine_chunks() if isinstance(rows, pa.Table) else rows.column(c) for c in ("tok", "tag", "hash")}
    size = lists["tok"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = pa.concat_arrays([pa.array([ROOT], lists["tok"].type.value_type), lists["tok"].flatten()]).dictionary_encode()
    tok = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)[1:]
    own = lists["tag"].flatten().dictionary_encode()
    tag, kinds = own.indices.to_numpy(zero_copy_only=False).astype(np.int64), own.dictionary.to_pylist()
    table = np.array([[tags.get(f"{h}|{c}", 0) for c in kinds] for h in (ROOT, *kinds)], np.int64).reshape(len(kinds) + 1, -1)
    hashes = np.full(len(words.dictionary), root, np.int64)
    hashes[tok] = lists["hash"].flatten().to_numpy(zero_copy_only=False)
    hashes[0] = root
    barred = pc.match_substring(words.dictionary, "|").to_numpy(zero_copy_only=False)
    n = len(tok)
    room = np.repeat(size, size) - 1 - (np.arange(n) - np.repeat(np.cumsum(size) - size, size))
    first = table[0][tag]
    best = first.copy()
    for d, low in _pairs(room, np.arange(n), None):
        best[low + d] = np.maximum(best[low + d], table[1 + tag[low], tag[low + d]])
    kept = [(0, np.flatnonzero(first + most >= best), first[first + most >= best])]
    for d, low in _pairs(room, np.arange(n), None):
        value = table[1 + tag[low], tag[low + d]]
        may = value + most >= best[low + d]
        kept.append((d, low[may] + d, value[may]))
    count = np.zeros(n, np.int64)
    for _, own, _ in kept:
        count[own] += 1
    asked = []
    for d, own, _ in kept:
        head = tok[own - d] if d else np.zeros(len(own), np.int64)
        at = _bit(hashes[head], hashes[tok[own]], 8 * len(seen))
        may = (count[own] > 1) & ((seen[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) | barred[head] | barred[tok[own]])
        asked.append((np.flatnonzero(may), head[may] * len(hashes) + tok[own[may]]))
    return size, kept, asked, words.dictionary


def _forms(pairs: np.ndarray, names: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(names.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names))), "|")


def forward_heads(sentences: DataFrame, tag: Callable[[Column], Column]) -> DataFrame:
    """doc_id, seq_id, toks and gov, an array: the best heads of the words of sentences (doc_id, seq_id, toks) among those before them.

    A pair of tags (few, as their pairs go to the driver) or words weighs as often as it stands side by side; the
    first of equal heads wins. Heads that stand before their words make a tree however they are chosen, so each word's best is the best tree's.
    Only pairs of words that decide something and pass a filter of those with a weight (of 64 MB at most) meet their
    weights, once a part of the sentences, and go back to that part.
    """
    spark = sentences.sparkSession
    own = written(sentences.select("doc_id", "seq_id", F.transform("toks", lambda t: F.coalesce(t, F.lit(""))).alias("tok")), "sentences")
    parts = max(spark.sparkContext.defaultParallelism, (own.agg(F.sum(F.size("tok"))).first()[0] or 0) // PART_WORDS)
    own = own.withColumn("part", F.pmod(F.xxhash64("doc_id", "seq_id"), F.lit(parts)).cast("int"))
    beside = lambda x: F.zip_with(F.concat(F.array(F.lit(ROOT)), F.slice(x, 1, F.size(x) - 1)), x, lambda h, c: F.concat_ws("|", h, c))
    tags_of = F.transform("tok", lambda t: tag(t).cast("string"))
    weights = written(own.select(F.explode(beside(F.col("tok"))).alias("form")).groupBy("form").agg(F.count("*").alias("w")), "pair-weights")
    tags = {r["form"]: r["w"] for r in own.select(tags_of.alias("t")).select(F.explode(beside(F.col("t"))).alias("form")).groupBy("form").agg(F.count("*").alias("w")).collect()}
    most, root = weights.agg(F.coalesce(F.max("w"), F.lit(0)), F.xxhash64(F.lit(ROOT))).first()
    shared = spark.sparkContext.broadcast((tags, most, root, _seen_pairs(weights)))
    made = ["tok", tags_of.alias("tag"), F.transform("tok", lambda t: F.xxhash64(t)).alias("hash")]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            part = rows.column("part").to_numpy()
            order = np.argsort(part, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                _, _, pairs, names = _rivals(rows.take(pa.array(own)), *shared.value)
                forms = _forms(np.unique(np.concatenate([p for _, p in pairs])), names)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(forms), part[own[0]], np.int32)), forms], names=["part", "form"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(len(x.column("tok").flatten()) for x in held) >= CHUNK_WORDS:
                yield from asked(held)
                held = []
        if held:
            yield from asked(held)

    def solve(rows: pa.Table, answers: pa.Table) -> pa.Table:
        size, kept, asked, names = _rivals(rows, *shared.value)
        pairs, at = np.unique(np.concatenate([p for _, p in asked]), return_inverse=True)
        place = pc.index_in(_forms(pairs, names), value_set=answers.column("form").combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
        w = np.append(answers.column("w").to_numpy(), 0)[place][at]
        n = int(size.sum())
        best, gov, ends = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.cumsum([0, *(len(p) for _, p in asked)])
        place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        for k in (0, *range(len(kept) - 1, 0, -1)):  # from the root on
            (d, own, value), (which, _) = kept[k], asked[k]
            value = value.copy()
            value[which] += w[ends[k] : ends[k + 1]]
            won = value > best[own]
            best[own[won]] = value[won]
            gov[own[won]] = place[own[won]] + 1 - d if d else 0
        found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(gov.astype(np.int32)))
        return pa.table({"doc_id": rows.column("doc_id"), "seq_id": rows.column("seq_id"), "toks": rows.column("tok"), "gov": found})

    answers = own.select("part", *made).mapInArrow(ask, "part int, form string").join(weights, "form").select("part", "form", "w")
    types = [own.schema[c].dataType.simpleString() for c in ("doc_id", "seq_id")]
    # tags and hashes are made again behind the shuffle
    told = own.repartition(parts, "part").select("part", "doc_id", "seq_id", *made)
    return told.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(solve, f"doc_id {types[0]}, seq_id {types[1]}, toks array<string>, gov array<int>")


def label_features(words: DataFrame, more: Column | None = None) -> DataFrame:
    """doc_id, seq_id, pos (from 0), label and feats of words with heads: what a model of arcs' labels learns from, as :func:`crf.sequences` takes it.

    Features: the word, its tag, its head's tag, and the word with its head's word; the last only where
    the head is a word. ``more`` adds an array of feature names made from the column ``x``, the word.
    """
    w = F.col("w")
    head = lambda x: F.get(w, F.when(x["gov"].between(0, F.size(w) - 1), x["gov"]))
    rows = _sentences(words).select("doc_id", "seq_id", F.explode(F.transform(F.slice("w", 2, F.size("w")), lambda x: F.struct(x.alias("x"), head(x).alias("h")))).alias("e"))
    rows = rows.select("doc_id", "seq_id", "e.x", "e.h")
    none = F.array().cast("array<string>")
    names = F.concat(
        F.array(F.concat_ws("|", F.lit("word"), "x.tok"), F.concat_ws("|", F.lit("tag"), "x.pos")),
        F.when(F.col("h").isNotNull(), F.array(F.concat_ws("|", F.lit("head tag"), "h.pos"))).otherwise(none),
        F.when(F.col("h.id") > 0, F.array(F.concat_ws("|", F.lit("word and head"), "x.tok", "h.tok"))).otherwise(none),
        F.coalesce(more, none) if more is not None else none,
    )
    feats = F.map_from_entries(F.transform(F.array_distinct(names), lambda n: F.struct(n, F.lit(1.0))))
    return rows.select("doc_id", "seq_id", (F.col("x.id") - 1).alias("pos"), F.col("x.label").alias("label"), feats.alias("feats"))
