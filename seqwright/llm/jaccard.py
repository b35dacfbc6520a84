"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is the set of its word shingles; documents link when their sets'
Jaccard similarity reaches a threshold. Shingles are ordered by hash. If a linked
set misses at most n - a of a set's n shingles (a: the least overlap), the first
n - a + l of both share l or more, so a document of which fewer than l of them
occur elsewhere has no link. Among those, the rarest come first: each document
then takes the prefix that asks for j shared tokens and is j - 1 tokens longer,
with the j of the least estimated cost. Only pairs that share as many prefix
tokens as the smaller j of the two are verified, on the whole sets.

No pairs are emitted. Documents that share a prefix token meet in the group of
that token's leader (the first that has it); a group is worked on by an inverted
index, skips pairs that are connected already, and gives a spanning forest of
its links. In a large group all members are first compared with its head. Those
linked with it are connected and need not meet again; by the triangle inequality
of the Jaccard distance only members within twice the linking distance of the
head can link with them, and only these meet them, block by block. The unlinked
go on among themselves in the next round, under a new head. Where a head links
with less than half of its group, blocks of the unlinked meet in pairs instead.

Equal sets are one class. Texts without words, empty and null texts are empty
sets and link with nothing; a text of fewer words is one shingle. Rows without
an id take no part and have a null component_id. Repeated rows each stay; an id
that is given to several texts is in each text's own component. Empty tables
give empty results; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm import kernels
from seqwright.llm.common import chosen, table
from seqwright.scratch import collected, discard, remove, written

#: Prefix tokens are the leading bits of the hashes, and equal ones of a document are numbered above these bits, so that
#: two documents share as many tokens as shingles, or more: a collision can only add a candidate.
CODE_BITS = 40
#: Least shared tokens that the first prefix asks for, in thousandths of the shingles that may differ, and at least.
MATCH_SHARE, MATCH_BASE = 300, 8
#: Further shared tokens that the second prefix may ask for, and what verifying a candidate costs in postings read.
STEPS = (1, 2, 3, 4, 6, 8)
VERIFY_COST = 16
#: Documents and shingles in a block of a group.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000


def least_overlap(n, percent: int):
    """ceil(percent / 100 * n): shingles that two linked sets share at least, if one has n."""
    return (n * percent + 99) // 100


def first_matches(n, percent: int):
    """l: tokens that the first prefixes of two sets of n or more shingles share at least, if they link."""
    return np.minimum(least_overlap(n, percent), n * (100 - percent) * MATCH_SHARE // 100_000 + MATCH_BASE)


def text_sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, distinct hashes in order, offsets of each row's), a chunk at a time."""
    for low, high, data, offsets in kernels.chunks(column):
        hashes, at = kernels.shingles(data, offsets, words, lower=True)
        owner = np.repeat(np.arange(high - low), np.diff(at))
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[new], owner[new]
        yield low, high - low, hashes, np.searchsorted(owner, np.arange(high - low + 1))


def set_keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set, which together stand for the set."""
    found = []
    for extra in (0, 0x5851F42D4C957F2D):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(kernels.mix(hashes ^ np.uint64(extra)), out=total[1:])
        found.append((total[at[1:]] - total[at[:-1]]).astype(np.int64))
    return found[0], found[1]


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n (size of the set), k1 and k2 (the set's key), prefix (the first prefix's tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, count, hashes, at in text_sets(batch.column("text"), words):
                n = np.diff(at)
                k1, k2 = set_keys(hashes, at)
                size = n - least_overlap(n, percent) + first_matches(n, percent)
                after = np.cumsum(size)
                own = np.repeat(at[:-1] - (after - size), size) + np.arange(int(after[-1]))
                codes = (hashes[own] >> np.uint64(64 - CODE_BITS)).astype(np.int64)
                first = np.append(0, after[:-1])[size > 0]
                again = np.zeros(len(codes), bool)
                again[1:] = codes[1:] == codes[:-1]
                again[first] = False
                at_code = np.arange(len(codes))
                codes += (at_code - np.maximum.accumulate(np.where(again, 0, at_code))) << CODE_BITS
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, after).astype(np.int32)), pa.array(codes))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, count), pa.array(n), pa.array(k1), pa.array(k2), lists], names=["doc_id", "n", "k1", "k2", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, prefix array<long>")


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """The classes (rep, doc_id, n, k1, k2, prefix) that may have links: j and their second prefix's tokens."""
    tokens = classes.select("rep", F.explode("prefix").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df >= 2")
    shared = tokens.join(counts, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
    partner = F.floor((F.col("n") * percent + 99) / 100).cast("long")  # the least size of a linked set
    own = F.floor(partner * (100 - percent) * MATCH_SHARE / 100_000).cast("long") + MATCH_BASE
    least = F.least(F.floor((partner * percent + 99) / 100).cast("long"), own)
    rows = classes.select("rep", "doc_id", "n", "k1", "k2").join(shared, "rep").withColumn("spare", F.size("shared") - least).where("spare >= 0")

    def option(j: int) -> Column:
        length = F.col("spare") + j
        read = F.aggregate(F.slice("shared", F.lit(1), length.cast("int")), F.lit(0).cast("double"), lambda a, x: a + x["df"])
        return F.when(length <= F.size("shared"), F.struct((read * (1 + VERIFY_COST / j**2)).alias("cost"), F.lit(j).alias("j"), length.cast("int").alias("length")))

    best = F.array_min(F.filter(F.array(*map(option, STEPS)), lambda x: x.isNotNull()))
    rows = rows.withColumn("best", best)
    return rows.select("rep", "doc_id", "n", "k1", "k2", F.col("best.j").alias("j"), F.transform(F.slice("shared", F.lit(1), F.col("best.length")), lambda x: x["token"]).alias("tokens"))


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of several runs, one after the other."""
    after = np.cumsum(sizes)
    return np.repeat(starts - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)


class Postings:
    """An inverted index over the sets of a group; values that one set alone has are left out."""

    def __init__(self, sets: list[np.ndarray]):
        self.m = len(sets)
        owner = np.repeat(np.arange(self.m), [len(s) for s in sets])
        _, value, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        kept = counts[value] > 1
        self.value, own = value[kept], owner[kept]
        self.at = np.searchsorted(own, np.arange(self.m + 1))
        self.rows = own[np.argsort(self.value, kind="stable")]
        self.counts = np.where(counts > 1, counts, 0)
        self.starts = np.cumsum(self.counts) - self.counts

    def overlaps(self, x: int) -> np.ndarray:
        """How many values row x shares with each row."""
        v = self.value[self.at[x] : self.at[x + 1]]
        return np.bincount(self.rows[gather(self.starts[v], self.counts[v])], minlength=self.m)


def group_links(ids: np.ndarray, n: np.ndarray, j: np.ndarray, tokens: list[np.ndarray], sets: list[np.ndarray], percent: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of a group: rows' ids and the first id that each reaches; those ``known`` to be connected are so from the start."""
    prefixes, whole = Postings(tokens), Postings(sets)
    label = np.arange(len(ids))
    if known.any():
        label[known] = np.flatnonzero(known)[0]
    for x in range(len(ids) - 1):
        may = (label != label[x]) & (prefixes.overlaps(x) >= np.minimum(j[x], j)) & (100 * np.minimum(n[x], n) >= percent * np.maximum(n[x], n))
        may[:x] = False
        if may.any():
            shared = whole.overlaps(x)
            joined = np.unique(label[may & (100 * shared >= percent * (n[x] + n - shared))])
            if len(joined):
                joined = np.append(joined, label[x])
                label[np.isin(label, joined)] = joined.min()
    told = ~known
    told[np.flatnonzero(known)[:1]] = True
    told &= label != np.arange(len(ids))
    return ids[told], ids[label[told]]


def full_sets(docs: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """rep, n, j, tokens and shingles (sorted hashes) of the classes in ``rows``, read from the text of each class's document."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, count, hashes, at in text_sets(batch.column("text"), words):
                part = batch.slice(low, count)
                k1, k2 = set_keys(hashes, at)
                same = (k1 == part.column("k1").to_numpy()) & (k2 == part.column("k2").to_numpy())  # a repeated id may have another text
                raw = hashes.tobytes()
                packed = pa.array([raw[8 * i : 8 * k] for i, k in zip(at.tolist(), at[1:].tolist(), strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rep", "n", "j", "tokens")), packed], names=["rep", "n", "j", "tokens", "shingles"]).filter(pa.array(same))

    texts = docs.join(rows, "doc_id").select("rep", "n", "k1", "k2", "j", "tokens", "text")
    return texts.mapInArrow(full, "rep long, n long, j int, tokens array<long>, shingles binary")


def compared(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (group, rep, n, head, blocks) with ``linked`` (to the head) and ``near`` (may link with one that is)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("shingles"), batch.column("ahead"), strict=True)
            shared = np.fromiter((len(np.intersect1d(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64), assume_unique=True)) for a, b in pairs), np.int64, len(batch))
            union = batch.column("n").to_numpy() + np.array([len(b.as_py()) // 8 for b in batch.column("ahead")], np.int64) - shared
            linked, near = 100 * shared >= percent * union, 100 * shared >= (2 * percent - 100) * union
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "rep", "n", "head", "blocks")), pa.array(linked), pa.array(near)], names=["group", "rep", "n", "head", "blocks", "linked", "near"])

    dealt = members.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int")).join(sets.select("rep", "shingles").distinct(), "rep")
    heads = members.select("group", "head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).distinct()
    heads = heads.join(sets.select(F.col("rep").alias("head"), F.col("shingles").alias("ahead")).distinct(), "head").drop("head")
    return dealt.join(heads, ["group", "block"]).select("group", "rep", "n", "head", "blocks", "shingles", "ahead").mapInArrow(compare, "group long, rep long, n long, head long, blocks int, linked boolean, near boolean")


def links(docs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links between classes, enough to connect what is connected; ``rows`` are those of :func:`candidates`."""
    postings = rows.select("rep", "n", F.explode("tokens").alias("token"))
    leaders = postings.groupBy("token").agg(F.min("rep").alias("group"), F.count("*").alias("holders")).where("holders >= 2")
    members = written(postings.join(leaders, "token").select("group", "rep", "n").distinct(), "jaccard-members")
    sets, edges, placed, number = full_sets(docs, rows, words), [], [], 0
    one, no = F.lit(0), F.lit(False)

    def place(members: DataFrame, first: Column, second: Column, known: Column = no) -> None:
        placed.append(members.select(F.lit(len(placed) if known is no else len(placed) - 1).alias("part"), "group", "rep", first.cast("int").alias("first"), second.cast("int").alias("second"), known.alias("known")))

    def blocks(count: Column) -> Column:
        return F.ceil(F.col("blocks") * count / F.col("members")).cast("int")

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("rep"), of)

    while True:
        cut = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int")
        sizes = written(members.groupBy("group").agg(F.min("rep").alias("head"), F.count("*").alias("members"), cut.alias("blocks")).where("members > 1"), "jaccard-groups")
        place(members.join(sizes.where("blocks = 1"), "group", "left_semi"), one, one)
        large = sizes.where("blocks > 1")
        if large.isEmpty():
            break
        if not number:
            sets = written(sets, "jaccard-shingles")
        number += 1
        met = written(compared(members.join(large.drop("members"), "group"), sets, percent), "jaccard-compared")
        edges.append(met.where("linked AND rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b")))
        count = lambda what: F.sum(F.expr(f"CASE WHEN {what} THEN 1 ELSE 0 END"))
        tally = met.groupBy("group").agg(F.count("*").alias("members"), count("linked").alias("core"), count("near AND NOT linked").alias("ring"), count("NOT linked").alias("rest"))
        met = met.join(tally, "group").withColumns({"core": blocks(F.col("core")), "ring": blocks(F.col("ring")), "slow": F.col("rest") * 2 > F.col("members"), "rest": blocks(F.col("rest"))})
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1)).alias("other")
        place(met.where("near AND NOT linked").select("*", every("core")), block("ring"), F.col("other"))
        place(met.where("linked AND ring > 0").select("*", every("ring")), F.col("other"), block("core"), F.lit(True))
        place(met.where("slow AND NOT linked").select("*", every("rest")), F.least(block("rest"), "other"), F.greatest(block("rest"), "other"))
        members = written(met.where("NOT slow AND NOT linked").select("group", "rep", "n"), "jaccard-members")
    key = ["part", "group", "first", "second"]
    # All of a group's rows stand together in a partition; a partition holds many groups.
    together = functools.reduce(DataFrame.unionByName, placed)
    grouped = together.join(sets, "rep").repartition(*key).sortWithinPartitions(*key, "rep").select(*key, "known", "rep", "n", "j", "tokens", "shingles")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, key):
            ids, first = np.unique(group.column("rep").to_numpy(), return_index=True)
            group = group.take(pa.array(first))
            tokens = [x.values.to_numpy() for x in group.column("tokens")]
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("shingles")]
            known = group.column("known").to_numpy(zero_copy_only=False)
            a, b = group_links(ids, group.column("n").to_numpy(), group.column("j").to_numpy(), tokens, sets, percent, known)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return functools.reduce(DataFrame.unionByName, edges, grouped.mapInArrow(work, "a long, b long"))


def runs(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of each run of rows with an equal key, across batches."""
    held: list[pa.RecordBatch] = []
    name: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        values = [batch.column(c).to_numpy() for c in key]
        new = np.zeros(len(batch), bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for i, k in zip(cuts, cuts[1:], strict=False):
            own = tuple(v[i].item() for v in values)
            if own != name and held:
                yield name, pa.concat_batches(held)
                held = []
            name = own
            held.append(batch.slice(i, k - i))
    if held:
        yield name, pa.concat_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that each node of the edges (a, b) reaches.

    Every round, nodes point to the least of their neighbours and of what those
    point to; edges become (node, pointed) until none changes.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "components")
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        # Large star: the greater neighbours of a node join its least; small star: the lesser ones do.
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lows, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = written(small, "components")
        changed = new.exceptAll(now).limit(1).count() or now.exceptAll(new).limit(1).count()
        discard(now)
        now = new
        if not changed:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of each row."""
    own = chosen(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = written(shingle_sets(own, words, percent), "jaccard-sets")
    known = sets.where("doc_id IS NOT NULL AND n > 0")
    classes = known.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min_by("prefix", "doc_id").alias("prefix"))
    classes = written(classes.withColumn("rep", F.monotonically_increasing_id()), "jaccard-classes")
    rows = written(candidates(classes, percent), "jaccard-candidates")
    found = components(links(own, rows, words, percent))
    found = found.union(found.select("component", "component").distinct())
    linked = classes.select("n", "k1", "k2", "rep", "doc_id").join(found, F.col("rep") == F.col("node"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = linked.join(least, "component").select("n", "k1", "k2", "least")
    mapped = classes.join(linked, ["n", "k1", "k2"], "left").select("n", "k1", "k2", F.coalesce("least", "doc_id").alias("least"))
    mapped = written(mapped, "jaccard-components")  # a table, so that the join can split the rows of a text with many copies
    result = sets.select("doc_id", "n", "k1", "k2").join(mapped, ["n", "k1", "k2"], "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) whose id is the smallest of their component; ids without a link stay.

    Columns are unchanged. Rows without an id stay.
    """
    with collected() as made:
        found = near_duplicates(docs, **parameters)
    gone = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct(), "jaccard-gone")
    remove(docs.sparkSession, made)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)
