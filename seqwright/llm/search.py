"""Ranked lexical search by Block-Max WAND over an index in tables.

The index is cut into shards of consecutive documents of a bounded number of
bytes (one document at least). A shard's row of a term holds its postings in
blocks of BLOCK postings: document gaps and term frequencies in the least whole
number of bytes that fits the block, and beside them, uncompressed, each block's
last document and its largest impact. A shard is made where its documents are
read, by array operations over whole batches; nothing is shuffled.

An item is searched shard by shard. The borders of all its terms' blocks cut the
shard into windows. Pivoting by the largest impact of each list skips the windows
in which no document can reach the threshold; then shallow moves, in the block
directories alone, give each term's current block, and windows whose largest
block impacts together stay below the threshold are skipped before any posting
is decompressed. Windows that remain are scored in runs, in document order, and
the threshold rises with the best documents found. A sixteenth of the shards is
searched first; what its documents reach is the threshold that the others begin
with, so few rows a shard are left to rank.

Terms, weights and scores are exact integers. Null texts have no terms. Equal
scores rank by ascending id, null ids last; documents of one id are ranked each
by itself, in either order. Items without a term, or none that a document holds,
have no rows; rows of one item id are one item. Empty tables give empty results.
A document longer than a shard's bytes is a shard of its own. Further columns
play no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from seqwright.llm.common import chosen, table
from seqwright.scratch import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Postings of a block, and bytes of text of a shard.
BLOCK = 128
SHARD_BYTES = 8 << 20
#: One shard in so many is searched before the others.
FIRST_SHARDS = 16
#: Items searched together in one task's shard.
ITEMS = 256
#: Most windows scored before the threshold is looked at again; the first runs are shorter.
RUN = 64

_IN_TERM = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def terms_of(text: Column) -> Column:
    """The terms of a text, A to Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), F.lit(TERM), 0)


@dataclass(frozen=True)
class Totals:
    """Documents with a term, and terms of all documents."""

    documents: int
    terms: int


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte behind, document) of each term in the bytes of consecutive documents."""
    inside = _IN_TERM[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True  # a term ends with its document
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | fresh[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | fresh[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def totals(texts: DataFrame) -> Totals:
    """Count documents with a term, and terms, a task at a time."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column(0))
            _, _, docs = spans(data, offsets)
            yield pa.RecordBatch.from_pydict({"documents": [len(np.unique(docs))], "terms": [len(docs)]})

    own = texts.select("text").where("text <> ''").mapInArrow(of, "documents long, terms long")
    row = own.agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).first()
    return Totals(row.documents or 0, row.terms or 0)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of an array of texts; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def length_factor(n: np.ndarray, found: Totals) -> np.ndarray:
    """The whole number m of documents of n terms."""
    return 100 - 50 + (50 * n * found.documents) // max(found.terms, 1)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))


def pack(values: np.ndarray, widths: np.ndarray, at: np.ndarray, out: np.ndarray) -> None:
    """Write each value in its width of bytes, low byte first, at its place."""
    for byte in range(4):
        own = np.flatnonzero(widths > byte)
        out[at[own] + byte] = (values[own] >> (8 * byte)) & 255


def shard_of(ids: list, data: np.ndarray, offsets: np.ndarray, found: Totals) -> pa.RecordBatch | None:
    """The rows of one shard: a row of its documents, and a row a term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    starts, ends, docs = spans(data, offsets)
    if not len(starts):
        return None
    docs = rank[docs]
    m = length_factor(np.bincount(docs, minlength=len(ids)).astype(np.int64), found)
    lengths = ends - starts
    edges = np.concatenate([[0], np.cumsum(lengths)])
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    np.subtract.at(keep, ends, 1)
    joined = _LOWER[data[np.cumsum(keep[:-1]) > 0]]
    named = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(joined)]).dictionary_encode()
    codes = named.indices.to_numpy().astype(np.int64)
    # terms in order of their bytes, so that a file's row groups hold ranges of terms
    sorted_terms = pa.compute.sort_indices(named.dictionary).to_numpy()
    place = np.empty(len(sorted_terms), np.int64)
    place[sorted_terms] = np.arange(len(sorted_terms))
    keys, tf = np.unique(place[codes] * len(ids) + docs, return_counts=True)
    term, doc = np.divmod(keys, len(ids))
    tf = tf.astype(np.int64)
    df = np.bincount(term, minlength=len(sorted_terms))
    first = np.concatenate([[0], np.cumsum(df)])
    within = np.arange(len(term)) - first[term]
    opens = np.flatnonzero(within % BLOCK == 0)
    block = np.cumsum(within % BLOCK == 0) - 1
    last = np.concatenate([opens[1:], [len(term)]]) - 1
    gap = doc - np.where(within % BLOCK == 0, 0, np.concatenate([[0], doc[:-1]]))
    gap[opens] = doc[opens] - np.where(within[opens] == 0, 0, doc[opens - 1])
    wide_gap, wide_tf = _width(np.maximum.reduceat(gap, opens)), _width(np.maximum.reduceat(tf, opens))
    size = last - opens + 1
    at = np.concatenate([[0], np.cumsum(size * (wide_gap + wide_tf))])
    out = np.zeros(at[-1], np.uint8)
    inner = within % BLOCK
    pack(gap, wide_gap[block], at[block] + inner * wide_gap[block], out)
    pack(tf, wide_tf[block], at[block] + size[block] * wide_gap[block] + inner * wide_tf[block], out)
    top = np.maximum.reduceat(impact(tf, m[doc]), opens)
    blocks = np.concatenate([[0], np.cumsum(-(-df // BLOCK))])  # the first block of each term

    def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(blocks, pa.int32()), pa.array(values, kind))

    n = len(sorted_terms)
    rows = pa.RecordBatch.from_arrays(
        [
            named.dictionary.take(pa.array(sorted_terms)).cast(pa.binary()),
            pa.array(df, pa.int32()),
            lists(doc[last], pa.int32()),
            lists(top, pa.int32()),
            lists(wide_gap * 8 + wide_tf, pa.int8()),
            pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at[blocks].astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary()),
            pa.nulls(n, pa.list_(pa.int64())),
            pa.nulls(n, pa.list_(pa.int64())),
        ],
        schema=_SHARD,
    )
    own = pa.RecordBatch.from_pylist([{"term": b"", "df": len(ids), "ids": [ids[i] for i in order if ids[i] is not None], "factors": m.tolist()}], _SHARD)
    return pa.concat_batches([own, rows])


_SHARD = pa.schema(
    [("term", pa.binary()), ("df", pa.int32()), ("last", pa.list_(pa.int32())), ("top", pa.list_(pa.int32())), ("widths", pa.list_(pa.int8())), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("factors", pa.list_(pa.int64()))]
)
_SHARD_DDL = "shard long, term binary, df int, last array<int>, top array<int>, widths array<byte>, data binary, ids array<long>, factors array<long>"


@dataclass(frozen=True)
class Index:
    """The table of shards and the corpus totals that its impacts rest on."""

    rows: DataFrame
    found: Totals


def build(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index all documents, in a table in the shared folder; ids are whole numbers.

    A shard's number is that of the task that made it and a count within it.
    """
    texts = chosen(docs, doc_id=doc_id, text=text)
    found = totals(texts)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, waiting, held = TaskContext.get().partitionId() << 32, [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            nonlocal number, waiting, held
            texts = pa.concat_arrays([c for _, c in waiting])
            data, offsets = bytes_of(texts)
            rows = shard_of([i for ids, _ in waiting for i in ids], data, offsets, found)
            if rows is not None:
                for low in range(0, rows.num_rows, 50_000):
                    part = rows.slice(low, 50_000)
                    yield part.add_column(0, pa.field("shard", pa.int64()), pa.array(np.full(part.num_rows, number), pa.int64()))
            number, waiting, held = number + 1, [], 0

        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1).cast(pa.large_string())
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))
            low = 0
            while low < len(ids):
                # as many documents as fit, one at least
                base = sizes[low - 1] if low else 0
                high = max(int(np.searchsorted(sizes, base + shard_bytes - held, "right")), low + (not waiting))
                if high > low:
                    waiting.append((ids[low:high], column.slice(low, high - low)))
                    held += int(sizes[high - 1] - base)
                if high < len(ids):
                    yield from shard()
                low = high
        if waiting:
            yield from shard()

    rows = texts.where("text <> ''").select(F.col("doc_id").cast("long"), "text").mapInArrow(of, _SHARD_DDL)
    return Index(written(rows, "postings"), found)


def weights(index: Index, items: DataFrame, *, item_id: str, text: str) -> DataFrame:
    """item_id, batch, term, weight of each item's terms that a document holds; batches hold about ITEMS items."""
    own = chosen(items, item_id=item_id, text=text)
    n = own.count()
    terms = own.select("item_id", F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term")).distinct()
    terms = terms.select("item_id", F.encode("term", "utf-8").alias("term"), F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-n // ITEMS)))).alias("batch"))
    wanted = terms.select("term").distinct()
    df = index.rows.select("term", "df").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * index.found.documents + 2).cast("double") / (2 * F.col("df") + 1)))
    return terms.join(df, "term").select("item_id", "batch", "term", weight.cast("long").alias("weight"))


class Postings:
    """A term's row of a shard: its block directory, and blocks decompressed when they are asked for."""

    def __init__(self, df: int, last: np.ndarray, top: np.ndarray, widths: np.ndarray, data: bytes):
        self.last, self.top = np.asarray(last, np.int64), np.asarray(top, np.int64)
        self.first = np.concatenate([[0], self.last[:-1] + 1])  # no posting of a block stands before this
        self.gap_bytes, self.tf_bytes = np.asarray(widths, np.int64) >> 3, np.asarray(widths, np.int64) & 7
        self.size = np.full(len(self.last), BLOCK)
        self.size[-1] = df - BLOCK * (len(self.last) - 1)
        self.at = np.concatenate([[0], np.cumsum(self.size * (self.gap_bytes + self.tf_bytes))])
        self.data, self.known, self.best = data, {}, int(self.top.max())

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, frequencies) of a block."""
        if k not in self.known:
            n, at, kinds = int(self.size[k]), int(self.at[k]), {1: np.uint8, 2: np.uint16, 4: np.uint32}
            gaps = np.frombuffer(self.data, kinds[int(self.gap_bytes[k])], n, at).astype(np.int64)
            tf = np.frombuffer(self.data, kinds[int(self.tf_bytes[k])], n, at + n * int(self.gap_bytes[k])).astype(np.int64)
            gaps[0] += self.last[k - 1] if k else 0
            self.known[k] = np.cumsum(gaps), tf
        return self.known[k]


def best_of(lists: list[tuple[Postings, int]], factors: np.ndarray, k: int, threshold: int) -> list[tuple[int, int]]:
    """(score, document) of a shard's k best documents of at least the threshold; of equal scores, those of least document.

    lists holds the postings and weight of each term of the item.
    """
    lists = [x for x in lists if x[1] > 0]
    if not lists:
        return []
    threshold, heap, n = max(threshold, 1), [], len(factors)
    # between these borders each term stays in one block
    lows = np.unique(np.concatenate([[0], *[p.first for p, _ in lists]]))
    lows = lows[lows < n]
    highs = np.concatenate([lows[1:], [n]]) - 1
    # pivots: where the lists not yet at an end can reach the threshold by their largest impacts
    ends = np.array([p.last[-1] for p, _ in lists])
    most = np.array([p.best * w for p, w in lists])
    by_end = np.argsort(ends)
    left = np.concatenate([[0], np.cumsum(most[by_end])])
    reach = left[-1] - left[np.searchsorted(ends[by_end], lows, "left")]
    live = np.flatnonzero(reach >= threshold)
    # shallow moves: the current block of each term, by the directories alone
    bound = np.zeros(len(lows), np.int64)
    current = []
    for p, w in lists:
        own = np.searchsorted(p.last, lows[live], "left")
        there = own < len(p.last)
        current.append(np.where(there, own, -1))
        bound[live[there]] += w * p.top[own[there]]
    live_bound = bound[live]
    at, length = 0, 1
    while at < len(live):
        run, length = [], min(2 * length, RUN)
        while at < len(live) and len(run) < length:
            if live_bound[at] >= threshold:
                run.append(at)
            at += 1
        if not run:
            break
        base = int(lows[live[run[0]]])
        scores = np.zeros(int(highs[live[run[-1]]]) - base + 1, np.int64)
        inside = np.zeros(len(scores) + 1, np.int64)
        np.add.at(inside, lows[live[run]] - base, 1)
        np.add.at(inside, highs[live[run]] - base + 1, -1)
        for (p, w), blocks in zip(lists, current):
            for b in np.unique(blocks[run]):
                if b >= 0:
                    docs, tf = p.block(int(b))
                    own = slice(*np.searchsorted(docs, [base, base + len(scores)]))
                    scores[docs[own] - base] += w * impact(tf[own], factors[docs[own]])
        scores[np.cumsum(inside[:-1]) == 0] = 0
        for d in np.flatnonzero(scores >= threshold):
            # later documents of equal score rank behind, so the least document is the last to go
            heapq.heappush(heap, (int(scores[d]), -(base + int(d))))
            if len(heap) > k:
                heapq.heappop(heap)
        if len(heap) == k:
            threshold = max(threshold, heap[0][0] + 1)
    return [(s, -d) for s, d in heap]


_FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def _searched(postings: DataFrame, k: int, item_type: T.DataType) -> DataFrame:
    """item_id, doc_id, score of the best documents of each shard and batch of items."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[rows["ids"].notna()]
        ids, factors = own["ids"].iloc[0], np.asarray(own["factors"].iloc[0], np.int64)
        items: dict = {}
        for r in rows[rows["ids"].isna()].itertuples():
            p = Postings(r.df, r.last, r.top, r.widths, r.data)
            for x in r.wanted:
                items.setdefault(x["item_id"], []).append((p, x["weight"], x["threshold"]))
        found = []
        for item, lists in items.items():
            for score, d in best_of([(p, w) for p, w, _ in lists], factors, k, lists[0][2]):
                found.append((item, int(ids[d]) if d < len(ids) else None, score))  # null ids come last
        out = pd.DataFrame(found, columns=["item_id", "doc_id", "score"])
        return out.astype({"doc_id": "Int64"})

    schema = T.StructType([T.StructField("item_id", item_type), *_FOUND.fields])
    return postings.groupBy("shard", "batch").applyInPandas(of, schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, *, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents of a score above 0."""
    item_type = items.schema[item_id].dataType
    wanted = written(weights(index, items, item_id=item_id, text=text), "item-terms")

    def round_of(rows: DataFrame, own: DataFrame) -> DataFrame:
        terms = own.groupBy("batch", "term").agg(F.collect_list(F.struct("item_id", "weight", "threshold")).alias("wanted"))
        # the row of a shard's documents, which has the empty term, goes to every batch
        each = own.select("batch").distinct().select("batch", F.lit(b"").alias("term"), F.lit(None).cast(terms.schema["wanted"].dataType).alias("wanted"))
        asked = written(terms.unionByName(each), "asked-terms")
        return _searched(rows.join(asked, "term"), k, item_type)

    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST_SHARDS)) == 0
    first = written(_ranked(round_of(index.rows.where(early), wanted.withColumn("threshold", F.lit(0).cast("long"))), k).select("item_id", "doc_id", "score", "rank"), "first-found")
    reached = first.where(F.col("rank") == k).select("item_id", F.col("score").alias("threshold"))
    later = round_of(index.rows.where(~early), wanted.join(reached, "item_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0).cast("long"))))
    return _ranked(first.drop("rank").unionByName(later), k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
