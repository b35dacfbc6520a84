"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps the hash of every 5-word shingle that lies below a fixed fraction
of the hash range, so its size follows the document's. Sketches of parts merge by
union, and a small document's containment in a large one is the share of its kept
hashes that the large one keeps too. Codes are the upper 30 bits of a hash. The
likeness of two fingerprints is the Jaccard similarity of their kept codes, an
estimate: of the n codes that two texts have together one in SCALE is kept, so
its standard error is about sqrt(SCALE * J * (1 - J) / n). A short text may keep
none.

Texts of fewer words are one shingle, texts without words have none. Null texts
count as empty. Two empty sketches are alike only if the texts are equal, which
128 bits of the text's own digest in the fingerprint tell. Repeated rows and
rows without an id are rows of their own; an only row is followed by itself.
Empty tables give empty results; further columns, whatever their names, play no
part.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm import kernels
from seqwright.llm.common import chosen, table

SHINGLE_WORDS = 5
#: One hash in so many is kept. Over the documents' edited texts this gives a mean error of 0.03.
SCALE = 3
CODE_BITS = 30
_DIGITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
#: Documents in a stretch of ids, about, when each document meets the next; there are as many stretches as shuffle partitions at least.
ROWS_TOGETHER = 1 << 14
_LEAST = -(1 << 63)


class Sketches:
    """Some texts: the keys ``text << 32 | code`` that their sketches keep, in order, their shingle counts and digests."""

    def __init__(self, column: pa.Array):
        self.n = len(column)
        keys, counts, marks = [], [np.zeros(0, np.int64)], []
        for low, high, data, offsets in kernels.chunks(column):
            hashes, at = kernels.shingles(data, offsets, SHINGLE_WORDS, lower=False)
            owner = np.repeat(np.arange(low, high, dtype=np.uint64), np.diff(at))
            codes = hashes >> np.uint64(64 - CODE_BITS)
            own = codes < np.uint64((1 << CODE_BITS) // SCALE)
            keys.append(np.unique(owner[own] << np.uint64(32) | codes[own]))
            counts.append(np.diff(at))
            raw, at = data.tobytes(), offsets.tolist()
            marks += [hashlib.blake2b(raw[i:j], digest_size=16).hexdigest() for i, j in itertools.pairwise(at)]
        self.kept = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.counts, self.marks = np.concatenate(counts), np.array(marks, object)
        self.kept_ends = np.searchsorted(self.kept, np.arange(self.n + 1, dtype=np.uint64) << np.uint64(32))

    def texts(self) -> list[str]:
        """The fingerprints as text: shingle count, digest of the text, then the codes, five digits to base 64 each."""
        codes = self.kept.astype(np.int64) & 0xFFFFFFFF
        raw = _DIGITS[(codes[:, None] >> np.arange(CODE_BITS - 6, -1, -6)) & 63].tobytes().decode()
        ends = self.kept_ends.tolist()
        return [f"{n:x}.{m}.{raw[5 * i : 5 * j]}" for n, m, i, j in zip(self.counts.tolist(), self.marks.tolist(), ends, ends[1:], strict=False)]


def read(fingerprint: str) -> tuple[int, str, set[int]]:
    """(shingle count, digest of the text, kept codes) of a fingerprint."""
    n, mark, digits = fingerprint.split(".")
    values = np.searchsorted(np.sort(_DIGITS), np.frombuffer(digits.encode(), np.uint8))
    values = np.argsort(_DIGITS, kind="stable")[values].reshape(-1, 5) if digits else np.zeros((0, 5), np.int64)
    return int(n, 16), mark, set((values << np.arange(CODE_BITS - 6, -1, -6)).sum(axis=1).tolist())


def likeness(a: Sketches, rows_a: np.ndarray, b: Sketches, rows_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of the kept codes of text rows_a[i] of ``a`` and rows_b[i] of ``b``; if neither keeps any, 1 for equal texts and 0 for others."""
    size_a, size_b = np.diff(a.kept_ends)[rows_a], np.diff(b.kept_ends)[rows_b]

    def picked(s: Sketches, rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        after = np.cumsum(size)
        at = np.repeat(s.kept_ends[rows] - (after - size), size) + np.arange(int(after[-1]) if len(after) else 0)
        return np.repeat(np.arange(len(rows), dtype=np.uint64), size) << np.uint64(32) | s.kept[at] & np.uint64(0xFFFFFFFF)

    both = np.intersect1d(picked(a, rows_a, size_a), picked(b, rows_b, size_b), assume_unique=True)
    shared = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(rows_a))
    union = size_a + size_b - shared
    return np.where(union > 0, shared / np.maximum(union, 1), (a.marks[rows_a] == b.marks[rows_b]).astype(float))


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, codes (sorted array of the kept codes) and fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = Sketches(batch.column("text"))
            codes = pa.LargeListArray.from_arrays(pa.array(s.kept_ends), pa.array((s.kept & np.uint64(0xFFFFFFFF)).astype(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s.counts), codes, pa.array(s.texts(), pa.string())], names=["doc_id", "n_shingles", "codes", "fingerprint"])

    source = chosen(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, codes array<long>, fingerprint string")


def merged(codes: Column, other: Column) -> Column:
    """The sketch of two texts together, but for the shingles across their border."""
    return F.array_sort(F.array_union(codes, other))


def containment(part: Column, whole: Column) -> Column:
    """The estimated share of ``part``'s shingles that ``whole`` has; null if nothing of ``part`` is kept."""
    return F.size(F.array_intersect(part, whole)) / F.when(F.size(part) > 0, F.size(part))


def _places(batch: pa.RecordBatch) -> np.ndarray:
    """The place of each row (key, h) in the order of ids, as 16 bytes."""
    found = np.zeros((len(batch), 2), ">u8")
    for k, name in enumerate(("key", "h")):
        found[:, k] = batch.column(name).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    return found.view("S16").ravel()


def with_next(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) in stretches of descending ids, each followed by the row that comes next.

    Columns stretch, key, h, no_id, text and copy: 0 for rows of their own, 1
    for the copy of the next stretch's first row. Rows of an equal id follow
    each other by a hash of their texts, null ids come last. Stretches are the
    ranges of a range partitioning of the ids, all of one size; only each
    one's ends, a row a partition, reach the driver.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS_TOGETHER)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("key")
    keyed = docs.select(key, F.xxhash64("text").alias("h"), F.col("doc_id").isNull().alias("no_id"), "text")
    dealt = keyed.select("key", "h").repartitionByRange(n, "key", "h").groupBy(F.spark_partition_id())
    ends = dealt.agg(F.min(F.struct("key", "h")).alias("low"), F.max(F.struct("key", "h")).alias("high")).select("low", "high").orderBy("low").toArrow()
    low, high = (_places(pa.RecordBatch.from_struct_array(ends.column(c).combine_chunks())) if len(ends) else np.zeros(0, "S16") for c in ("low", "high"))
    shared = spark.sparkContext.broadcast((low, high))  # 32 bytes a partition

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = shared.value
        names = ["stretch", "key", "h", "no_id", "text", "copy"]
        for batch in batches:
            place = _places(batch)
            stretch = (np.searchsorted(low, place, side="right") - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(stretch), *batch.columns, pa.array(np.zeros(len(place), np.int32))], names=names)
            # A stretch's first row also ends the stretch of the greater ids before it; the very first ends the last.
            again = np.flatnonzero(place == high[stretch])
            if len(again):
                to = pa.array(((stretch[again] + 1) % len(low)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([to, *batch.take(pa.array(again)).columns, pa.array(np.ones(len(again), np.int32))], names=names)

    rows = keyed.mapInArrow(spread, "stretch int, key long, h long, no_id boolean, text string, copy int")
    return rows.repartitionById(max(len(low), 1), F.col("stretch")).sortWithinPartitions("stretch", "copy", F.desc("key"), F.desc("h"), "text")


def halves(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``following``, or all of it."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def edit_digests(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, that of its edited text, and their likeness to each other and to the next row's.

    Rows of equal id follow each other by a hash of the text.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None
        for whole in batches:
            for low in range(0, len(whole), 512):
                batch = whole.slice(low, 512)
                rows = batch if left is None else pa.concat_batches([left, batch])
                left = rows.slice(len(rows) - 1)
                own = np.flatnonzero(rows.column("copy").to_numpy()[:-1] == 0)  # a stretch ends with copies, so the next row is of the same
                if not len(own):
                    continue
                texts = [t or "" for t in rows.column("text").to_pylist()]
                edited = [halves(texts[i], texts[i + 1]) for i in own.tolist()]
                plain, changed = Sketches(rows.column("text")), Sketches(pa.array(edited, pa.large_string()))
                found = plain.texts()
                ids = [None if n else k for k, n in zip(rows.column("key").to_pylist(), rows.column("no_id").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[i] for i in own.tolist()], pa.int64()),
                        pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                        pa.array([found[i] for i in own.tolist()], pa.string()),
                        pa.array(changed.texts(), pa.string()),
                        pa.array(np.round(likeness(plain, own, changed, np.arange(len(own))), 6)),
                        pa.array(np.round(likeness(plain, own, plain, own + 1), 6)),
                    ],
                    names=names,
                )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).select("key", "no_id", "text", "copy").mapInArrow(run, schema)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_digests(chosen(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))
