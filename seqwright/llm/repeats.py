"""Removing long repeated byte strings by merged Burrows-Wheeler transforms.

A byte goes if it lies in a string of ``length`` bytes that also starts anywhere
else. Rows of equal text are made one first. Every string is dealt to the place
where all its copies meet by an anchor, the 32-byte gram of least hash in it,
which depends on its bytes alone; neighbouring strings of one anchor travel
together as a segment. Anchors that occur once are done with. Segments of equal
bytes become one with a count.

An anchor with many different segments is split, exactly: its strings hold the
anchor at an offset from 0 to length - 32, so those of either half of the
offsets share a longer core around it, and the core's bytes and the half are
their new key. A key that is still large is split by the next halves; at last
the core is the whole string, of which there is one. So no task sees more than
about HOT_BYTES of one key.

Where a key has different segments, their Burrows-Wheeler transforms are built
shard by shard and merged: the interleave of the shards' suffixes is refined
from one depth to twice the depth by following the transforms' own next-suffix
maps, so that suffixes are merged and never sorted anew. The ranks of each depth
give the exact common prefix of neighbouring suffixes, and suffixes between
common prefixes of ``length`` are a repeated interval.

Matches never cross texts. Null and empty texts have no bytes. Repeated rows and
rows of equal text are copies of each other, so they lose all bytes if they have
``length`` or more. Texts are told apart by 96 bits of their SHA-256 digest,
segments of a key by 64 bits of a BLAKE2b digest. Empty tables give empty
results; further columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqwright.llm import kernels
from seqwright.llm.common import chosen, table
from seqwright.llm.jaccard import runs
from seqwright.scratch import collected, discard, new_path, remove, written

LENGTH = 200
GRAM = 32
#: Windows of one text that are looked at together; a text's anchors don't depend on where it is cut.
PIECE = 1 << 22
#: Bytes of segments in a shard, and in the shards that are merged with each other.
SHARD_BYTES, MERGE_BYTES = 1 << 17, 1 << 20
#: Bytes of different segments beyond which a key is split.
HOT_BYTES = 1 << 20


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    rest = width - span
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def digest(data: bytes) -> int:
    """A signed 64-bit number from a BLAKE2b digest."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The segments of the texts: text, hash of the anchor, content, first window start (in ``data``), number of windows, and the anchor's offset from the first window."""
    n = len(data) - GRAM + 1
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    block = kernels.blocks(data)
    # Equal hashes of different grams change which windows meet, not which are equal.
    grams = kernels.mix(sum(block[k * 8 : k * 8 + n] * kernels._SLOT[k] for k in range(GRAM // 8)) + kernels._SLOT[8])
    bits = np.uint64(24)
    keys = grams >> bits << bits | np.arange(n, dtype=np.uint64)
    least = sliding_least(keys, length - GRAM + 1)
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    room = np.diff(offsets) - length + 1
    has = np.flatnonzero(room > 0)
    text = np.repeat(has, room[has])
    start = np.repeat(offsets[has], room[has])
    after = np.cumsum(room[has])
    start += np.arange(len(start)) - np.repeat(after - room[has], room[has])
    own = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    low = start[first]
    raw = data.tobytes()
    content = np.fromiter((digest(raw[i:j]) for i, j in zip(low.tolist(), (low + count + length - 1).tolist(), strict=True)), np.int64, len(low))
    return text[first], grams[own[first]].astype(np.int64), content, low, count, own[first] - low


#: A segment: its key, content, text, first window, windows, the anchor's offset from the first window, and the offsets that the key is for.
SEGMENT = "key long, content long, t binary, start long, windows int, at int, low int, high int"
_NAMES = [c.split()[0] for c in SEGMENT.split(", ")]


def segment_rows(docs: DataFrame, length: int) -> DataFrame:
    """Every segment of ``docs`` (t, text), keyed by its anchor."""

    def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if len(offsets) > 2 or len(data) <= PIECE + length:
            yield 0, data, offsets
            return
        for low in range(0, len(data) - length + 1, PIECE):
            part = data[low : low + PIECE + length - 1]
            yield low, part, np.array([0, len(part)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.column("t")
            for first, _, data, offsets in kernels.chunks(batch.column("text")):
                for shift, part, ends in pieces(data, offsets):
                    text, key, content, low, count, at = segments(part, ends, length)
                    n = len(key)
                    arrays = [pa.array(key), pa.array(content), t.take(pa.array(first + text)), pa.array(low - ends[text] + shift)]
                    arrays += [pa.array(x.astype(np.int32)) for x in (count, at, np.zeros(n), np.full(n, length - GRAM))]
                    yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)

    return docs.select("t", "text").mapInArrow(run, SEGMENT)


def split_rows(rows: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """The windows of ``rows`` as segments of one half of the offsets each, keyed by the half and the core that its windows share."""
    own = rows.groupBy("t").agg(F.collect_list(F.struct("start", "windows", "at", "low", "high")).alias("own"))
    texts = docs.join(own, "t").select("t", F.col("text").cast("binary").alias("raw"), "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                raw, found = batch.column("raw")[k].as_py(), []
                for s in batch.column("own")[k].as_py():
                    anchor, middle = s["start"] + s["at"], (s["low"] + s["high"]) // 2
                    for low, high in ((s["low"], middle), (middle + 1, s["high"])):
                        first, last = max(s["start"], anchor - high), min(s["start"] + s["windows"] - 1, anchor - low)
                        if first <= last:
                            key = digest(raw[anchor - low : anchor - high + length] + bytes((low, high)))
                            found.append((key, digest(raw[first : last + length]), first, last - first + 1, anchor - first, low, high))
                t = pa.array([batch.column("t")[k].as_py()] * len(found), pa.binary())
                columns = [list(c) for c in zip(*found, strict=True)] or [[]] * 7
                longs = [pa.array(c, pa.int64()) for c in columns[:3]]
                yield pa.RecordBatch.from_arrays([*longs[:2], t, longs[2], *(pa.array(c, pa.int32()) for c in columns[3:])], names=_NAMES)

    return texts.mapInArrow(run, SEGMENT)


class Shard:
    """The Burrows-Wheeler transform of some strings, each with an end mark below all bytes, and the string and offset of its suffixes."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray):
        """``data`` holds the strings one after the other."""
        n = len(data) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1  # of the end marks
        symbol = np.zeros(n, np.uint16)
        inside = np.ones(n, bool)
        inside[ends] = False
        symbol[inside] = data.astype(np.uint16) + 1
        string = np.repeat(np.arange(len(lengths)), lengths + 1)
        left = ends[string] - np.arange(n)
        padded = np.concatenate([symbol, np.zeros(8, np.uint16)])
        key = np.zeros(n, np.uint64)
        for j in range(7):
            key = key << np.uint64(9) | np.where(left > j, padded[j : j + n], 0).astype(np.uint64)
        depth = 7
        rank, order = self._ranks(key)
        at = np.arange(n)
        while True:
            # Equal strings up to their end marks differ by the marks, which stand in the order of the strings.
            following = np.where(left >= depth, rank[np.minimum(at + depth, n - 1)] + len(lengths), string)
            rank, order = self._ranks(rank.astype(np.uint64) * np.uint64(n + len(lengths) + 1) + following.astype(np.uint64))
            if rank[order[-1]] == n - 1:
                break
            depth *= 2
        self.string = string[order].astype(np.int32)
        self.offset = (lengths[string] - left)[order].astype(np.int32)
        before = np.concatenate([[0], symbol[:-1]])
        self.transform = before[order].astype(np.uint16)

    @staticmethod
    def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        sorted_keys = key[order]
        new = np.zeros(len(key), np.int64)
        new[1:] = sorted_keys[1:] != sorted_keys[:-1]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(new)
        return rank, order


def merge(shards: list[Shard], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shards' suffixes in one order, as numbers of shard after shard; the symbols, up to ``length``, that each shares with the one before; and the number of each one's interval of suffixes that share ``length`` symbols.

    Works on the transforms alone. ``step`` maps a suffix to the one that starts
    ``depth`` symbols later; suffixes that have met their end mark by then differ
    from all others.
    """
    first, following, base = [], [], 0
    for s in shards:
        to = np.argsort(s.transform, kind="stable")
        first.append(s.transform[to])
        following.append((to + base).astype(np.int32))
        base += len(to)
    symbol, one = np.concatenate(first), np.concatenate(following)
    n = len(symbol)
    key, step, ended = np.zeros(n, np.int64), np.arange(n, dtype=np.int32), np.zeros(n, bool)
    levels = []  # (depth, a number for the first ``depth`` symbols, the suffix that many symbols later)
    for depth in range(1, 5):
        key = key << 9 | np.where(ended, 0, symbol[step])
        ended |= symbol[step] == 0
        step = one[step]
        if depth < 4 and depth != 3:
            levels.append((depth, np.where(ended, -1 - np.arange(n), key), step))
    order = np.lexsort((np.where(ended, np.arange(n), -1), key))
    sorted_key, sorted_end = key[order], ended[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | sorted_end[1:] | sorted_end[:-1]
    while True:
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(new) - 1
        if depth & (depth - 1) == 0:
            levels.append((depth, rank, step))
        if depth >= length:
            break
        by = min(depth, length - depth)
        jump = step if by == depth else _jump(one, by)
        pair = rank.astype(np.int64) * n + rank[jump]
        order = np.argsort(pair, kind="stable")  # merges the shards' runs, which are in order already
        sorted_key = pair[order]
        new = np.ones(n, bool)
        new[1:] = sorted_key[1:] != sorted_key[:-1]
        depth += by
        step = step[step] if depth & (depth - 1) == 0 else step
    common = np.zeros(n, np.int32)
    x, y = order[:-1], order[1:]
    for width, code, to in reversed(levels):
        same = code[x] == code[y]
        common[1:] += same * np.int32(width)
        x, y = np.where(same, to[x], x), np.where(same, to[y], y)
    np.minimum(common, length, out=common)
    interval = np.empty(n, np.int32)
    interval[order] = np.cumsum(common < length) - 1
    return order, common, interval


def _jump(one: np.ndarray, by: int) -> np.ndarray:
    """``one`` composed ``by`` times."""
    found, power = np.arange(len(one), dtype=np.int32), one
    while by:
        if by & 1:
            found = power[found]
        power, by = power[power], by >> 1
    return found


def repeated_windows(strings: list[bytes], windows: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> list[list[int]]:
    """For each string the runs (start, end, start, end, ...) of its windows that occur twice or more among all strings, as often as ``counts`` says."""
    shards, owner, offset = [], [], []
    low = 0
    sizes = np.array([len(s) for s in strings])
    while low < len(strings):
        high, total = low, 0
        while high < len(strings) and (high == low or total + sizes[high] <= SHARD_BYTES):
            total += sizes[high]
            high += 1
        shards.append(Shard(np.frombuffer(b"".join(strings[low:high]), np.uint8), sizes[low:high]))
        owner.append(shards[-1].string + low)
        offset.append(shards[-1].offset)
        low = high
    _, _, interval = merge(shards, length)
    own, at = np.concatenate(owner), np.concatenate(offset)
    real = at < windows[own]
    weight = np.bincount(interval[real], weights=counts[own[real]].astype(float), minlength=int(interval.max(initial=0)) + 1)
    hit = np.flatnonzero(real & (weight[interval] > 1))
    covered = np.zeros(int(windows.sum()) + len(windows), bool)
    first = np.cumsum(windows + 1) - windows - 1
    covered[first[own[hit]] + at[hit]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    found: list[list[int]] = [[] for _ in strings]
    text = np.searchsorted(first, edges[::2], side="right") - 1
    for k, a, b in zip(text.tolist(), (edges[::2] - first[text]).tolist(), (edges[1::2] - first[text]).tolist(), strict=True):
        found[k] += [a, b]
    return found


def often(rows: DataFrame) -> DataFrame:
    """The segments whose key occurs more than once. The keys are a table, so that the join can split a hot one."""
    known = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeats-often")
    found = written(rows.join(known, "key").select(*_NAMES), "repeats-met")
    discard(known)
    return found


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """t, spans (array of start and end, of bytes to remove, in order and apart) of each text that has any; ``docs`` has t and text, no t twice."""
    rows = written(segment_rows(docs, length), "repeats-segments")
    met = often(rows)
    discard(rows)
    places, alone, various = [], [], []
    while True:
        kinds = met.groupBy("key", "content").agg(F.count("*").alias("copies"), F.min_by(F.struct("t", "start"), F.struct("t", "start")).alias("at"), F.first("windows").alias("windows"))
        kinds = written(kinds.select("key", "content", "copies", "at.t", "at.start", "windows"), "repeats-kinds")
        sizes = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(F.col("windows") + (length - 1)).alias("bytes"))
        hot = written(sizes.where((F.col("kinds") > 1) & (F.col("bytes") > HOT_BYTES)).select("key"), "repeats-hot")
        told = kinds.join(sizes, "key")
        alone.append(told.where("kinds = 1 AND copies > 1").select("key", "content", F.array(F.lit(0), F.col("windows")).alias("runs")))
        various.append(told.where((F.col("kinds") > 1) & (F.col("bytes") <= HOT_BYTES)).select("key", "content", "copies", "t", "start", "windows"))
        places.append(met)
        if hot.isEmpty():
            break
        halves = written(split_rows(met.join(hot, "key", "left_semi"), docs, length), "repeats-split")
        met = often(halves)
        discard(halves)
    union = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    wanted = union(various).groupBy("t").agg(F.collect_list(F.struct("key", "content", "copies", "start", "windows")).alias("own"))
    cut = F.transform("own", lambda x: F.struct(x["key"].alias("key"), x["content"].alias("content"), x["copies"].alias("copies"), x["windows"].alias("windows"), F.substring(F.col("text").cast("binary"), (x["start"] + 1).cast("int"), (x["windows"] + length - 1).cast("int")).alias("bytes")))
    strings = docs.join(wanted, "t").select(F.explode(cut).alias("x")).select("x.*").repartition("key").sortWithinPartitions("key", "content")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> pa.RecordBatch:
            whole = pa.concat_batches(held)
            found = repeated_windows(whole.column("bytes").to_pylist(), whole.column("windows").to_numpy(), whole.column("copies").to_numpy(), length)
            return pa.RecordBatch.from_arrays([whole.column("key"), whole.column("content"), pa.array(found, pa.list_(pa.int32()))], names=["key", "content", "runs"])

        for _, group in runs(batches, ["key"]):
            held.append(group)
            size += group.nbytes
            if size >= MERGE_BYTES:
                yield done()
                held, size = [], 0
        if held:
            yield done()

    merged = strings.mapInArrow(work, "key long, content long, runs array<int>").where(F.size("runs") > 0)
    told = written(union(alone).unionByName(merged), "repeats-runs")
    found = union(places).select("key", "content", "t", "start").join(told, ["key", "content"])
    pairs = F.transform(F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)), lambda i: F.struct((F.col("start") + F.get("runs", i)).alias("low"), (F.col("start") + F.get("runs", i + 1) + length - 1).alias("high")))
    spans = found.select("t", F.explode(pairs).alias("span"))
    return spans.groupBy("t").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def text_key(text: str = "text") -> Column:
    """96 bits of the digest of a text; null is empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)), 1, 12)


def different_texts(docs: DataFrame) -> DataFrame:
    """t, text and copies of the texts of ``docs``, each once, dealt by t into buckets, so that joins by t move no texts."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select(text_key().alias("t"), F.coalesce("text", F.lit("")).alias("text")).groupBy("t").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    path = new_path(spark, "repeats-texts")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    found.repartition(buckets, "t").write.bucketBy(buckets, "t").option("path", path).saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay, and the plan above knows their buckets
    return kept


def text_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """t and spans of the texts of ``docs`` that have any to remove: a table, beside which nothing is left."""
    with collected() as made:
        found = cut_texts(docs, length).where("spans IS NOT NULL").select("t", "spans")
    kept = written(found, "repeats-spans")
    remove(docs.sparkSession, made)
    return kept


def cut_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """t, text and spans (null where nothing repeats) of the different texts of ``docs``; all of a text that occurs twice repeats."""
    own = different_texts(docs)
    spans = repeated_spans(own.select("t", "text"), length)
    size = F.octet_length("text")
    whole = F.when((F.col("copies") > 1) & (size >= length), F.array(F.struct(F.lit(0).cast("long").alias("low"), size.cast("long").alias("high"))))
    return own.join(spans, "t", "left").select("t", "text", F.coalesce(whole, "spans").alias("spans"))


def kept_bytes(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What is left of ``text``, and how many maximal runs were removed."""
    parts, at, n = [], 0, 0
    for s in spans if spans is not None else ():
        if s["low"] > at or not n:
            parts.append(text[at : s["low"]])
            n += 1
        at = max(at, s["high"])
    return b"".join(parts) + text[at:], n


def removal_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (doc_id, text)."""
    names = ["t", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.encode() for x in batch.column("text").to_pylist()]
            left = [kept_bytes(x, s) for x, s in zip(raw, batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("t"),
                    pa.array([len(x) for x in raw], pa.int64()),
                    pa.array([len(x) - len(k) for x, (k, _) in zip(raw, left, strict=True)], pa.int64()),
                    pa.array([n for _, n in left], pa.int64()),
                    pa.array([hashlib.sha256(k).hexdigest() for k, _ in left], pa.string()),
                ],
                names=names,
            )

    own = chosen(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = cut_texts(own, length).mapInArrow(run, "t binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return own.select("doc_id", text_key().alias("t")).join(found, "t").drop("t")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes gone from ``text``; a character that is cut goes whole, a null text stays null. ``n_chars``, where there is one, follows the text; all rows and other columns stay."""
    names = docs.columns
    others = [c for c in names if c not in ("text", "n_chars")]
    whole = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0))
    rows = docs.select(whole.alias("others"), "text", text_key().alias("t")).join(text_spans(docs.select("text"), length), "t", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [x if x is None or s is None else kept_bytes(x.encode(), s)[0].decode("utf-8", "ignore") for x, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("others"), pa.array(left, pa.string())], names=["others", "text"])

    found = rows.select("others", "text", "spans").mapInArrow(run, StructType([rows.schema["others"], rows.schema["text"]]))
    made = {"text": F.col("text")}
    if "n_chars" in names:
        made["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[made[c].alias(c) if c in made else F.col("others").getField(c).alias(c) for c in names])


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_digests(table(spark, sf_dir, "documents"))
