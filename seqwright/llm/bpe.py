"""Byte-level BPE encoding and decoding with a two-tier lookup.

Texts are cut into pre-tokens by array operations that agree with the public
tokenizers' pattern. Whole pre-tokens that are vocabulary entries are resolved by a minimal perfect
hash over the vocabulary (hash-and-displace: a bucket's displacement sends its
keys to free slots of a table of exactly as many slots as keys). Pre-tokens it
does not hold are merged with a heap of adjacent pairs over a doubly linked
list of byte pieces, lowest rank first, leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqwright.llm import kernels
from seqwright.llm.common import chosen, table

#: Entries, and bytes of their keys, that a worker remembers of pre-tokens it has merged; it forgets all beyond, which changes no result.
MEMO, MEMO_BYTES = 600_000, 1 << 25


class PerfectHash:
    """A minimal perfect hash from byte strings to their ranks.

    A key's 64-bit hash picks a bucket. Buckets of several keys have a
    displacement that sends all of them to free slots; buckets of one key name
    their slot. Slots and keys are equally many. Keys are kept beside the
    slots, so a string outside the vocabulary is told apart exactly.
    """

    def __init__(self, ranks: dict[bytes, int]):
        keys = list(ranks)
        self.size = len(keys)
        hashes = self.hashes(keys)
        self.n_buckets = max(1, self.size // 2)
        bucket = (hashes % np.uint64(self.n_buckets)).astype(np.int64)
        counts = np.bincount(bucket, minlength=self.n_buckets)
        order = np.argsort(bucket, kind="stable")
        first = np.cumsum(counts) - counts
        self.shift = np.zeros(self.n_buckets, np.int64)
        taken = np.zeros(self.size, bool)
        slots = np.zeros(self.size, np.int64)
        for width in range(int(counts.max(initial=0)), 1, -1):
            waiting = np.flatnonzero(counts == width)
            d = 0
            while len(waiting):
                d += 1
                own = order[first[waiting][:, None] + np.arange(width)]
                at = self._slot(hashes[own], np.uint64(d))
                flat = at.ravel()
                lead = np.zeros(len(flat), bool)  # the first bucket to ask for a slot has it
                lead[np.unique(flat, return_index=True)[1]] = True
                good = (lead & ~taken[flat]).reshape(at.shape).all(axis=1)
                self.shift[waiting[good]] = d
                taken[at[good].ravel()] = True
                slots[own[good].ravel()] = at[good].ravel()
                waiting = waiting[~good]
        single = np.flatnonzero(counts == 1)
        free = np.flatnonzero(~taken)
        self.shift[single] = -1 - free
        slots[order[first[single]]] = free
        self.keys: list[bytes] = [b""] * self.size
        self.values = np.zeros(self.size, np.uint32)
        self.values[slots] = np.fromiter(ranks.values(), np.uint32, self.size)
        for key, at in zip(keys, slots.tolist(), strict=True):
            self.keys[at] = key

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, keys), np.int64, len(keys))
        ends = np.cumsum(lengths)
        return kernels.span_hashes(np.frombuffer(b"".join(keys), np.uint8), ends - lengths, ends)

    def _slot(self, hashes: np.ndarray, shift: np.ndarray | np.uint64) -> np.ndarray:
        moved = np.asarray([shift], np.uint64) if np.isscalar(shift) else shift
        return (kernels.mix(hashes + moved * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(self.size)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int]:
        """The rank of each key, or -1."""
        if not keys or not self.size:
            return [-1] * len(keys)
        hashes = self.hashes(keys)
        shift = self.shift[(hashes % np.uint64(self.n_buckets)).astype(np.int64)]
        at = np.where(shift < 0, -1 - shift, self._slot(hashes, np.abs(shift).astype(np.uint64)))
        own = self.keys
        return [v if own[s] == k else -1 for k, s, v in zip(keys, at.tolist(), self.values[at].tolist(), strict=True)]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one pre-token: a heap of adjacent pairs over linked bytes.

    Piece i is word[i:after[i]]. ``pair[i]`` is the rank of the pair that
    starts at i, so heap entries, rank and place in one integer, that no longer
    hold are told by it.
    """
    n = len(word)
    get = ranks.get
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [get(word[i : i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        top = pop(heap)
        i = top & mask
        if pair[i] != top >> bits:
            continue
        j = after[i]
        after[i] = k = after[j]
        pair[j] = r = -1
        if k < n:
            before[k] = i
            r = get(word[i : after[k]], -1)
            if r >= 0:
                push(heap, r << bits | i)
        pair[i] = r
        h = before[i]
        if h >= 0:
            pair[h] = r = get(word[h:k], -1)
            if r >= 0:
                push(heap, r << bits | h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[word[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.table = PerfectHash(self.ranks)
        self.forget()
        self.vocabulary: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token

    def forget(self) -> None:
        """Empty the memo: the ids of pre-tokens met so far, one after the other, and where each pre-token's are."""
        self.memo: dict[int | bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.known = self.held = 0

    def places(self, names: list[int] | list[bytes]) -> np.ndarray:
        """Where the ids of pre-tokens are in the memo; those it lacks are learnt: the perfect hash first, the heap for the rest.

        A pre-token's name is its bytes, or a number that holds them and their count.
        """
        at = np.fromiter(map(self.memo.get, names, itertools.repeat(-1)), np.int64, len(names))
        lacking = np.flatnonzero(at < 0).tolist()
        if not lacking:
            return at
        new = list(dict.fromkeys(names[i] for i in lacking))
        keys = [k if isinstance(k, bytes) else k.to_bytes(8, "little")[: k >> 56] for k in new]
        ids = [[rank] if rank >= 0 else self.merged(key) for key, rank in zip(keys, self.table.find(keys), strict=True)]
        used = int(self.ends[self.known - 1]) if self.known else 0
        after = np.cumsum([len(i) for i in ids]) + used
        while len(self.flat) < after[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.ends) < self.known + len(ids):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.flat[used : after[-1]] = list(itertools.chain.from_iterable(ids))
        self.ends[self.known : self.known + len(ids)] = after
        self.memo.update(zip(new, range(self.known, self.known + len(ids)), strict=True))
        self.known += len(ids)
        self.held += sum(map(len, keys))
        at[lacking] = [self.memo[names[i]] for i in lacking]
        return at

    def merged(self, key: bytes) -> list[int]:
        return merge(key, self.ranks)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in ``data`` as uint32, and where each text's begin and end.

        Pre-tokens of up to 7 bytes are told apart by numbers that hold them,
        longer ones by their bytes.
        """
        starts, ends = kernels.pretokens(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.known > MEMO or self.held > MEMO_BYTES:
            self.forget()
        length = ends - starts
        at = np.empty(len(starts), np.int64)
        short = np.flatnonzero(length <= 7)
        numbers = kernels.blocks(data)[starts[short]] & kernels.MASKS[length[short]] | length[short].astype(np.uint64) << np.uint64(56)
        different, place = np.unique(numbers, return_inverse=True)
        at[short] = self.places(different.tolist())[place]
        long, raw = np.flatnonzero(length > 7), data.tobytes()
        at[long] = self.places([raw[i:j] for i, j in zip(starts[long].tolist(), ends[long].tolist(), strict=True)])
        stop = self.ends[at]
        begin = np.where(at > 0, self.ends[at - 1], 0)
        count = stop - begin
        after = np.cumsum(count)
        ids = self.flat[np.repeat(begin - (after - count), count) + np.arange(after[-1])]
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, type], Codec] = {}


def codec(path: str, kind: type[Codec] = Codec) -> Codec:
    """One codec a process, rank file and kind."""
    if (path, kind) not in _CODECS:
        _CODECS[path, kind] = kind(path)
    return _CODECS[path, kind]


def encoded(batches: Iterator[pa.RecordBatch], path: str, kind: type[Codec] = Codec) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, ids, offsets of each row's ids), about CHUNK_BYTES of text at a time."""
    own = codec(path, kind)
    for batch in batches:
        for low, high, data, offsets in kernels.chunks(batch.column("text")):
            yield batch.slice(low, high - low), *own.encode(data, offsets)


def rank_file(path: str | None) -> str:
    return path or public_tokenizers.path("byte_bpe_50k.tiktoken")


def source_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return chosen(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))


def encode(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids``, the binary little-endian uint32 token ids of each whole text.

    Null and empty texts have no ids. Every row is encoded by itself, so
    repeated rows and null ids stay as they are; further columns are dropped.
    No pre-token is too long: the heap takes n log n steps.
    """
    path = rank_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, at in encoded(batches, path):
            raw = ids.astype("<u4", copy=False).tobytes()
            packed = [raw[4 * i : 4 * j] for i, j in itertools.pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "ids"])

    return source_rows(docs, doc_id, text).mapInArrow(run, "doc_id long, ids binary")


def decode(ids: DataFrame, *, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` from the rows of :func:`encode`; null ids decode to an empty text."""
    path = rank_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, the digest of its ids and of the bytes that they decode to."""
    path = rank_file(path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part, ids, at in encoded(batches, path):
            raw, spans = ids.astype("<u4", copy=False).tobytes(), list(itertools.pairwise(at.tolist()))
            digests = [hashlib.sha256(raw[4 * i : 4 * j]).hexdigest() for i, j in spans]
            decoded = [hashlib.sha256(own.decode(ids[i:j])).hexdigest() for i, j in spans]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=names)

    return source_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
