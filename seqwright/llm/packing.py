"""Token-id output: best-fit-decreasing packing into rows of a fixed length.

Texts become byte-level BPE ids; longer ones are split losslessly into pieces of
at most CONTEXT ids. Pieces, longest first, go into the row whose free space fits
best; a segment tree over the possible amounts of free space finds it. Rows are
written with their ids (padded), cumulative segment lengths and the positions,
which start anew at each piece.

A task packs windows of about WINDOW_TOKENS ids as they arrive, so nothing is
shuffled and its memory doesn't follow the input; only a window's last rows have
room to spare.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from seqwright.llm import bpe
from seqwright.llm.common import table

CONTEXT = 2048
PAD = 0
WINDOW_TOKENS = 2_000_000


class LibraryCodec(bpe.Codec):
    """The same ids, but pre-tokens that are no vocabulary entries are merged by the tokenizer library."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library = tiktoken.Encoding("rows", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def merged(self, key: bytes) -> list[int]:
        return self.library._encode_single_piece(key)


class FreeSpace:
    """Rows by their free space: a segment tree over 0..capacity that tells the least amount of at least n."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.base)
        self.rows: dict[int, list[int]] = defaultdict(list)

    def add(self, space: int, row: int) -> None:
        own = self.rows[space]
        own.append(row)
        if len(own) == 1:
            at = space + self.base
            while at:
                self.tree[at] += 1
                at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(space, row) of a row with the least free space that is ``need`` or more; it leaves the tree."""
        at, tree = need + self.base, self.tree
        if not tree[at]:
            while at > 1 and not (at & 1 == 0 and tree[at + 1]):  # up to the first right neighbour that holds rows
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.base:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        space = at - self.base
        row = self.rows[space].pop()
        if not self.rows[space]:
            while at:
                tree[at] -= 1
                at >>= 1
        return space, row


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """The numbers of the pieces in each row; every length is from 1 to ``capacity``."""
    rows: list[list[int]] = []
    free = FreeSpace(capacity)
    for i, n in ((i, int(lengths[i])) for i in np.argsort(-lengths, kind="stable").tolist()):
        found = free.take(n)
        if found is None:
            found = capacity, len(rows)
            rows.append([])
        space, row = found
        rows[row].append(i)
        free.add(space - n, row)
    return rows


SCHEMA = "pack_id long, n_tokens long, doc_ids array<long>, doc_starts array<long>, ids binary, cu_seqlens array<int>, positions binary"


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, context: int = CONTEXT, window: int = WINDOW_TOKENS, pad: int = PAD) -> DataFrame:
    """The packed rows of all texts.

    pack_id, n_tokens (without padding), doc_ids and doc_starts (of each piece:
    its document and the first of that document's ids), ids (``context`` little-
    endian uint32), cu_seqlens (0, then the end of each piece) and positions
    (``context`` uint16; 0 in the padding). Null and empty texts have no ids and
    no pieces; repeated rows have pieces of their own. pack_id names the task
    and its row; rows depend on how the input is split.
    """
    path = bpe.rank_file(path)
    if not 1 <= context <= 1 << 16:
        raise ValueError("context must be 1 to 65536")

    def rows(pieces: list[tuple[int | None, int, np.ndarray]], first: int) -> Iterator[pa.RecordBatch]:
        lengths = np.fromiter((len(p[2]) for p in pieces), np.int64, len(pieces))
        packed = best_fit_decreasing(lengths, context)
        for low in range(0, len(packed), 256):
            part = packed[low : low + 256]
            matrix = np.full((len(part), context), pad, "<u4")
            positions = np.zeros((len(part), context), "<u2")
            bounds = []
            for k, own in enumerate(part):
                ends = [0, *itertools.accumulate(int(lengths[i]) for i in own)]
                bounds.append(ends)
                for i, at, stop in zip(own, ends, ends[1:], strict=False):
                    matrix[k, at:stop] = pieces[i][2]
                    positions[k, at:stop] = np.arange(stop - at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(first + low, first + low + len(part)), pa.int64()),
                    pa.array([b[-1] for b in bounds], pa.int64()),
                    pa.array([[pieces[i][0] for i in own] for own in part], pa.list_(pa.int64())),
                    pa.array([[pieces[i][1] for i in own] for own in part], pa.list_(pa.int64())),
                    pa.array([r.tobytes() for r in matrix], pa.binary()),
                    pa.array(bounds, pa.list_(pa.int32())),
                    pa.array([r.tobytes() for r in positions], pa.binary()),
                ],
                names=["pack_id", "n_tokens", "doc_ids", "doc_starts", "ids", "cu_seqlens", "positions"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, np.ndarray]] = []
        n_held = 0
        for part, ids, at in bpe.encoded(batches, path, LibraryCodec):
            for own, low, high in zip(part.column("doc_id").to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                held += [(own, i - low, ids[i : min(i + context, high)]) for i in range(low, high, context)]
            n_held += len(ids)
            if n_held >= window:
                for batch in rows(held, first):
                    first += len(batch)
                    yield batch
                held, n_held = [], 0
        if held:
            yield from rows(held, first)

    return bpe.source_rows(docs, doc_id, text).mapInArrow(run, SCHEMA)


def write_packed(docs: DataFrame, to: str, **parameters) -> None:
    """Write the rows of :func:`pack` as Parquet files to the folder ``to``, which all executors share."""
    pack(docs, **parameters).write.mode("overwrite").parquet(to)


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
