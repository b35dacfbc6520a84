"""Vectorised text kernels over Arrow batches.

Each kernel works on the UTF-8 buffer of an Arrow string column, a bounded
number of bytes at a time, so a task's memory follows CHUNK_BYTES and its
longest single text, not the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text that a kernel looks at together; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240601)
_SLOT = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Which bytes of an 8-byte block belong to a span, if so many are left of it.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(data: np.ndarray) -> np.ndarray:
    """The little-endian number that the 8 bytes from each place on make; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII letters in lower case."""
    return _ASCII_LOWER[data]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``limit`` bytes."""
    raw, offsets = utf8(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's range of word numbers."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    begin = ~space
    finish = begin.copy()
    begin[1:] &= space[:-1]
    finish[:-1] &= space[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[edge] = ~space[edge]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    finish[last] = ~space[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span.

    A bijection mixes one 8-byte block after the other into the length, so spans
    of one length up to 8 bytes never collide and no sums or products are left
    that a text's own pattern could cancel; long spans take BLAKE2b.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = folded(data) if lower else data
    block, length = blocks(data), ends - starts
    found = mix(length.astype(np.uint64) * _SLOT[63] + _SLOT[62])
    live = np.flatnonzero(length <= _LONG)
    for done in range(0, _LONG, 8):
        live = live[length[live] > done]
        if not len(live):
            break
        own = block[starts[live] + done] & MASKS[np.minimum(length[live] - done, 8)]
        found[live] = mix(found[live] ^ own)
    for i in np.flatnonzero(length > _LONG).tolist():
        found[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return found


def shingles(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, and the range of each text.

    A text of fewer words has one shingle, its whole word sequence; a text
    without words has none.
    """
    starts, ends, words = word_bounds(data, offsets)
    hashes = span_hashes(data, starts, ends, lower)
    per_text = np.diff(words)
    total = len(hashes)
    text = np.repeat(np.arange(len(per_text)), per_text)
    n = max(0, total - k + 1)
    whole = np.zeros(n, np.uint64)
    for j in range(k if n else 0):
        whole += hashes[j : j + n] * _SLOT[j]
    inside = text[:n] == text[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    found, owner = mix(whole[inside]), text[:n][inside]
    short = np.flatnonzero((per_text > 0) & (per_text < k))
    if len(short):
        parts = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = per_text[short] > j
            parts[has] += hashes[words[short[has]] + j] * _SLOT[j]
        extra = mix(parts + per_text[short].astype(np.uint64) * _SLOT[62])
        found, owner = np.concatenate([found, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, np.searchsorted(owner, np.arange(len(per_text) + 1))


_TABULATION = _RNG.integers(0, 1 << 32, (8, 256), dtype=np.uint32)


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 texts, and each text's range among them."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead].astype(np.uint32)
    points = first.copy()
    wide = np.flatnonzero(first >= 0xC0)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        n = 2 + (first[wide] >= 0xE0) + (first[wide] >= 0xF0)
        value = first[wide] & (0x7F >> n).astype(np.uint32)
        for j in range(1, 4):
            more = n > j
            value[more] = value[more] << np.uint32(6) | padded[lead[wide[more]] + j] & np.uint32(0x3F)
        points[wide] = value
    return points, np.searchsorted(lead, offsets)


def gram_codes(data: np.ndarray, offsets: np.ndarray, sizes: range, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: (codes of ``bits`` bits, start positions) of the grams of bytes (uint8) or code points (uint32) inside the texts.

    Longer grams extend the sums of shorter ones; a byte's terms are from a
    table, a code point's are multiples of its own hash.
    """
    total = np.zeros(len(data), np.uint32)
    if data.dtype != np.uint8:
        data = data * np.uint32(0x9E3779B1)
        data ^= data >> np.uint32(15)
    for n in range(1, sizes.stop):
        m = len(data) - n + 1
        if m <= 0:
            return
        total = total[:m] + (_TABULATION[n - 1][data[n - 1 :]] if data.dtype == np.uint8 else data[n - 1 :] * (_TABULATION[n - 1, 0] | np.uint32(1)))
        if n in sizes:
            inside = np.ones(m, bool)
            for back in range(1, n):  # a text's last n-1 positions start no gram
                cut = offsets[1:] - back
                cut = cut[(cut >= offsets[:-1]) & (cut < m)]
                inside[cut] = False
            codes = (total * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - bits)
            at = np.flatnonzero(inside)
            yield codes[at], at


#: Character classes of the pre-token pattern: letters, numbers, other, white space.
_LETTER, _NUMBER, _OTHER, _BLANK = range(4)
_CLASSES: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """The class of each code point, as the pattern's own regular expressions tell it."""
    if not _CLASSES:
        everything = "".join(map(chr, range(0x110000)))
        found = np.full(0x110000, _OTHER, np.uint8)
        for kind, expression in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\s+")):
            for m in regex.finditer(expression, everything):
                found[m.start() : m.end()] = kind
        _CLASSES.append(found)
    return _CLASSES[0]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 the class of the character that it is part of."""
    table = character_classes()
    found = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        n = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> n)
        for j in range(1, 4):
            more = n > j
            point[more] = point[more] << 6 | data[lead[more] + j] & 0x3F
        kind = table[point]
        found[lead] = kind
        for j in range(1, 4):
            more = n > j
            found[lead[more] + j] = kind[more]
    return found


def pretokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the public tokenizers' pattern in each text.

    Runs of a class are the matches, but for three rules. The last character of
    a run of blanks before something else is a match of its own, or, if it is a
    space, belongs to what follows. An apostrophe that starts a match takes the
    s, t, m, d, re, ve or ll after it. Texts are apart.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = byte_classes(data)
    start = np.zeros(n + 1, bool)
    start[1:n] = kind[1:] != kind[:-1]
    blank_end = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK)) + 1
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    blank_end = blank_end[~edge[blank_end]]
    start[offsets] = True
    last = blank_end - 1
    for _ in range(3):
        last = np.where((data[last] & 0xC0) == 0x80, last - 1, last)
    start[last] = True
    start[blank_end[data[last] == 0x20]] = False
    quote = np.flatnonzero((data == 0x27) & start[:n])
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    one, two = padded[quote + 1], padded[quote + 2]
    one = np.where(edge[np.minimum(quote + 1, n)], 0, one)
    two = np.where(edge[np.minimum(quote + 2, n)], 0, two)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for which, width in ((short, 2), (long, 3)):
        at = quote[which]
        start[at + 1] = False
        start[at + width] = True
    starts = np.flatnonzero(start[:n])
    return starts, np.append(starts[1:], n)
