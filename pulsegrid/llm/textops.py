"""Array helpers over the UTF-8 buffers of Arrow string columns.

All functions work on slices of whole texts: ``slices`` cuts a record batch between
rows so that temporary arrays stay small; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard

SLICE_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = ~WHITE
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Slice(NamedTuple):
    """Rows ``first`` to ``first + len(offsets) - 1`` of a batch: bytes and row boundaries."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole rows of a string column, about ``limit`` bytes at a time; null is empty."""
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # what lies under a null counts as nothing
        lengths = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if lengths.sum() != offsets[-1] - offsets[0]:
            yield from slices(column.fill_null(""), limit)
            return
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Slice(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


def words(s: Slice, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row where its words begin in these (rows + 1 entries)."""
    inside = in_word[s.data]
    edge = np.empty(len(inside) + 1, bool)
    edge[0] = edge[-1] = False
    edge[1:-1] = inside[:-1] & inside[1:]
    edge[s.offsets] = False  # rows end words
    starts = np.flatnonzero(inside & ~edge[:-1])
    ends = np.flatnonzero(inside & ~edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, s.offsets)


def word_hashes(s: Slice, starts: np.ndarray, in_word: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each word, by its bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = _byte_values(lower)
    values[~in_word] = 0
    up, down = _powers(len(s.data))
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(values[s.data] * up, starts) * down[starts])


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; runs over row ends are included and must be left out by the caller."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[: len(hashes) - n + 1].copy()
        for i in range(1, n):
            total = total * _BASE + hashes[i : len(hashes) - n + 1 + i]
    return mix(total)


def text_hashes(texts: list[str], in_word: np.ndarray) -> list[np.ndarray]:
    """The word hashes of a few texts, by the same rule."""
    out = []
    for s in slices(pa.array(texts, pa.large_string())):
        starts, _, bounds = words(s, in_word)
        hashes = word_hashes(s, starts, in_word)
        out += [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
    return out


def pack(x: np.ndarray) -> bytes:
    """Integers by planes of bytes, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def pack_steps(x: np.ndarray) -> bytes:
    """Unsigned integers by their differences, which may wrap around: small where most of ``x`` rises."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_steps(raw: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)
