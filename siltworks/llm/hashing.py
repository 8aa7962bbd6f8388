"""Vectorised words, lines and hashes of a column of texts, used inside Spark tasks.

A batch of texts arrives as one Arrow buffer of UTF-8 bytes. Words or lines are found with byte
tables, and each span is hashed with a polynomial over the bytes: prefix sums modulo 2**64 give the
hash of every span in a few array operations, with no Python object for each word. Two multipliers
give two independent 64-bit hashes, together 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 18
#: Odd multipliers of the polynomials.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of bytes other than blank and 0x09-0x0D.
WORD_BYTES = ~_SPACE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_random = np.random.default_rng(20240601)
_TABLES = _random.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLES_LOWER = _TABLES[:, _LOWER]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a multiplier and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        r = MULTIPLIERS[which]
        both = []
        for base in (r, pow(r, -1, 2**64)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = tuple(both)
        if size == 2 * CHUNK_BYTES:
            _powers[which] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Chunk:
    """Texts first..first+len(offsets)-2 of a batch: their bytes, and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a column of texts into chunks of at most `limit` bytes, or one longer text. Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Chunk(lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def word_spans(chunk: Chunk, word_bytes: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    inside = word_bytes[chunk.data]
    edge = inside.copy()
    edge[1:] &= ~inside[:-1]
    cut = chunk.offsets[:-1][chunk.offsets[:-1] < len(inside)]
    edge[cut] = inside[cut]
    starts = np.flatnonzero(edge)
    edge = inside.copy()
    edge[:-1] &= ~inside[1:]
    cut = chunk.offsets[1:] - 1
    cut = cut[cut >= 0]
    edge[cut] = inside[cut]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, chunk.offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each span of bytes; lower: A-Z count as a-z."""
    up, down = powers(which, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLES_LOWER if lower else _TABLES)[which][data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(MULTIPLIERS[1 - which]))


class Rolling:
    """Hashes of any run of consecutive values, by prefix sums."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = powers(which, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def window_starts(word_offsets: np.ndarray, length: int) -> np.ndarray:
    """Indices of the words at which a window of `length` words of one text begins."""
    ends = np.repeat(word_offsets[1:], np.diff(word_offsets))
    at = np.arange(len(ends))
    return at[at + length <= ends]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as signed 64-bit integers, as Spark's long holds them."""
    return h.view(np.int64)


def text_hashes(chunk: Chunk) -> np.ndarray:
    """One 64-bit hash of each whole text."""
    return span_hashes(chunk.data, chunk.offsets[:-1], chunk.offsets[1:])
