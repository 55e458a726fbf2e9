"""Word and window hashes of whole Arrow text columns, in numpy, without a Python step for each word.

A word's hash is a polynomial over its bytes modulo 2**64 with an odd base,
taken from one running sum over the whole buffer, and then mixed; a window's
hash is the same over word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Bytes handled at once; a longer text is handled alone.
CHUNK = 2 << 20
#: Bytes of text and rows of a part of a batch; a longer text is a part alone.
PART, PART_ROWS = 1 << 20, 512
BYTE_BASE, WORD_BASE, SECOND_BASE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_bytes, _words, _second = _Powers(BYTE_BASE), _Powers(WORD_BASE), _Powers(SECOND_BASE)


def parts(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    """`batch` in runs of rows with little text, so that what a task makes of them doesn't grow with a batch."""
    ends = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < len(ends):
        room = (ends[row - 1] if row else 0) + PART
        end = min(max(row + 1, int(np.searchsorted(ends, room, "right"))), row + PART_ROWS)
        yield batch.slice(row, end - row)
        row = end


def chunks(column: pa.Array, separators: np.ndarray = _SPACE, fold: np.ndarray | None = None, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows of a string column: (first row, word hashes, where each row's words begin, with the end last).

    `separators` tells which bytes part words; `fold` replaces bytes before hashing;
    `size` bytes are handled at once, and about 60 bytes held for each of them.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        text, bounds = data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        yield row, *_hash_words(text if fold is None else fold[text], bounds, separators)
        row = end


def _hash_words(text: np.ndarray, bounds: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(text) + 2, bool)
    np.logical_not(separators[text], out=inside[1:-1])
    begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(text))]
    begin[cuts] |= inside[1:-1][cuts]
    end[cuts - 1] |= inside[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _bytes(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_LETTER[text] * up[: len(text)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), np.searchsorted(starts, bounds)


def windows(hashes: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """The hash of each `size` words in a row. Windows may cross rows; see `within`."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = (_second if second else _words)(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum((mix(hashes ^ _U(0x5851F42D4C957F2D)) if second else hashes) * up[: len(hashes)], out=sums[1:])
    return mix((sums[size:] - sums[:n]) * down[:n])


def within(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n windows lie within one row."""
    rows = np.searchsorted(bounds, np.arange(n), "right") - 1
    return np.arange(n) + size <= bounds[rows + 1]
