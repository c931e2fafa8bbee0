"""Numpy kernels over the bytes of many texts at once.

Spark hands texts over in Arrow batches, whose strings lie end to end in one
buffer. Words are found, hashed and counted there with array operations; no
Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in one go; a longer text goes alone.
CHUNK = 2 << 20

U64 = np.uint64
#: Bases of two hashes that have nothing in common.
_BASES = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Space and the five controls from tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All but digits, lower-case letters and bytes of characters beyond ASCII.
NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A base's powers from 0 to n - 1, and their inverses, modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        size, base = max(n, 1 << 16), _BASES[which]
        up, down = np.full(size, base, U64), np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        _powers[which] = (np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64))
    up, down = _powers[which]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about size bytes of text each."""
    for batch in batches:
        lengths = np.asarray(pc.binary_length(batch.column(column)).fill_null(0))
        ends = np.cumsum(lengths)
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + size, side="right"))
            j = max(j, i + 1)
            yield batch.slice(i, j - i)
            i = j


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more than texts). Null: empty."""
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words before each text (one more than texts)."""
    word = ~separators[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span; which: one of two that are independent."""
    up, down = powers(len(values) + 1, which)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + U64(which))


def windows(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of width words inside one text, and the position of its first word."""
    at = np.arange(max(len(hashes) - width + 1, 0))
    owner_end = np.repeat(offsets[1:], np.diff(offsets))
    at = at[at + width <= owner_end[: len(at)]]
    return span_hashes(hashes, at, at + width), at


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text that each item belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each text."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about size bytes of text, joined where they are smaller."""
    held: list[pa.RecordBatch] = []
    full = 0
    for part in chunks(batches, column, size):
        length = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if held and full + length > size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, full = [], 0
        held.append(part)
        full += length
    if held and (joined := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield joined[0]
