"""Vectorised text kernels over Arrow buffers: words, lines, shingles and rolling fingerprints.

All kernels work on the concatenated UTF-8 bytes of a bounded slice of rows, so that no Python loop runs per
word or per character. White space is space and U+0009..U+000D, all single bytes in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = np.asarray(x, dtype=U64)
    y = x >> U64(30)
    y ^= x
    y *= U64(0xBF58476D1CE4E5B9)
    z = y >> U64(27)
    y ^= z
    y *= U64(0x94D049BB133111EB)
    y ^= np.right_shift(y, U64(31), out=z if z.ndim else None)
    return y


def _byte_codes() -> np.ndarray:
    return mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))


CODES = _byte_codes()
CODES_LOWER = CODES[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            out = np.full(size, base, dtype=U64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


class Rolling:
    """Fingerprints of any byte range of a buffer in constant time, from one prefix sum."""

    def __init__(self, buf: np.ndarray, codes: np.ndarray = CODES):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=U64)
        np.cumsum(codes[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of the ranges [start, end), lengths included."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def joined(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Fingerprints of [a, b) followed by [c, d), as if nothing stood between."""
        up, _ = powers(len(self.sums))
        h = (self.sums[b] - self.sums[a]) * self.down[a] + (self.sums[d] - self.sums[c]) * self.down[c] * up[b - a]
        return mix(h + (b - a + d - c).astype(U64) * U64(0xD6E8FEB86659FD93))


def text_array(column) -> pa.Array:
    """One string array without nulls (null reads as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows, from 0."""
    n = len(column)
    if n == 0 or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows with at most ``most`` bytes of text (a longer row stands alone).

    Yields (rows, bytes, offsets). No text is cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = text_array(batch.column(batch.schema.get_field_index(column)))
        buf, offsets = text_buffers(text)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), buf[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of words before each row (a row pointer)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= SPACE[buf[:-1]] | edge[1:n]
    last = solid.copy()
    last[:-1] &= SPACE[buf[1:]] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of \\n-split lines (ends exclude the \\n), and a row pointer.

    A row has one line more than it has \\n, so an empty row has one empty line.
    """
    breaks = np.flatnonzero(buf == 10)
    rows = len(offsets) - 1
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    count = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    pointer = np.zeros(rows + 1, np.int64)
    np.cumsum(count, out=pointer[1:])
    return start, end, pointer


def row_of(pointer: np.ndarray) -> np.ndarray:
    """Row number of each element under a row pointer."""
    return np.repeat(np.arange(len(pointer) - 1), np.diff(pointer))


def shingles(hashes: np.ndarray, pointer: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words within each row; a shorter row with words gives one shingle.

    Returns (values, row pointer); values are not distinct.
    """
    count = np.diff(pointer)
    n = len(hashes)
    if not n:
        return hashes, pointer
    pieces = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out = np.zeros(len(pointer), np.int64)
    np.cumsum(pieces, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1] - pointer[:-1], pieces)
    left = np.repeat(count, pieces)
    value = mix(hashes[at])
    for k in range(1, width):
        here = np.minimum(at + k, n - 1)
        value = np.where(k < left, mix(value * U64(0x9E3779B97F4A7C15) + hashes[here] + U64(k)), value)
    return value, out


def distinct_sorted(values: np.ndarray, pointer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row, ascending."""
    rows = row_of(pointer)
    keep = np.zeros(len(values), dtype=bool)
    values = values.copy()
    for i in range(len(pointer) - 1):
        a, b = pointer[i], pointer[i + 1]
        if b > a:
            values[a:b].sort()
    if len(values):
        keep[0] = True
        keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    out = np.zeros(len(pointer), np.int64)
    np.cumsum(np.bincount(rows[keep], minlength=len(pointer) - 1), out=out[1:])
    return values[keep], out


def super_minhash(values: np.ndarray, pointer: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures (Ertl 2017) of each row's elements, as (rows, size) floats.

    Element e visits the components in the order of its own random permutation; at step j it offers the
    value r_j(e) + j, with r_j uniform in [0, 1). The ranks of an element are correlated across components, which lowers the
    variance of the estimate. A row stops as soon as its largest component is below j + 1, as no later step can lower any;
    rows with many elements end after one or two steps. Rows without elements keep infinity.
    """
    rows = len(pointer) - 1
    # values as integers until the end: the step's number above 48 bits of r
    sig = np.full(rows * size, 2**64 - 1, dtype=U64)
    owner, live = row_of(pointer), values
    for j in range(size):
        if not len(live):
            break
        rnd = mix(live + U64((seed * 0x9E3779B97F4A7C15 + j * 0xD1342543DE82EF95) & (2**64 - 1)))
        # the upper bits choose the component, the lower ones the value
        k = rnd >> U64(48)
        k *= U64(size - j)
        k >>= U64(16)
        k = k.view(np.int64)
        k += j
        rnd &= U64((1 << 48) - 1)
        rnd |= U64(j << 48)
        if j == 0:
            slot = k
        elif j == 1:
            slot = np.where(k == swapped, 0, k)
        else:
            # place j isn't visited again, so only place k changes
            slot = order[base + k].astype(np.int64)
            order[base + k] = order[base + j]
        np.minimum.at(sig, owner * size + slot, rnd)
        open_rows = sig.reshape(rows, size).max(axis=1) >= U64((j + 1) << 48)
        stay = slice(None) if open_rows.all() else open_rows[owner]
        if j <= 1:
            owner, live, k = owner[stay], live[stay], k[stay]
        if j == 0:
            swapped = k
        elif j == 1:
            # few rows are open after two steps, so permutations are written down from here on only
            swapped = swapped[stay]
            order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), len(live))
            base = np.arange(len(live)) * size
            order[base + swapped] = 0
            order[base + k] = order[base + 1]
        else:
            owner, live, base = owner[stay], live[stay], base[stay]
    out = sig.astype(np.float64)
    out *= 2.0**-48
    out[sig == U64(2**64 - 1)] = np.inf
    return out.reshape(rows, size)


def band_keys(sig: np.ndarray, rows_per_band: int) -> np.ndarray:
    """One 64-bit key per band of each signature, as (rows, bands); the band's number is part of the key."""
    bands = sig.shape[1] // rows_per_band
    bits = np.ascontiguousarray(sig).view(U64)[:, : bands * rows_per_band].reshape(len(sig), bands, rows_per_band)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(sig), bands))
    for j in range(rows_per_band):
        keys = mix(keys * U64(0x9E3779B97F4A7C15) + bits[:, :, j])
    return keys


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Four bits of a hash of every component, 16 components a word, as (rows, words): what two rows agree in tells about their similarity."""
    words = -(-sig.shape[1] // 16)
    bits = np.zeros((len(sig), words * 16), dtype=U64)
    bits[:, : sig.shape[1]] = mix(np.ascontiguousarray(sig).view(U64)) & U64(15)
    bits <<= np.tile(np.arange(0, 64, 4, dtype=U64), words)
    return np.bitwise_or.reduce(bits.reshape(len(sig), words, 16), axis=2)


def unpacked(column: pa.Array, words: int) -> np.ndarray:
    """Rows of 64-bit words, from bytes without nulls."""
    if not len(column):
        return np.zeros((0, words), np.int64)
    return np.frombuffer(column.buffers()[2], np.int64, len(column) * words, 8 * words * column.offset).reshape(-1, words)


def list_array(values: np.ndarray, pointer: np.ndarray) -> pa.Array:
    """A list<int64> column from flat 64-bit values and a row pointer."""
    return pa.ListArray.from_arrays(pa.array(pointer.astype(np.int32)), pa.array(values.view(np.int64)))
