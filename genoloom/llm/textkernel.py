"""Vectorised word splitting and hashing over Arrow string columns.

The kernels work on UTF-8 bytes in numpy: one pass marks word bytes, a prefix
sum of a polynomial gives every word a 64-bit hash, and n-gram hashes are made
from word hashes by doubling.  Nothing here depends on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
#: Bytes of text that a kernel works on at once; its arrays take some 30 times as much.
CHUNK_BYTES = 2 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _values(lower: bool) -> np.ndarray:
    lut = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    if lower:
        lut[65:91] = lut[97:123]
    return lut


def _word_bytes(separators: list[tuple[int, int]]) -> np.ndarray:
    lut = np.ones(256, dtype=bool)
    for low, high in separators:
        lut[low : high + 1] = False
    return lut


#: Words between spaces and the controls 0x09-0x0D.
SPACED = _word_bytes([(0x20, 0x20), (0x09, 0x0D)])
#: Words of digits, a-z and non-ASCII bytes; A-Z counts as a-z.
ALNUM = _word_bytes([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
EXACT, LOWER = _values(False), _values(True)

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and grown when asked for more."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        have = _powers[base] = np.cumprod(table)
        if size > 2 * CHUNK_BYTES:
            _powers.pop(base)
    return have[:n]


def string_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of blocks of whole texts; null is empty.

    A block holds at most ``limit`` bytes, or one text that is longer.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a block: starts, ends (bytes), doc (text index), first (per text, first word index)."""

    __slots__ = ("doc", "ends", "first", "starts", "hash")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, values: np.ndarray | None):
        n = len(offsets) - 1
        inside = kind[data]
        if not len(data):
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[offsets] = True
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | edge[1:-1]
            stops = inside.copy()
            stops[:-1] &= ~inside[1:] | edge[1:-1]
            self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        self.hash = None
        if values is not None:
            if len(data):
                total = values[data]
                total *= _power_table(_BASE, len(data))
                np.cumsum(total, out=total)
                h = total[self.ends - 1]
                h[self.starts > 0] -= total[self.starts[self.starts > 0] - 1]
                h *= _power_table(_BASE_INV, len(data))[self.starts]
                self.hash = mix64(h)
            else:
                self.hash = np.zeros(0, np.uint64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for i in 0..len(h)-n, whatever texts those words are of."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    done, out = 0, np.zeros(len(h) - n + 1, np.uint64)
    power, size, bit = h, 1, n
    while bit:
        if bit & 1:
            part = power[done : done + len(out)]
            out += part * np.uint64(pow(int(_STEP), done, 1 << 64))
            done += size
        bit >>= 1
        if bit:
            power = power[:-size] + power[size:] * np.uint64(pow(int(_STEP), size, 1 << 64))
            size *= 2
    return mix64(out ^ np.uint64(n))


def inside_one_text(words: Words, n: int) -> np.ndarray:
    """Indices i whose n words from i on are all of one text."""
    ends = words.first[1:][words.doc]
    return np.flatnonzero(np.arange(len(words.doc)) + n <= ends)


def ordered(high: np.ndarray, end: int, h: np.ndarray) -> np.ndarray:
    """np.lexsort((h, high)) for high from 0 to before end, equal pairs in any order: one sort by what fits into 64 bits, then those that tie in it."""
    bits = np.uint64(max(end, 2).bit_length())
    key = (high.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    if same.any():
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        at = order[tied]
        order[tied] = at[np.lexsort((h[at], key[tied]))]
    return order


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width], by doubling."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
