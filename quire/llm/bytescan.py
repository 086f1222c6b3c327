"""Words of many texts at once, on the UTF-8 bytes of an Arrow column, without a Python string per word.

A batch of texts is cut into blocks of a few MB (a longer text is a block of its own), so that working arrays stay
small whatever the batch holds. Words are named by 64-bit hashes: a polynomial over the word's bytes, mixed.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        more = min(have, n - have)
        out[have : have + more] = out[:more] * step
        have += more
    return out


_POWER_CHUNK = 1 << 16
_UP = _powers(_BASE, _POWER_CHUNK)
_DOWN = _powers(_INVERSE, _POWER_CHUNK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    return mix(left * np.uint64(0x9FB21C651E98DF25) + np.uint64(0x632BE59BD9B4E019) ^ right)


def table_of(spec: bytes) -> np.ndarray:
    """Truth table over byte values."""
    out = np.zeros(256, bool)
    out[np.frombuffer(spec, np.uint8)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x20\x09-\x0D]+`; bytes of characters beyond ASCII are word bytes in either class.
NOT_SPACE = ~table_of(b" \t\n\x0b\x0c\r")
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
ALNUM = table_of(bytes([*range(48, 58), *range(97, 123), *range(128, 256)]))


@dataclass
class Block:
    """Texts ``first`` to ``last`` (exclusive) of a batch: their bytes and where each begins (one more at the end)."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray


@dataclass
class Words:
    start: np.ndarray  # in the block's bytes
    end: np.ndarray
    doc: np.ndarray  # index of the text within the block
    name: np.ndarray  # uint64
    first: np.ndarray  # for each text, its first word; one more at the end


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` that gives its freed memory back to the system when it ends: workers live on between tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return run


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds (int64, one more than texts) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, bounds


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    data, bounds = text_buffers(column)
    n, i = len(bounds) - 1, 0
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        lo, hi = bounds[i], bounds[j]
        yield Block(i, j, data[lo:hi], bounds[i : j + 1] - lo)
        i = j


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name for each span of bytes; spans ascend and don't overlap."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    # positions restart every half power chunk, so that the powers fit a table; a longer span is hashed in pieces
    half = _POWER_CHUNK // 2
    lo = 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, base + _POWER_CHUNK, "right")))
        if end[lo] - base > _POWER_CHUNK:
            total = np.uint64(0)
            for at in range(base, int(end[lo]), half):
                piece = data[at : min(at + half, int(end[lo]))].astype(np.uint64) + np.uint64(1)
                total = mix(np.array([total]) ^ np.array([(piece * _UP[: len(piece)]).sum()]))[0]
            out[lo] = total
            lo += 1
            continue
        stop = int(end[hi - 1])
        sums = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + np.uint64(1)) * _UP[: stop - base], out=sums[1:])
        s, e = start[lo:hi] - base, end[lo:hi] - base
        out[lo:hi] = mix((sums[e] - sums[s]) * _DOWN[s] ^ (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        lo = hi
    return out


def words(block: Block, word_byte: np.ndarray, lower: bool = True, split: np.ndarray | None = None) -> Words:
    """The words of a block: maximal runs of ``word_byte`` bytes within a text, cut further between bytes of classes 1
    and 2 of ``split`` if that is given."""
    data = LOWER[block.data] if lower else block.data
    n = len(data)
    docs = len(block.bounds) - 1
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(docs + 1, np.int64))
    inside = word_byte[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    if split is not None:
        kind = split[data]
        cut = np.flatnonzero(kind[1:] + kind[:-1] == 3)
        finish[cut] = True
        begin[cut + 1] = True
    edges = block.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begin[edges] = inside[edges]
    finish[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    first = np.searchsorted(start, block.bounds)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(start, end, doc, span_hash(data, start, end), first)
