"""Whole texts as arrays of token codes, one Arrow batch at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 0x20
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def white_table(lower: bool = True) -> np.ndarray:
    """Byte map: ASCII white space becomes a space, A-Z become a-z if ``lower``."""
    table = np.arange(256, dtype=np.uint8)
    table[list(WHITE)] = SPACE
    if lower:
        table[0x41:0x5B] += 0x20
    return table


def alnum_table() -> np.ndarray:
    """Byte map: A-Z become a-z; all ASCII but digits and letters becomes a space."""
    table = white_table()
    for b in range(0x80):
        if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A):
            table[b] = SPACE
    return table


class Tokens(NamedTuple):
    """Tokens of a batch: ``codes[ends[i-1]:ends[i]]`` are document ``i``'s."""

    codes: np.ndarray  # int32, index into words
    words: pa.Array  # the distinct tokens
    starts: np.ndarray  # int64, one more than the documents


_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # fixed values: parameters of glibc's mallopt


@cache
def frugal() -> None:
    """Have this Python worker hand freed arrays back to the system, once per process.

    Workers outlive their tasks; what they hold lies beside the executor's heap
    while later stages run. Without glibc nothing is set.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_MMAP_THRESHOLD, 2 << 20)
        libc.mallopt(_TRIM_THRESHOLD, 8 << 20)
    except (OSError, AttributeError):
        pass


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``max_bytes`` of ``column`` (one row at least)."""
    frugal()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, side="right"))
            to = max(at + 1, to)
            yield batch.slice(at, to - at)
            at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its offsets from 0; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts, pa.array([], pa.large_string())])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def tokenise(texts: pa.Array, table: np.ndarray) -> Tokens:
    """Map the bytes by ``table``, split at spaces and number the distinct tokens."""
    data, offsets = raw(texts)
    n = len(offsets) - 1
    mapped = pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(table[data]))
    parts = pc.ascii_split_whitespace(mapped)
    flat = parts.flatten()
    ends = parts.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:  # white space at either end leaves an empty part
        before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        flat, ends = flat.filter(full), before[ends]
    coded = pc.dictionary_encode(flat)
    return Tokens(coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary, ends - ends[0])


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, the same in every batch and process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


_BYTES, _BASE = mixed(np.arange(1, 257, dtype=np.uint64)), np.uint64(0x9E3779B97F4A7C15)


def byte_hashes(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each text (a null is empty), the same in every batch and process: a polynomial of its bytes, mixed."""
    data, offsets = raw(values)
    size = np.diff(offsets)
    powers = np.full(int(size.max()) + 1 if len(size) else 1, _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers[np.arange(len(data)) - np.repeat(offsets[:-1], size)], out=sums[1:])
    return mixed(sums[offsets[1:]] - sums[offsets[:-1]] + size.astype(np.uint64) * _BYTES[0])


def prefix_hashes(symbols: np.ndarray, back: np.ndarray) -> np.ndarray:
    """A 64-bit hash, for each symbol (0 to 256), of those before it in its word; ``back`` of them."""
    powers = np.full(int(back.max()) + 1 if len(back) else 1, _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(_BYTES[symbols & 255] * powers[back], out=sums[1:])
    at = np.arange(len(symbols))
    return mixed(sums[at] - sums[at - back] + back.astype(np.uint64) * _BYTES[0])


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenate ``values[s : s + n]`` for each pair of ``starts`` and ``lengths``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
