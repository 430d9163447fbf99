"""Whole texts as arrays of words, batch by batch.

A word is a run of characters other than the six ASCII blanks, with A-Z in
lower case.  Everything here runs inside a task on one Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once inside a task; a longer text is handled alone.
SLICE = 4 << 20


def give_back() -> None:
    """Return freed memory to the machine: workers outlive their tasks, and many share an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of *batches* in pieces of about *limit* bytes of *column*."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def whole(texts: pa.Array, lower: bool = True) -> pa.Array:
    """*texts* without nulls, A-Z in lower case if asked, in buffers of their own.

    The copy matters: kernels that change bytes may misread a slice of larger buffers.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    return pc.ascii_lower(texts) if lower else texts


def split(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """``(offsets, codes, vocabulary)``: row *i* has ``codes[offsets[i]:offsets[i + 1]]``."""
    parts = pc.ascii_split_whitespace(whole(texts, lower))
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets, codes, vocabulary = offsets - offsets[0], flat.indices.to_numpy(), flat.dictionary
    empty = pc.index(vocabulary, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:  # blanks at either end of a text leave an empty piece
        kept = codes != empty
        offsets = np.concatenate(([0], np.cumsum(kept)))[offsets]
        codes = codes[kept]
    return offsets, codes.astype(np.int64), vocabulary


def hashes(vocabulary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in vocabulary.to_pylist()), np.uint64, len(vocabulary))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The hash of a sequence extended by one element."""
    return mix(first * np.uint64(0x9E3779B97F4A7C15) + second + np.uint64(1))


def shingles(offsets: np.ndarray, tokens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, hash)`` of every run of *width* tokens; a shorter row is one run, an empty one none."""
    counts = np.diff(offsets)
    at_end = np.repeat(offsets[1:], counts) - np.arange(len(tokens))
    start = np.flatnonzero(at_end >= width)
    rows = np.repeat(np.arange(len(counts)), counts)
    value = mix(tokens[start] + np.uint64(width))
    for k in range(1, width):
        value = chain(value, tokens[start + k])
    short = np.flatnonzero((counts > 0) & (counts < width))
    begin, n = offsets[short], counts[short]
    alone = mix(tokens[begin] + n.astype(np.uint64))
    for k in range(1, width - 1):
        on = n > k
        alone[on] = chain(alone[on], tokens[begin[on] + k])
    row, value = np.concatenate((rows[start], short)), np.concatenate((value, alone))
    return row, value
