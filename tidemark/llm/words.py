"""Words, word hashes and window hashes of many texts at once, as numpy arrays.

Texts are taken as one byte buffer with offsets, the way Arrow holds them, so
no Python object is made per word.
"""

from __future__ import annotations

import contextlib
import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _BASE_INV = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_STEP, _STEP_INV = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 2**64))

#: Bytes that belong to words, by kind; 0x80 and above are parts of UTF-8 characters.
SPACED = np.array([b not in (0x20, 9, 10, 11, 12, 13) for b in range(256)])
ALNUM = np.array([b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.empty(size, U)
    out[0] = 1
    done = 1
    while done < size:  # doubling: each pass multiplies what is there
        n = min(done, size - done)
        out[done : done + n] = out[:n] * U(pow(base, done, 2**64))
        done += n
    return out


def powers(base: np.uint64, n: int) -> np.ndarray:
    return _powers(int(base), 1 << max(16, int(n).bit_length()))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end), in bytes and words."""
    is_word = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | edge[1:-1]
    ends = is_word
    ends = np.append(ends[:-1] & (~ends[1:] | edge[1:-1]), ends[-1:]) if len(data) else ends
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(_BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(_BASE_INV, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(U) * U(0x9FB21C651E98DF25))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` words from each word on, across texts too; as many as fit."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = np.zeros(len(words) + 1, U)
    np.cumsum(words * powers(_STEP, len(words)), out=sums[1:])
    return mix((sums[size:] - sums[:n]) * powers(_STEP_INV, n) + U(size))


def window_starts(firsts: np.ndarray, size: int) -> np.ndarray:
    """Words at which a whole window of one text begins; firsts: from word_spans."""
    counts = np.maximum(np.diff(firsts) - size + 1, 0)
    begin = np.repeat(firsts[:-1], counts)
    return begin + (np.arange(len(begin)) - np.repeat(np.cumsum(counts) - counts, counts))


def batches(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20):
    """(first text, last text + 1) of runs of texts of about `size` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def release() -> None:
    """Give freed memory back to the system: a worker that has done a large group keeps none of it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def pack(values: np.ndarray) -> bytes:
    """Bytes of ascending unsigned values: differences, one byte plane after another, so that what compresses lies together."""
    v = np.asarray(values, U)
    d = np.diff(v, prepend=U(0))
    return d.view(np.uint8).reshape(len(d), 8).T.tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, n).T).view(U).reshape(n), dtype=U)


def planes(values: np.ndarray) -> bytes:
    """Bytes of unsigned 32-bit values in any order, by byte planes."""
    v = np.ascontiguousarray(values, np.uint32)
    return v.view(np.uint8).reshape(len(v), 4).T.tobytes()


def unplanes(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, n).T).view(np.uint32).reshape(n)


def pack_any(values: np.ndarray) -> bytes:
    """Bytes of values below 2**64 in any order, by byte planes."""
    v = np.ascontiguousarray(values).astype(U)
    return v.view(np.uint8).reshape(len(v), 8).T.tobytes()


def unpack_any(blob: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, n).T).view(np.int64).reshape(n)
