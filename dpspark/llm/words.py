"""Words of whole texts as arrays: numpy over the UTF-8 bytes of an Arrow batch.

A batch is cut into chunks of about ``CHUNK`` bytes (one text at least), so the
memory a task needs does not depend on the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_U = np.uint64
_ROOT = _U(0x9E3779B97F4A7C15)
_powers = np.ones(1, _U)

#: Bytes that end a word: ASCII white space only, or all of ASCII but letters and digits.
SPACES = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * n, _ROOT)]), dtype=_U)
    return _powers


@dataclass
class Words:
    """hash, start, end: by word, in bytes of ``data``; first: by text, its first word (one more at the end)."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(texts: pa.Array, ends: np.ndarray = SPACES, lower: bool = True) -> Words:
    data, offsets = _flat(texts)
    low = LOWER[data] if lower else data
    inside = ~ends[low]
    begins = inside.copy()
    if len(low):
        begins[1:] &= ~inside[:-1]
        cuts = offsets[:-1][offsets[:-1] < len(low)]
        begins[cuts] = inside[cuts]
    at = np.flatnonzero(inside)
    new = begins[at]
    lead = np.flatnonzero(new)
    start = at[lead]
    length = np.diff(np.append(lead, len(at)))
    if len(start):
        place = np.arange(len(at)) - np.repeat(lead, length)
        part = (low[at].astype(_U) + _U(1)) * powers(int(length.max()))[place]
        hashed = mix(np.add.reduceat(part, lead) ^ length.astype(_U))
    else:
        hashed = np.empty(0, _U)
    return Words(hashed, start, start + length, np.searchsorted(start, offsets), data, offsets)


def chunks(batch: pa.RecordBatch, text: str = "text") -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False)
    mark = np.cumsum(sizes) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
    # a worker lives on after its task: what it doesn't use goes back
    pa.default_memory_pool().release_unused()


def runs(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k successive words in one text, and the word at which each starts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    total = np.zeros(n, _U)
    for j in range(k):
        total = (total + hashes[j : j + n]) * _ROOT
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:n] == text[k - 1 :])
    return mix(total[at]), at
