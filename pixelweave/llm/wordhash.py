"""Words of many texts at once, as NumPy arrays.

A word is a run of bytes other than the six ASCII spaces. Its 64-bit hash is a
polynomial over a table of random byte values, so the hashes of all words of a
slice of texts come from a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_GOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[SPACE] = 0
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit (splitmix)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers of an odd base, and those of its inverse."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _UNBASE)):
            p = np.full(1 << (n - 1).bit_length(), b)  # as many as are asked for, doubling: each worker keeps them
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1]


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, each followed by a space
    text_at: np.ndarray  # where each text begins in data, and the end
    start: np.ndarray  # of each word
    end: np.ndarray
    text: np.ndarray  # the text of each word
    hash: np.ndarray
    counts: np.ndarray  # words of each text
    first: np.ndarray  # first word of each text


def words(texts: list[bytes]) -> Words:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    space = SPACE[data]
    edge = np.diff(space.view(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) > len(start):
        end = end[-len(start) :] if len(start) else end[:0]
    power, inverse = powers(len(data))
    h = np.add.reduceat(_BYTE[data] * power, start) * inverse[start] if len(start) else np.zeros(0, np.uint64)
    text = np.searchsorted(at, start, "right") - 1
    counts = np.bincount(text, minlength=len(texts))[: len(texts)]
    return Words(data, at, start, end, text, mix(h), counts, np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64))


def slices(column: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows with about ``SLICE`` bytes of text, so memory follows the longest text and not the batch."""
    first, size, held = 0, 0, []
    for i, t in enumerate(column):
        b = t.as_py() or b""
        held.append(b)
        size += len(b)
        if size >= SLICE:
            yield first, i + 1, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, len(column), held


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``k`` words; a text of fewer words has one shingle of them all, one of none has none."""
    n = len(w.hash)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    out_text, out_hash = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= k:
        whole = w.text[: n - k + 1] == w.text[k - 1 :]
        h = sum(w.hash[j : n - k + 1 + j] * weights[j] for j in range(k))
        out_text, out_hash = w.text[: n - k + 1][whole], mix(h[whole])
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(few):
        short = np.array([np.sum(w.hash[w.first[t] : w.first[t] + w.counts[t]] * weights[: w.counts[t]]) + np.uint64(w.counts[t]) for t in few], np.uint64)
        out_text, out_hash = np.concatenate([out_text, few]), np.concatenate([out_hash, mix(short)])
    return out_text, out_hash
