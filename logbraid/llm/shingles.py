"""Sets of word shingles as 64-bit hashes, for functions that run inside tasks."""
from __future__ import annotations

import numpy as np

from logbraid.llm.arrow_text import expand, mix, prefix_hash, range_hash

#: White space is ASCII's; only A-Z change in lower case.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of the texts data[offsets[i]:offsets[i + 1]], and len + 1 offsets into the words."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    first = np.flatnonzero(start)
    return first, np.flatnonzero(end) + 1, np.searchsorted(first, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text in text order, and len + 1 offsets into them. A text of fewer words is one shingle, one of none has none."""
    data = LOWER[data] if lower else data
    first, last, at = words_of(data, offsets)
    words = range_hash(prefix_hash(data), first, last)
    n_words = np.diff(at)
    counts = np.where(n_words >= k, n_words - k + 1, n_words > 0)
    ends = np.concatenate([[0], np.cumsum(counts)])
    index = expand(at[:-1], counts)
    out = np.zeros(len(index), np.uint64)
    full = np.repeat(n_words >= k, counts)
    take = index[full]
    total = np.zeros(len(take), np.uint64)
    for j in range(k):
        total += words[take + j] * _FACTORS[j]
    out[full] = mix(total)
    for text in np.flatnonzero((n_words > 0) & (n_words < k)):
        own = words[at[text] : at[text + 1]]
        out[ends[text]] = mix((own * _FACTORS[: len(own)]).sum(keepdims=True) + np.uint64(len(own)))[0]
    return out, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, and len + 1 offsets into them."""
    hashes, ends = shingle_hashes(data, offsets, k)
    bounds = ends.tolist()
    for a, b in zip(bounds, bounds[1:]):
        if b - a > 1:
            hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[ends[:-1][np.diff(ends) > 0]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[ends]
