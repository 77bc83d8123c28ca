"""Periodic runs of words, by internal pattern matching.

A run with period p and at least 2p words holds an aligned block of m words, m a power of two of about p / 2, together with the block's copy p words
later. So for each block it is enough to know where it occurs again in a window that begins about 2m words behind it:

1. the words of a text are ranked, and the ranks doubled to 1, 2, 4, ... words, which ends in a suffix array; the suffixes that
   begin like a block are an interval of it;
2. a wavelet tree over the suffix array finds the next occurrence at or behind a place, and counts those up to another;
3. occurrences whose starts lie within m words form an arithmetic progression, so the first two and their number name them all. Each
   one's distance is a candidate period. A progression in the same run of a shorter period as the block itself has none but that;
4. a candidate is extended to both sides with the ranks of 1, 2, 4, ... words, which decide equality exactly. Of the candidates with one stretch, the
   least is its period.

Texts are taken together in slices of about a megabyte, and words of different texts are never equal. Words are known by 64-bit hashes.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbraid.llm.arrow_text import column_bytes, expand, mix, prefix_hash, range_hash, slices, tidy_map
from logbraid.llm.shingles import words_of

SCHEMA = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, "
    "runs array<struct<start:long,length:long,period:long>>, collapsed string"
)
#: Words whose bytes are gathered at a time.
GATHER = 1 << 17
#: Candidates that are extended at a time.
CANDIDATES = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class RangeSuccessor:
    """A wavelet tree (its levels one below the other, as bits) over numbers from 0 to `top` - 1."""

    def __init__(self, values: np.ndarray, top: int):
        self.top, self.levels = top, []
        for shift in range(top.bit_length() - 1, -1, -1):
            one = (values >> shift & 1).astype(bool)
            packed = np.zeros((len(values) >> 6) + 1, np.uint64)
            raw = np.packbits(one, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            ones = np.bitwise_count(packed).astype(np.int32)
            before = np.cumsum(ones, dtype=np.int32) - ones
            self.levels.append((shift, packed, before, len(values) - int(ones.sum())))
            values = np.concatenate([values[~one], values[one]])

    @staticmethod
    def _ones(packed: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[block] + np.bitwise_count(packed[block] & ((np.uint64(1) << bit) - np.uint64(1)))

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many of the values at low:high are less than x."""
        x = np.minimum(x, self.top)
        count = np.zeros(len(low), np.int64)
        for shift, packed, before, zeros in self.levels:
            one = (x >> shift & 1).astype(bool)
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            count += np.where(one, high - b - low + a, 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return count

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k among those at low:high; with k = below(low, high, x) it is the successor of x."""
        value = np.zeros(len(low), np.int64)
        for shift, packed, before, zeros in self.levels:
            a, b = self._ones(packed, before, low), self._ones(packed, before, high)
            left = high - b - low + a
            one = k >= left
            value += one.astype(np.int64) << shift
            k = np.where(one, k - left, k)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return value


class Factors:
    """Ranks of the factors of 1, 2, 4, ... words until all differ, the suffix array, and per length the blocks that come more than once.

    `symbols` differ for words of different texts; text i has the words at[i]:at[i + 1].
    """

    def __init__(self, symbols: np.ndarray, at: np.ndarray):
        n = len(symbols)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        end, inside = at[1:][text], np.arange(n) - at[:-1][text]
        self.ranks: list[np.ndarray] = []
        #: Per length: first word, and interval in the suffix array.
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.suffixes = np.argsort(symbols)
        slots, key = np.arange(n), symbols[self.suffixes]
        rank = np.full(n + 1, -1, np.int32)
        size = 1
        while True:
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(slots)))
            first = np.repeat(slots[starts], sizes)
            places = self.suffixes[slots]
            rank[places] = first
            self.ranks.append(rank.copy())
            several = np.repeat(sizes > 1, sizes)
            slots, places, first = slots[several], places[several], first[several]
            aligned = inside[places] % size == 0
            self.blocks.append((places[aligned], first[aligned], (first + np.repeat(sizes, sizes)[several])[aligned]))
            if not len(slots):
                return
            behind = np.where(places + size < end[places], rank[np.minimum(places + size, n)], -1).astype(np.int64)
            key = first * (n + 1) + behind + 1
            order = np.argsort(key)
            self.suffixes[slots] = places[order]
            key = key[order]
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j on; i < j."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.ranks) - 1, -1, -1):
            same = (self.ranks[level][i] == self.ranks[level][j]).astype(np.int64) << level
            i, j = i + same, j + same
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words before i and j; i < j."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.ranks) - 1, -1, -1):
            size = 1 << level
            there = i >= size
            same = there & (self.ranks[level][np.where(there, i - size, 0)] == self.ranks[level][np.where(there, j - size, 1)])
            i, j = i - size * same, j - size * same
        return start - i


def _windows(level: int, longest: int, min_length: int) -> list[tuple[int, int]]:
    """Distances (from, to) behind a block of 2^level words at which its copies are looked for, in parts of at most 2^level.

    Period p belongs to the largest block of which any run of max(min_length, 2p) words holds an aligned one with its copy.
    """
    m = 1 << level
    fits = lambda p, size: 2 * size - 1 <= max(min_length - p, p)
    mine = [p for p in range(1, min(longest // 2, max(min_length, 4 * m)) + 1) if fits(p, m) and not fits(p, 2 * m)]
    parts: list[tuple[int, int]] = []
    for p in mine:
        if parts and parts[-1][1] == p and p - parts[-1][0] < m:
            parts[-1] = (parts[-1][0], p + 1)
        else:
            parts.append((p, p + 1))
    return parts


def _candidates(factors: Factors, tree: RangeSuccessor, longest: int, min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first word of a block, distance of a copy)"""
    for level, (block, low, high) in enumerate(factors.blocks):
        m = 1 << level
        for near, far in _windows(level, longest, min_length) if len(block) else ():
            before = tree.below(low, high, block + near)
            count = tree.below(low, high, block + far) - before
            some = count > 0
            b, l, h, k, c = (x[some] for x in (block, low, high, before, count))
            first = tree.kth(l, h, k)
            step = np.zeros(len(b), np.int64)
            several = c > 1
            step[several] = tree.kth(l[several], h[several], k[several] + 1) - first[several]
            many = np.flatnonzero(c > 2)
            reach = step[many] + factors.forward(b[many], b[many] + step[many])
            inner = many[b[many] + reach >= first[many] + m]
            # Inside one run of a shorter period all distances are multiples of it; at most the first is that period itself.
            c[inner] = first[inner] - b[inner] == step[inner]
            keep = c > 0
            b, c, first, step = b[keep], c[keep], first[keep], step[keep]
            ends = np.cumsum(c)
            at = 0
            while at < len(b):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
                part = slice(at, stop)
                nth = expand(np.zeros(stop - at, np.int64), c[part])
                yield np.repeat(b[part], c[part]), np.repeat(first[part] - b[part], c[part]) + nth * np.repeat(step[part], c[part])
                at = stop


def runs_of_words(symbols: np.ndarray, at: np.ndarray, min_length: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs, by start and period; starts count over all texts.

    `symbols` are unsigned 64-bit values for the words; text i has those at[i]:at[i + 1].
    """
    none = np.zeros(0, np.int64)
    longest = int(np.diff(at).max(initial=0))
    if longest < 2:
        return none, none, none
    text = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    factors = Factors(mix(symbols ^ mix(text + np.uint64(1))), at)
    tree = RangeSuccessor(factors.suffixes, len(symbols))
    found = [(none, none, none)]
    for block, distance in _candidates(factors, tree, longest, min_length):
        start = block - factors.backward(block, block + distance)
        length = block + distance + factors.forward(block, block + distance) - start
        ok = length >= np.maximum(min_length, 2 * distance)
        kept = np.unique(np.stack([start[ok], length[ok], distance[ok]]), axis=1)
        found.append(tuple(kept))
    start, length, period = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[least], length[least], period[least]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _joined(data: np.ndarray, first: np.ndarray, last: np.ndarray, texts: np.ndarray, n_texts: int) -> pa.Array:
    """The words data[first:last] of each text with one space between them; `texts` (ascending) has the text of each word."""
    size = last - first + 1
    final = np.ones(len(first), bool)
    final[:-1] = texts[1:] != texts[:-1]
    size[final] -= 1
    lengths = np.zeros(n_texts, np.int64)
    np.add.at(lengths, texts, size)
    padded = np.append(data, np.uint8(0x20))
    out = []
    for a in range(0, len(first), GATHER):
        part = slice(a, a + GATHER)
        piece = padded[expand(first[part], size[part])]
        piece[(np.cumsum(size[part]) - 1)[~final[part]]] = 0x20
        out.append(piece)
    raw = np.concatenate(out) if out else np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.LargeStringArray.from_buffers(n_texts, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def _map_runs(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = column_bytes(part.column("text"))
                first, last, at = words_of(data, offsets)
                symbols = range_hash(prefix_hash(data), first, last)
                start, length, period = runs_of_words(symbols, at, min_length)
                n_texts, n_words = len(at) - 1, np.diff(at)
                text = np.searchsorted(at, start, "right") - 1
                # Words that a run holds behind its first period go.
                change = np.zeros(len(first) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                word_text = np.repeat(np.arange(n_texts), n_words)
                collapsed = _joined(data, first[kept], last[kept], word_text[kept], n_texts)
                start = start - at[text]
                n_runs = np.bincount(text, minlength=n_texts)
                ends = np.concatenate([[0], np.cumsum(n_runs)])
                order = np.lexsort((period, start, -length, text))
                some = n_runs > 0
                best = np.zeros(n_texts, np.int64)
                best[some] = order[ends[:-1][some]]
                longest = [pa.array(c[best] if len(c) else best, mask=~some) for c in (start, length, period)]
                runs = pa.StructArray.from_arrays([pa.array(c) for c in (start, length, period)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words), pa.array(n_runs), *longest, lists, collapsed],
                    ["doc_id", "n_words", "n_runs", "start", "length", "period", "runs", "collapsed"],
                )

    return run


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, runs, collapsed): one row per row of docs(doc_id, text).

    A run is a stretch of words with smallest period q and at least max(min_length, 2q) words that no neighbouring word extends. `runs` are all of them by start,
    then period; words count from 0. start, length and period are those of the longest (then first, then least period), null without a run. `collapsed` is
    the text without the words that a run holds behind its first q words, joined by one space. Words are what is between ASCII white space.

    A null or empty text has no words and an empty `collapsed`. Repeated rows come out repeated, a null doc_id stays null, an empty table gives no rows; other
    columns are ignored. Memory follows the longest text: some 100 bytes a word, and 4 more for each doubling that its longest repeat needs.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tidy_map(_map_runs(min_length)), SCHEMA)
