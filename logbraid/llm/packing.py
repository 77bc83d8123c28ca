"""Best-fit decreasing packing of tokenized documents into sequences of fixed capacity.

Pieces are tokenized once and written with their length and their number among the pieces of that length in
the same task. Best-fit decreasing only sees lengths, so it runs over the histogram of lengths, which has at most
`capacity` rows for any input: a segment tree over the remaining capacities finds the tightest open sequences in
logarithmic time, and all sequences with that capacity take as many pieces as fit at once, as the one-by-one
walk would do. Its result is a list of ranges of pieces, whose number the capacity bounds too. The place of each
piece follows from its rank among the pieces of its length: a number per task and length, plus the pieces of that length in earlier tasks.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logbraid.llm.arrow_text import slices, tidy_map
from logbraid.session import new_folder

CACHED_WORDS = 300_000
#: Lower-case letters of Latin-1, which no normalization changes, and a tail of ASCII punctuation.
_WORD_AND_TAIL = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:;=-@\[-`{-~]+)")
#: Letters of this many words are encoded in one call.
JOINED = 2_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, seq long"


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer, one for plain words, which tokens end a word, and the ids of words seen so far."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    # Words of lower-case letters need no normalization, and white space alone splits them.
    plain.normalizer = None
    plain.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")
    return tokenizer, plain, ends, {"": b""}


def _encode_letters(words: list[str], plain, ends: np.ndarray) -> list[bytes]:
    """The ids of words of lower-case letters of Latin-1 only. Each is one word of the vocabulary, so its last token is the only one that
    ends a word, and many words can be encoded in one text."""
    texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
    ids = [np.array(e.ids, "<u4") for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
    ids = np.concatenate(ids) if ids else np.zeros(0, "<u4")
    raw, stops = ids.tobytes(), ((np.flatnonzero(ends[ids]) + 1) * 4).tolist()
    if len(stops) != len(words):
        raise ValueError("the vocabulary does not mark the ends of words")
    return [raw[a:b] for a, b in zip([0, *stops], stops)]


def _learn(words: set[str], path: str) -> dict[str, bytes]:
    """The cache with the ids of all `words`. This vocabulary drops white space and splits words from punctuation,
    so a text's ids are those of its words, and a word's are those of its letters in lower case and of its tail."""
    tokenizer, plain, ends, cache = _tokenizer(path)
    if len(cache) > CACHED_WORDS:
        cache.clear()
        cache[""] = b""
    letters, others, built = set(), set(), []
    for word in words:
        if word in cache:
            continue
        if "<" in word or not word.isascii() and max(word) > "ÿ":
            others.add(word)
            continue
        lower = word.lower()
        if lower.isalpha():
            letters.add(lower)
            if lower != word:
                built.append((word, lower, ""))
        elif both := _WORD_AND_TAIL.fullmatch(lower):
            letters.add(both[1])
            others.add(both[2])
            built.append((word, both[1], both[2]))
        else:
            others.add(lower)
            built.append((word, lower, ""))
    fresh = [w for w in letters if w not in cache]
    cache.update(zip(fresh, _encode_letters(fresh, plain, ends), strict=True))
    fresh = [w for w in others if w not in cache]
    encoded = tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
    cache.update((p, np.array(e.ids, "<u4").tobytes()) for p, e in zip(fresh, encoded, strict=True))
    for word, first, tail in built:
        cache[word] = cache[first] + cache[tail]
    return cache


def forget(path: str) -> None:
    """Empties the cache, so that an idle worker holds no words."""
    cache = _tokenizer(path)[-1]
    cache.clear()
    cache[""] = b""


def word_ids(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    # Lower case at once where it changes nothing else: no special token and no letter beyond ASCII.
    plain = [t.lower() if t.isascii() and "<" not in t else t for t in (text or "" for text in texts)]
    words = [text.replace("\n", " ").split(" ") for text in plain]
    get = _learn(set().union(*words), path).__getitem__
    return [b"".join(map(get, own)) for own in words]


def _map_pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), word_ids(part.column("text").to_pylist(), path), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        length = len(own) // 4
                        rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), own if with_ids else None, task, seen[length]))
                        seen[length] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "task", "seq"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        forget(path)

    return run


class CapacityTree:
    """A segment tree over remaining capacities; a leaf tells if an open sequence has just that capacity left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.size)

    def put(self, remaining: int, some: bool) -> None:
        at = remaining + self.size
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity that holds `length`."""
        at = length + self.size
        if self.some[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: pieces}: rows (length, rank of the first piece, first
    sequence, pieces per sequence, offset, pieces)."""
    tree, left, sequences, out = CapacityTree(capacity), {}, 0, []

    def add(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            left.setdefault(remaining, []).append((first, count))
            tree.put(remaining, True)

    for length in sorted(lengths, reverse=True):
        rank, todo = 0, lengths[length]
        while todo:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining = capacity
                first, count = sequences, -(-todo // (capacity // length))
                sequences += count
            else:
                first, count = left[remaining].pop()
                if not left[remaining]:
                    tree.put(remaining, False)
            each = remaining // length
            full, rest = (count, 0) if todo >= count * each else divmod(todo, each)
            offset = capacity - remaining
            if full:
                out.append((length, rank, first, each, offset, full * each))
                add(remaining - each * length, first, full)
            if rest:
                out.append((length, rank + full * each, first + full, rest, offset, rest))
                add(remaining - rest * length, first + full, 1)
            add(remaining, first + full + (rest > 0), count - full - (rest > 0))
            rank += full * each + rest
            todo -= full * each + rest
    return out


def _map_places(plan: list[tuple[int, ...]]):
    table = np.array(sorted(plan), np.int64).reshape(-1, 6)
    # Ranks of one length are fewer than 2^44, lengths fewer than 2^19.
    keys = (table[:, 0] << 44) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            _, first_rank, first, each, offset, _ = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
            step = rank - first_rank
            rest = batch.select([c for c in batch.schema.names if c != "rank"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(first + step // each), pa.array(offset + step % each * length)],
                [*rest.schema.names, "sequence_id", "offset"],
            )

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids binary, sequence_id, offset): one row per piece of each document.

    A document is its ids and `end_id`; a longer one than `capacity` is cut into pieces of `capacity` ids and a shorter last one. A null or
    empty text is `end_id` alone. `ids` (little-endian unsigned 32-bit) is null unless `with_ids`. Rows are packed one
    by one, also if a row is given twice or doc_id is null; other columns are ignored. An empty table packs into nothing.
    The tokenizer must drop white space, as `word_bpe_49k.json` does.
    """
    if not 0 < capacity < 1 << 19:
        raise ValueError("capacity must lie between 1 and 2^19")
    spark = docs.sparkSession
    folder = new_folder(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts.mapInArrow(tidy_map(_map_pieces(tokenizer_path, capacity, end_id, with_ids)), PIECE).write.parquet(folder)
    pieces = spark.read.schema(PIECE).parquet(folder)
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    # At most `capacity` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = best_fit(histogram, capacity)
    # One row per task and length.
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("before") + F.col("seq")).alias("rank")
    )
    return ranked.mapInArrow(
        _map_places(plan),
        "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long",
    )
