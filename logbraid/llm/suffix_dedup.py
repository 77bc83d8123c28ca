"""Removal of repeated byte strings by minimizer sampling and a join of fingerprints, bucket by bucket.

There is no difference cover and no order of suffixes; buckets are sorted by hashes, to find equal ones.

A suffix is cut at `min_bytes` bytes, as only ties of that length matter. No table of all suffixes is
made. A cover sample stands for them: each suffix goes to the k-gram with the smallest hash inside its first
`min_bytes` bytes (its minimizer), so equal suffixes meet at the same sampled place; the sample holds about
one place in 16. Suffixes of one sampled place are neighbours and form a run.

1. Runs are dealt by the hash of their place into buckets. Each bucket is sorted by (place, content of the
   run), by their hashes. A run whose content is also in an earlier document is removed
   whole; a place that only one content has settles its suffixes as free of ties.
2. The runs left, at the edges of repeats, are dealt by their place with the text they span, and one bucket of
   suffixes at a time is sorted to resolve the ties. A hot place, with many contents, deals its suffixes one by one by fingerprint.
3. What was found goes back to the documents, which are shuffled once.

Each task first reduces what it has: of a repeat it sends the first document only, and of a place with many
contents only two, so a passage that a third of all documents share costs a few rows per task. Equality is
decided on fingerprints of 64 bits.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbraid.operators.ranking import position_in_group
from logbraid.session import broadcast_within, cut
from logbraid.llm.arrow_text import (
    POWERS, by_part, column_bytes, expand, mix, pack, prefix_hash, range_hash, runs_of, slices, tidy_group, tidy_map, unpack, unpack_all,
)

K = 20
POSITION_BITS = 22
#: Places above this many bits name the text, where a doc_id comes with several; a text has fewer bytes.
TAG_BITS = 31
CHUNK = 1 << 18
FLUSH = 400_000
#: A place with more contents than this in one task, or than MANY in all, is hot: its suffixes are dealt one by one.
CONTENTS, MANY = 8, 1_000
#: What is known of a run: an earlier document has all of it; its suffixes must be compared with the other runs of its place; or,
#: as the place is hot, with all suffixes of the same fingerprint.
WHOLE, EDGE, HOT = 0, 1, 2
BLOB = "part long, blob binary"
#: Sides of at most so many ids are broadcast.
MAX_IDS = 2_000_000
_U = np.uint64


def cover_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int):
    """Runs of suffixes with one sampled place, for texts at data[start:end] of at most CHUNK + length bytes:
    (prefix hash, text, first, count, place hash, content hash)."""
    k = min(K, length)
    window = length - k + 1
    h = prefix_hash(data)
    m = len(data) - k + 1
    counts = np.maximum(0, ends - starts - length + 1)
    if m < window or not counts.any():
        none = np.zeros(0, np.int64)
        return h, none, none, none, none, none
    _, down = POWERS.get(len(data) + 1)
    low = _U((1 << POSITION_BITS) - 1)
    x = (h[k:] - h[:-k]) * down[:m]
    x = (x ^ (x >> _U(31))) * _U(0xFF51AFD7ED558CCD)
    x = (x & ~low) | np.arange(m, dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    if size < window:
        x = np.minimum(x[: len(x) - (window - size)], x[window - size :])
    at = expand(starts, counts)
    best = x[at]
    text = np.repeat(np.arange(len(starts)), counts)
    new = np.ones(len(at), bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    lo, best, text = at[first], best[first], text[first]
    place = (best & low).astype(np.int64)
    content = range_hash(h, lo, lo + count - 1 + length) ^ mix((place - lo).astype(np.uint64))
    return h, text, lo, count, (best >> _U(POSITION_BITS)).astype(np.int64), content.view(np.int64)


def _chunks(batch: pa.RecordBatch, length: int):
    """Texts of at most CHUNK bytes that overlap by length - 1 bytes: (doc_id, place of the chunk, bytes, starts, ends)."""
    for part in slices(batch, "text", CHUNK):
        data, offsets = column_bytes(part.column("text"))
        ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        tags = _tags(part)
        if len(data) <= CHUNK:
            yield ids, tags, data, offsets[:-1], offsets[1:]
        else:  # one long text
            for at in range(0, len(data), CHUNK):
                piece = data[at : at + CHUNK + length - 1]
                yield ids, tags + at, piece, np.array([0]), np.array([len(piece)])


def _tags(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("tag").to_numpy(zero_copy_only=False).astype(np.int64) << TAG_BITS


def _own(lo: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Which places are in the text with that tag."""
    return lo >> TAG_BITS == tag >> TAG_BITS


def _found(doc: np.ndarray, lo: np.ndarray, count: np.ndarray, kind: int, parts: int, place=None) -> Iterator[tuple[int, bytes]]:
    """What was found, dealt by document: parts below zero. For an edge, the place decides the bucket its suffixes go to."""
    if len(doc):
        code = count * 4 + kind
        if place is not None:
            code = code + ((mix(place.astype(np.uint64)) >> _U(40)).astype(np.int64) << 8)
        to = (mix(doc.astype(np.uint64)) % _U(parts)).astype(np.int64)
        for p, columns in by_part(to, doc, lo, code):
            yield -1 - p, pack(*columns)


def _table(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"]
    )


def _batches(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 256):
        yield _table(rows[at : at + 256])


def _class_starts(place: np.ndarray, content: np.ndarray) -> np.ndarray:
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (content[1:] != content[:-1])
    return np.flatnonzero(new)


def _firsts(place, content, doc):
    """For rows sorted by (place, content): per row the smallest document of its content, and the contents of its place."""
    starts = _class_starts(place, content)
    sizes = np.diff(np.append(starts, len(place)))
    least = np.repeat(np.minimum.reduceat(doc, starts), sizes)
    p_starts, p_sizes = runs_of(place[starts])
    contents = np.repeat(np.repeat(p_sizes, p_sizes), sizes)
    rank = np.repeat(np.arange(len(starts)) - np.repeat(p_starts, p_sizes), sizes)
    return least, contents, rank


def _send_runs(columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    place, content, doc, lo, count = columns
    order = np.lexsort((content, place))
    place, content, doc, lo, count = (c[order] for c in (place, content, doc, lo, count))
    least, contents, rank = _firsts(place, content, doc)
    later = doc > least
    hot = ~later & (contents > CONTENTS)
    rows = list(_found(doc[later], lo[later], count[later], WHOLE, parts))
    rows += _found(doc[hot], lo[hot], count[hot], HOT, parts)
    # Of a hot place two contents are enough to tell the other tasks.
    send = ~later & (~hot | (rank < 2))
    to = (mix(place[send].astype(np.uint64)) % _U(parts)).astype(np.int64)
    count = count * 2 + hot
    for p, (pl, co, d, at, n) in by_part(to, *(c[send] for c in (place, content, doc, lo, count))):
        rows.append((p, pack(np.diff(pl, prepend=0), co, d, at, n)))
    yield from _batches(rows)


def _map_runs(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ids, offset, data, starts, ends in _chunks(batch, length):
                _, text, lo, count, place, content = cover_runs(data, starts, ends, length)
                if len(text):
                    held.append((place, content, ids[text], lo - starts[text] + offset[text], count))
                    size += len(text)
                if size >= FLUSH:
                    yield from _send_runs([np.concatenate(c) for c in zip(*held, strict=True)], parts)
                    held, size = [], 0
        if size:
            yield from _send_runs([np.concatenate(c) for c in zip(*held, strict=True)], parts)

    return run


def _passed(table: pa.Table) -> pa.Table | None:
    """Rows for documents pass a bucket stage."""
    part = table.column("part")[0].as_py()
    if part >= 0:
        return None
    return pa.Table.from_batches([_table([(part, pack(*unpack_all(table.column("blob"), 3)))])])


def _rank_cover(parts: int):
    def run(table: pa.Table) -> pa.Table:
        if (same := _passed(table)) is not None:
            return same
        got = [unpack(b.as_buffer()) for b in table.column("blob")]
        place, content, doc, lo, count = (np.concatenate(c) for c in zip(*([np.cumsum(g[0]), *g[1:]] for g in got), strict=True))
        del got
        values, lengths = np.unique(place, return_counts=True)
        keep = np.isin(place, values[lengths > 1])
        place, content, doc, lo, count = (c[keep] for c in (place, content, doc, lo, count))
        if len(place) == 0:
            return pa.Table.from_batches([_table([])])
        order = np.lexsort((content, place))
        place, content, doc, lo, count = (c[order] for c in (place, content, doc, lo, count))
        least, contents, _ = _firsts(place, content, doc)
        starts, sizes = runs_of(place)
        hot = np.repeat(np.logical_or.reduceat(count % 2 == 1, starts), sizes) | (contents > MANY)
        told = count % 2 == 1  # its task has marked it
        count = count // 2
        later = doc > least
        edge = ~later & (contents > 1) & ~told
        rows = list(_found(doc[later], lo[later], count[later], WHOLE, parts))
        for kind, take in ((EDGE, edge & ~hot), (HOT, edge & hot)):
            rows += _found(doc[take], lo[take], count[take], kind, parts, place[take])
        return pa.Table.from_batches([_table(rows)])

    return run


def _per_document(table: pa.Table) -> pa.Table:
    doc, lo, code = unpack_all(table.column("blob"), 3)
    order = np.argsort(doc, kind="stable")
    doc, lo, code = doc[order], lo[order], code[order]
    starts, sizes = runs_of(doc)
    spans = [pack(lo[s : s + n], code[s : s + n]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    return pa.table({"found_id": pa.array(doc[starts], pa.int64()), "spans": pa.array(spans, pa.binary())})


def _ties(suffix: np.ndarray, doc: np.ndarray, at: np.ndarray):
    """Rows in the order of the suffixes, and which of them an earlier document has."""
    order = np.argsort(suffix, kind="stable")
    suffix, doc, at = suffix[order], doc[order], at[order]
    starts, sizes = runs_of(suffix)
    later = doc > np.repeat(np.minimum.reduceat(doc, starts), sizes) if len(doc) else np.zeros(0, bool)
    return suffix, doc, at, later


def _one(doc: np.ndarray, at: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    return list(_found(doc, at, np.ones(len(doc), np.int64), WHOLE, parts))


def _send_suffixes(columns: list[np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    suffix, doc, at, later = _ties(*columns)
    rows = _one(doc[later], at[later], parts)
    suffix, doc, at = suffix[~later], doc[~later], at[~later]
    to = (mix(suffix.view(np.uint64)) % _U(parts)).astype(np.int64)
    for p, (x, d, a) in by_part(to, suffix, doc, at):
        rows.append((parts + p, pack(np.diff(x, prepend=x[:1]), x[:1].repeat(len(x)), d, a)))
    yield from _batches(rows)


def _send_runs_of_text(data, start, doc, lo, count, place, length: int, parts: int) -> Iterator[pa.RecordBatch]:
    rows = []
    for p, (s, d, a, n) in by_part(place % parts, start, doc, lo, count):
        columns = pack(d, a, n)
        rows.append((p, np.int64(len(columns)).tobytes() + columns + data[expand(s, n + length - 1)].tobytes()))
    yield from _batches(rows)


def _map_suffixes(length: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column("spans")))
            for part in slices(batch, "text", 8 * CHUNK):
                data, offsets = column_bytes(part.column("text"))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                spans = [unpack(s.as_buffer()) for s in part.column("spans")]
                row = np.repeat(np.arange(len(spans)), [len(s[0]) for s in spans])
                lo, code = (np.concatenate(c) for c in zip(*spans, strict=True))
                tags = _tags(part)
                own = _own(lo, tags[row])
                row, lo, code = row[own], lo[own], code[own]
                inside = lo - tags[row] + offsets[row]
                kind, count, place = code % 4, (code & 255) // 4, code >> 8
                e = kind == EDGE
                if e.any():
                    yield from _send_runs_of_text(data, inside[e], ids[row[e]], lo[e], count[e], place[e], length, parts)
                hot = kind == HOT
                if hot.any():
                    at, of = expand(lo[hot], count[hot]), np.repeat(row[hot], count[hot])
                    where = expand(inside[hot], count[hot])
                    held.append((range_hash(prefix_hash(data), where, where + length).view(np.int64), ids[of], at))
                    size += len(at)
                if size >= FLUSH:
                    yield from _send_suffixes([np.concatenate(c) for c in zip(*held, strict=True)], parts)
                    held, size = [], 0
        if size:
            yield from _send_suffixes([np.concatenate(c) for c in zip(*held, strict=True)], parts)

    return run


def _sort_bucket(length: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        if (same := _passed(table)) is not None:
            return same
        suffixes, docs, places = [], [], []
        one_by_one = table.column("part")[0].as_py() >= parts
        for blob in table.column("blob"):
            raw = memoryview(blob.as_buffer())
            if one_by_one:
                step, first, doc, at = unpack(raw)
                suffixes.append(np.cumsum(step) + first)
            else:
                size = int(np.frombuffer(raw, "<i8", 1)[0])
                doc, lo, count = unpack(raw[8 : 8 + size])
                sizes = count + length - 1
                start = expand(np.cumsum(sizes) - sizes, count)
                suffixes.append(range_hash(prefix_hash(np.frombuffer(raw, np.uint8, offset=8 + size)), start, start + length).view(np.int64))
                doc, at = np.repeat(doc, count), expand(lo, count)
            docs.append(doc)
            places.append(at)
        _, doc, at, later = _ties(*(np.concatenate(c) for c in (suffixes, docs, places)))
        return pa.Table.from_batches([_table(_one(doc[later], at[later], parts))])

    return run


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def _cut(length: int, keep: Sequence[str], as_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 * CHUNK):
                removed, kept, sizes, gone = [], [], [], []
                columns = (part.column(c) for c in ("text", "spans", "more"))
                for text, span, more, tag in zip(*columns, _tags(part).tolist(), strict=True):
                    text = text.as_buffer().to_pybytes() if text.is_valid else b""
                    los, his = [], []
                    for found in (span, more):
                        if found.is_valid:
                            lo, code = unpack(found.as_buffer())
                            whole = (code % 4 == WHOLE) & _own(lo, np.int64(tag))
                            los.append(lo[whole] - tag)
                            his.append(lo[whole] - tag + (code[whole] & 255) // 4 - 1 + length)
                    sizes.append(len(text))
                    if sum(map(len, los)):
                        lo, hi = _merge(np.concatenate(los), np.concatenate(his))
                        lo, hi = lo.tolist(), hi.tolist()
                        removed.append([{"start": a, "end": b} for a, b in zip(lo, hi, strict=True)])
                        kept.append(b"".join(text[a:b] for a, b in zip([0, *hi], [*lo, len(text)], strict=True)))
                        gone.append(sum(hi) - sum(lo))
                    else:
                        removed.append([])
                        kept.append(text)
                        gone.append(0)
                spans = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                rest = pa.array([k.decode(errors="ignore") for k in kept] if as_text else kept, pa.string() if as_text else pa.binary())
                arrays = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), spans, rest]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(part.column(f"kept_{c}") for c in keep), *arrays],
                    ["doc_id", *(f"kept_{c}" for c in keep), "n_bytes", "n_removed", "removed", "kept"],
                )

    return run


def _tagged(texts: DataFrame) -> DataFrame:
    """With `tag`, a number among the texts of the row's doc_id: 0 where there is one text."""
    hashed = texts.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash"))
    several = cut(hashed.groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).where("low <> high").select("doc_id"))
    if several.isEmpty():
        return texts.withColumn("tag", F.lit(0).cast("long"))
    pairs = hashed.join(broadcast_within(several, MAX_IDS), "doc_id", "left_semi").distinct()
    tags = position_in_group(pairs, ["doc_id"], ["hash"], "tag", MAX_IDS).select(F.col("doc_id").alias("tagged_id"), "hash", "tag")
    same = (F.col("doc_id") == F.col("tagged_id")) & (F.xxhash64("text") == F.col("hash"))
    return texts.join(broadcast_within(tags, MAX_IDS), same, "left").drop("tagged_id", "hash").withColumn("tag", F.coalesce("tag", F.lit(0).cast("long")))


def remove_repeats(docs: DataFrame, min_bytes: int = 50, keep: Sequence[str] = (), as_text: bool = False) -> DataFrame:
    """(doc_id, the columns named in `keep`, n_bytes, n_removed, removed array<struct<start, end>>, kept binary): each text without
    the bytes that a string of `min_bytes` bytes covers which also starts in a document with a smaller
    doc_id. Texts are judged as they come in, as UTF-8 bytes; matches lie in one document.

    A null or empty text has nothing to remove, nor has one shorter than `min_bytes`. Of equal texts the one with the smallest doc_id stays.
    With `as_text`, `kept` is a string: of a character that a cut has split, the other bytes go too.
    doc_id is a whole number; a row that is given twice comes out twice. Texts of one doc_id are one document: none is earlier than the other, and
    each is cut by what documents with smaller ids hold. A null doc_id is no document: its row stays as it is. Other columns are ignored unless named in `keep`; no name clashes.
    """
    if not 8 <= min_bytes <= 62 + K:
        raise ValueError(f"min_bytes must lie between 8 and {62 + K}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        *(F.col(c).alias(f"kept_{c}") for c in keep),
    )
    texts = _tagged(texts)
    runs = texts.where("doc_id is not null").select("doc_id", "text", "tag").mapInArrow(tidy_map(_map_runs(min_bytes, parts)), BLOB)
    cover = runs.groupBy("part").applyInArrow(tidy_group(_rank_cover(parts)), BLOB)
    # Read twice below, and small beside the texts.
    found = cut(cover.groupBy("part").applyInArrow(_per_document, "found_id long, spans binary"))
    # Hash joins, so texts are not sorted. Both uses of `marked` take the same columns and rows of it, so that
    # the texts are shuffled once and their exchange is used again.
    marked = texts.join(found.hint("shuffle_hash"), F.col("doc_id") == F.col("found_id"), "left").drop("found_id")
    suffixes = marked.mapInArrow(tidy_map(_map_suffixes(min_bytes, parts)), BLOB)
    ties = suffixes.groupBy("part").applyInArrow(tidy_group(_sort_bucket(min_bytes, parts)), BLOB)
    more = ties.groupBy("part").applyInArrow(_per_document, "found_id long, spans binary").withColumnRenamed("spans", "more")
    both = marked.join(more.hint("shuffle_hash"), F.col("doc_id") == F.col("found_id"), "left").drop("found_id")
    fields = "".join(f", kept_{c} {dict(docs.dtypes)[c]}" for c in keep)
    out = both.mapInArrow(
        tidy_map(_cut(min_bytes, tuple(keep), as_text)),
        f"doc_id long{fields}, n_bytes long, n_removed long, removed array<struct<start: bigint, end: bigint>>, kept {'string' if as_text else 'binary'}",
    )
    return out.select("doc_id", *(F.col(f"kept_{c}").alias(c) for c in keep), "n_bytes", "n_removed", "removed", "kept")
