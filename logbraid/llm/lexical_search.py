"""Ranked search over a term-document grid held as K2-treaps.

The grid has a row per term and a column per document; a cell holds the term's impact in the document. Documents are cut into ranges, and each
range's part of the grid is one K2-treap: a quadtree of which only non-empty cells exist, four child bits per cell, and every
cell knows the greatest impact below it, kept as the difference to its parent's. Building it takes the documents as they lie in their files.

A query's terms are rows. For a range of documents, each row is inside one cell per level, so all rows of a query go down together: a node of the
search is a range of documents with the cell of each row, its bound the sum of weight times greatest impact. Nodes are opened best
first, the bounds of many at a time, until no bound reaches the k-th best score; a leaf is one document and its bound is the score. A task carries
the k-th best score from one range of documents to the next.

Scores are whole numbers, so ties are exact. Terms are known by 64-bit hashes.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logbraid.llm.arrow_text import column_bytes, from_planes, pack, planes, prefix_hash, range_hash, slices, tidy_map, unpack
from logbraid.llm.shingles import LOWER
from logbraid.session import new_folder

#: A range of documents is closed when its texts hold so many bytes, or at so many documents.
RANGE_BYTES, RANGE_DOCS = 8 << 20, 1 << 16
#: A longer text is read in pieces, cut between words.
PIECE_BYTES = 1 << 20
#: Queries are answered in blocks of so many, and nodes opened so many at a time.
ITEMS_PER_PASS, OPEN_AT_ONCE = 1000, 256
#: Weights of the ranking: term frequency against length, in hundredths.
LENGTH_SHARE, SATURATION, IMPACT_SCALE = 50, 20, 1_000_000_000

#: An index row takes megabytes, so a writer that looks at its size every hundred rows only, and a reader of a whole row group, hold a whole file. With these
#: they hold little more than one row, however much text a task has.
SMALL_GROUPS = {"compression": "zstd", "parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
INDEX = "n_docs long, n_terms long, docs binary, terms binary, frequencies binary, masks binary, maxima binary, levels binary"
HITS = "query long, doc_id long, score long"
_U = np.uint64
#: ASCII letters and digits, and every byte above ASCII, make terms.
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each term of the texts data[offsets[i]:offsets[i + 1]], and the terms of each text."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = TERM_BYTE[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    border = offsets[(offsets > 0) & (offsets < len(data))]
    first[border] = inside[1 + border]
    last[border - 1] = inside[border]
    first = np.flatnonzero(first)
    return first, np.flatnonzero(last) + 1, np.diff(np.searchsorted(first, offsets))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text in pieces of about PIECE_BYTES that no term crosses."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        while end < len(data):
            gaps = np.flatnonzero(~TERM_BYTE[data[end : end + PIECE_BYTES]])
            if len(gaps):
                end += int(gaps[0])
                break
            end = min(len(data), end + PIECE_BYTES)
        yield data[at:end]
        at = end


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of the texts of a batch; a long text comes in several pieces of one row."""
    row = 0
    for part in slices(batch, column, PIECE_BYTES):
        data, offsets = column_bytes(part.column(column))
        if part.num_rows == 1 and len(data) > PIECE_BYTES:
            for piece in _pieces(data):
                yield row, piece, np.array([0, len(piece)])
        else:
            yield row, data, offsets
        row += part.num_rows


def _hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(LOWER[data]), first, last).view(np.int64)


def _map_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = terms = 0
    for batch in batches:
        n = np.zeros(batch.num_rows, np.int64)
        for row, data, offsets in _texts(batch, "text"):
            n[row : row + len(offsets) - 1] += term_spans(data, offsets)[2]
        docs, terms = docs + int((n > 0).sum()), terms + int(n.sum())
    yield pa.RecordBatch.from_arrays([pa.array([docs], pa.int64()), pa.array([terms], pa.int64())], ["n_docs", "n_terms"])


def corpus_counts(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms in all, of docs(text)."""
    texts = docs.select(F.col("text").cast("string").alias("text"))
    row = texts.mapInArrow(tidy_map(_map_counts), "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def impacts(frequency: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Impact of a term that comes `frequency` times in a document of `length` terms, before the term's weight."""
    norm = 100 - LENGTH_SHARE + LENGTH_SHARE * length * n_docs // n_terms
    return IMPACT_SCALE * frequency // (1000 * frequency + SATURATION * norm)


def weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


# The K2-treap of one range of documents


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of numbers below 2^32 moved to the even places."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << _U(shift))) & _U(keep)
    return x


def build_treap(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, height: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Child bits and greatest values of all cells, level by level from the root, and the number of cells of each level.

    The grid has 2^height rows and columns; its points are distinct. Bit 2 * r + c of a cell's mask stands for the quadrant of row bit r and column bit c.
    """
    if not len(rows):  # a root without children
        return np.zeros(1, np.uint8), np.zeros(1, np.int64), np.array([1] + [0] * height)
    key = (_spread(rows) << _U(1)) | _spread(columns)
    order = np.argsort(key, kind="stable")
    key, top = key[order], values[order]
    masks, maxima = [np.zeros(len(key), np.uint8)], [top]
    for _ in range(height):
        parent = key >> _U(2)
        starts = np.concatenate([[0], np.flatnonzero(parent[1:] != parent[:-1]) + 1])
        bits = np.left_shift(np.uint8(1), (key & _U(3)).astype(np.uint8))
        masks.append(np.bitwise_or.reduceat(bits, starts))
        top = np.maximum.reduceat(top, starts)
        maxima.append(top)
        key = parent[starts]
    sizes = np.array([len(m) for m in masks[::-1]])
    return np.concatenate(masks[::-1]), np.concatenate(maxima[::-1]), sizes


_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)
#: The same for all cells of a treap at once.
_FEW = _ONES.astype(np.int8)
#: Of a mask, the children before each quadrant; -1 where there is none.
_BEFORE = np.array([[_ONES[m & ((1 << q) - 1)] if m >> q & 1 else -1 for q in range(4)] for m in range(16)], np.int64)


class Treap:
    """A K2-treap from its stored form: the first child of a cell is found by a running sum over child bits."""

    def __init__(self, row: dict):
        self.sizes = unpack(row["levels"])[0]
        self.height = len(self.sizes) - 1
        total = int(self.sizes.sum())
        nibbles = np.frombuffer(row["masks"], np.uint8)
        self.masks = np.stack([nibbles & 15, nibbles >> 4], 1).reshape(-1)[:total]
        children = _FEW[self.masks]
        self.first = np.cumsum(children, dtype=np.int32)
        self.first -= children
        self.first += 1
        down = from_planes(row["maxima"], total, 3).astype(np.int32)
        # Differences are undone one level after another.
        self.maxima, at = down, 1
        for size, above in zip(self.sizes[1:].tolist(), self.sizes[:-1].tolist()):
            parents = np.repeat(np.arange(at - above, at), children[at - above : at])
            self.maxima[at : at + size] = self.maxima[parents] - down[at : at + size]
            at += size


def store_treap(masks: np.ndarray, maxima: np.ndarray, sizes: np.ndarray) -> dict[str, bytes]:
    children = _FEW[masks]
    down, at = maxima.copy(), 1
    for size, above in zip(sizes[1:].tolist(), sizes[:-1].tolist()):
        parents = np.repeat(np.arange(at - above, at), children[at - above : at])
        down[at : at + size] = maxima[parents] - maxima[at : at + size]
        at += size
    even = np.append(masks, np.uint8(0)) if len(masks) % 2 else masks
    return {"masks": (even[::2] | even[1::2] << 4).tobytes(), "maxima": planes(down.view(np.uint64), 3), "levels": pack(sizes)}


def _height(n: int) -> int:
    return max(1, (n - 1).bit_length())


def _range_row(ids: np.ndarray, null: np.ndarray, length: np.ndarray, doc: np.ndarray, term: np.ndarray, count: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """The index row of one range of documents, from (document, term hash, count), where a pair may come several times."""
    terms, row = np.unique(term, return_inverse=True)
    pair = row * len(ids) + doc
    order = np.argsort(pair, kind="stable")
    pair, count = pair[order], count[order]
    starts = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1]) if len(pair) else np.zeros(0, np.int64)
    pair = pair[starts]
    frequency = np.add.reduceat(count, starts) if len(pair) else count
    row, doc = pair // len(ids), pair % len(ids)
    holding = np.bincount(row, minlength=len(terms))
    # Rows with equal numbers of documents are neighbours, so that a cell's greatest impact says much about each of its rows.
    rank = np.empty(len(terms), np.int64)
    rank[np.argsort(-holding, kind="stable")] = np.arange(len(terms))
    values = impacts(frequency, length[doc], n_docs, n_terms)
    treap = build_treap(rank[row], doc, values, _height(max(len(terms), len(ids))))
    return {
        "n_docs": len(ids), "n_terms": len(terms), "docs": pack(ids, null.astype(np.int64)), "terms": terms.tobytes(),
        "frequencies": pack(holding, rank), **store_treap(*treap),
    }


def _map_index(n_docs: int, n_terms: int):
    schema = pa.schema([(c, pa.int64() if c in ("n_docs", "n_terms") else pa.binary()) for c in (p.split()[0] for p in INDEX.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = n = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, n
            ids, null, length = (np.concatenate([h[i] for h in held]) for i in range(3))
            doc, term, count = (np.concatenate([x for h in held for x in h[3][i]] or [np.zeros(0, np.int64)]) for i in range(3))
            held, size, n = [], 0, 0
            return pa.RecordBatch.from_pylist([_range_row(ids, null, length, doc, term, count, n_docs, n_terms)], schema)

        for batch in batches:
            for part in slices(batch, "text", RANGE_BYTES // 8):
                for at in range(0, part.num_rows, RANGE_DOCS // 8):
                    sub = part.slice(at, RANGE_DOCS // 8)
                    ids = sub.column("doc_id")
                    length = np.zeros(sub.num_rows, np.int64)
                    docs, terms, counts = [], [], []
                    for row, data, offsets in _texts(sub, "text"):
                        first, last, each = term_spans(data, offsets)
                        length[row : row + len(each)] += each
                        # Repeats inside a text are counted before anything is kept.
                        doc = np.repeat(np.arange(row, row + len(each)), each)
                        hashes = _hashes(data, first, last)
                        order = np.lexsort((hashes, doc))
                        doc, hashes = doc[order], hashes[order]
                        new = np.ones(len(doc), bool)
                        new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
                        starts = np.flatnonzero(new)
                        docs.append(doc[starts] + n)
                        terms.append(hashes[starts])
                        counts.append(np.diff(np.append(starts, len(doc))))
                        size += len(data)
                    null = np.asarray(ids.is_null())
                    held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), null, length, (docs, terms, counts)))
                    n += sub.num_rows
                    if size >= RANGE_BYTES or n >= RANGE_DOCS:
                        yield close()
        if n:
            yield close()

    return run


class SearchIndex:
    """Index rows in a table, with the counts that weights need."""

    def __init__(self, rows: DataFrame, n_docs: int, n_terms: int):
        self.rows, self.n_docs, self.n_terms = rows, n_docs, n_terms


def build_index(docs: DataFrame, folder: str | None = None) -> SearchIndex:
    """Index of all rows of docs(doc_id, text), written below `folder` (a new shared folder by default).

    A null or empty text has no term, but its row is there; repeated rows are documents of their own; a null doc_id is kept. An empty table
    gives an empty index; other columns are ignored. Memory follows RANGE_BYTES, and beyond that the number of distinct terms of one document.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_docs, n_terms = corpus_counts(texts)
    texts.mapInArrow(tidy_map(_map_index(n_docs, max(1, n_terms))), INDEX).write.options(**SMALL_GROUPS).parquet(folder)
    return SearchIndex(spark.read.schema(INDEX).parquet(folder), n_docs, n_terms)


# Search


def _map_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        query = batch.column("query").to_numpy(zero_copy_only=False)
        for row, data, offsets in _texts(batch, "text"):
            first, last, each = term_spans(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(query[row : row + len(each)], each), pa.int64()), pa.array(_hashes(data, first, last))], ["query", "term"]
            )


def _places(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in the sorted terms, or -1."""
    if not len(terms):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return np.where(terms[at] == wanted, at, -1)


def _map_holding(wanted: np.ndarray):
    """How many documents hold each wanted term, added up over the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, frequencies in zip(*(batch.column(c).to_pylist() for c in ("terms", "frequencies")), strict=True):
                at = _places(np.frombuffer(terms, np.int64), wanted)
                found = at >= 0
                total[found] += unpack(frequencies)[0][at[found]]
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(total[some])], ["term", "holding"])

    return run


class _Best:
    """The k best (score, document) of a query so far; of equal scores, the smaller id, null ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.ids = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def floor(self) -> int:
        """A document with less can't be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (np.concatenate(p) for p in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]


def search_range(treap: Treap, rows: np.ndarray, weights: np.ndarray, ids: np.ndarray, null: np.ndarray, best: _Best) -> None:
    """Brings the documents of one range that belong there into `best`. `rows` are the query's rows in the grid."""
    height, masks, first, maxima = treap.height, treap.masks, treap.first, treap.maxima
    # Nodes: level, first document as a prefix, cell of each row (-1: empty), bound.
    level, column = np.zeros(1, np.int64), np.zeros(1, np.int64)
    cells = np.zeros((1, len(rows)), np.int64)
    bound = np.array([int(maxima[0] * weights.sum())])
    while len(bound):
        floor = best.floor()
        keep = bound >= floor
        if not keep.all():
            level, column, cells, bound = level[keep], column[keep], cells[keep], bound[keep]
            if not len(bound):
                return
        if len(bound) > OPEN_AT_ONCE:
            part = np.argpartition(-bound, OPEN_AT_ONCE)
            take, rest = part[:OPEN_AT_ONCE], part[OPEN_AT_ONCE:]
        else:
            take, rest = np.arange(len(bound)), np.zeros(0, np.int64)
        row_bit = (rows[None, :] >> (height - 1 - level[take])[:, None]) & 1
        at = np.maximum(cells[take], 0)
        there = cells[take] >= 0
        mask, child = masks[at], first[at]
        new_level, new_column, new_cells, new_bound = [level[rest]], [column[rest]], [cells[rest]], [bound[rest]]
        for bit in (0, 1):
            before = _BEFORE[mask, 2 * row_bit + bit]
            inner = np.where(there & (before >= 0), child + before, -1)
            reach = (np.where(inner >= 0, maxima[inner], 0) * weights).sum(1)
            down = level[take] + 1
            ok = reach >= floor
            leaf = ok & (down == height)
            if leaf.any():
                doc = column[take][leaf] * 2 + bit
                best.add(reach[leaf], ids[doc], null[doc])
            ok &= ~leaf
            new_level.append(down[ok])
            new_column.append(column[take][ok] * 2 + bit)
            new_cells.append(inner[ok])
            new_bound.append(reach[ok])
        level, column, cells, bound = (np.concatenate(x) for x in (new_level, new_column, new_cells, new_bound))


def _map_search(query: np.ndarray, term: np.ndarray, weights: np.ndarray, k: int):
    """`query` is sorted; `term` and `weights` belong to it."""
    starts = np.concatenate([[0], np.flatnonzero(query[1:] != query[:-1]) + 1, [len(query)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in range(len(starts) - 1)]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("docs", "terms", "frequencies", "masks", "maxima", "levels")}
                terms = np.frombuffer(row["terms"], np.int64)
                at = _places(terms, term)
                if not (at >= 0).any():
                    continue
                rank = unpack(row["frequencies"])[1]
                ids, null = unpack(row["docs"])
                treap, null = Treap(row), null.astype(bool)
                for a, b, found in zip(starts[:-1].tolist(), starts[1:].tolist(), best, strict=True):
                    known = at[a:b] >= 0
                    if known.any():
                        search_range(treap, rank[at[a:b][known]], weights[a:b][known], ids, null, found)
        for q, found in zip(query[starts[:-1]].tolist(), best, strict=True):
            if len(found.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found.score), q)), pa.array(found.ids, mask=found.null), pa.array(found.score)], ["query", "doc_id", "score"]
                )

    return run


def search(index: SearchIndex, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents with a score above 0 for each row of items(item_id, text).

    Of equal scores the smaller doc_id comes first, null last. Rows of one item_id with the same text are one query, with different texts one query each. A null or
    empty text, or an empty table on either side, gives no row. Queries are answered in blocks of ITEMS_PER_PASS, each a pass over the index; a
    block's terms go to all tasks.
    """
    spark = items.sparkSession
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    folder = new_folder(spark)
    # One row per query, numbered once and for all.
    texts.withColumn("query", F.monotonically_increasing_id()).write.parquet(folder)
    queries = spark.read.schema("item_id long, text string, query long").parquet(folder)
    numbers = [r["query"] for r in queries.where("text is not null").select("query").orderBy("query").toLocalIterator()]
    names = queries.select("query", "item_id")
    results = []
    for at in range(0, len(numbers), ITEMS_PER_PASS):
        low, high = numbers[at], numbers[min(at + ITEMS_PER_PASS, len(numbers)) - 1]
        block = queries.where(F.col("query").between(low, high) & F.col("text").isNotNull())
        rows = block.select("query", "text").mapInArrow(_map_terms, "query long, term long").distinct().toArrow()
        query, term = (rows.column(c).to_numpy() for c in ("query", "term"))
        order = np.lexsort((term, query))
        query, term = query[order], term[order]
        wanted = np.unique(term)
        counted = index.rows.select("terms", "frequencies").mapInArrow(tidy_map(_map_holding(wanted)), "term long, holding long")
        holding = dict(zip(*(c.to_pylist() for c in counted.groupBy("term").agg(F.sum("holding").alias("n")).toArrow().columns), strict=True))
        known = np.isin(term, np.fromiter(holding, np.int64, len(holding)))
        query, term = query[known], term[known]
        if len(query):
            weights = np.array([weight(index.n_docs, holding[t]) for t in term.tolist()])
            columns = ("docs", "terms", "frequencies", "masks", "maxima", "levels")
            results.append(index.rows.select(*columns).mapInArrow(tidy_map(_map_search(query, term, weights, k)), HITS))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    hits = results[0]
    for more in results[1:]:
        hits = hits.union(more)
    ranks = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = hits.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return top.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
