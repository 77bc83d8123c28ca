"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

cos(w x + b) with random w approximates a Gaussian kernel, so a linear fit on these features is a smooth one on the
statistics. The normal equations are sums over rows: each task adds up its own, Spark adds up the tasks', and
the driver solves one system whose size is the number of features. Calibration pools the scores' neighbouring bins until
the share of good documents rises with the score; the bins are a fixed number too.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbraid.llm.arrow_text import column_bytes, prefix_hash, range_hash, slices
from logbraid.llm.shingles import LOWER, words_of
from logbraid.session import new_folder

FEATURES, SCALE, RIDGE, SEED = 256, 0.25, 1e-3, 20240501
#: Of the rows to learn from, this share calibrates the scores instead of being fitted.
CALIBRATE_ONE_IN = 5
BINS = 1_000
#: Sums of one row of the system meet in so many parts first.
PARTS = 64
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\v\f\r",
    "newline": b"\n",
    "stop": b".,;:",
    "mark": b"!?",
    "symbol": b"#*$%&<>@^~=+_\\",
    "bar": b"|/",
    "quote": b"\"'()[]{}-",
    "other": bytes(range(0x80, 0x100)),
}
N_STATISTICS = len(CLASSES) + 8


@lru_cache(maxsize=1)
def _class_of() -> np.ndarray:
    table = np.full(256, len(CLASSES), np.int64)
    for i, members in enumerate(CLASSES.values()):
        table[list(members)] = i
    return table


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of N_STATISTICS numbers per text; that of an empty text is zero."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(n), sizes)
    counts = np.bincount(text * (len(CLASSES) + 1) + _class_of()[data], minlength=n * (len(CLASSES) + 1))
    shares = counts.reshape(n, -1)[:, : len(CLASSES)] / np.maximum(sizes, 1)[:, None]
    first, last, at = words_of(data, offsets)
    hashes = range_hash(prefix_hash(LOWER[data]), first, last)
    words = np.diff(at)
    of = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    width = (last - first).astype(float)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    per_text = lambda x: np.bincount(of, x, minlength=n) / some
    mean = per_text(width)
    spread = np.sqrt(np.maximum(per_text(width**2) - mean**2, 0))
    distinct, most = np.zeros(n), np.zeros(n)
    bounds = at.tolist()
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        if b > a:
            own = np.sort(hashes[a:b])
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            distinct[i] = len(starts) / (b - a)
            most[i] = np.diff(np.append(starts, b - a)).max() / (b - a)
    lines = counts.reshape(n, -1)[:, list(CLASSES).index("newline")] + (sizes > 0)
    return np.column_stack(
        [shares, np.log1p(words), mean, spread, per_text(again), distinct, most, np.log1p(words / np.maximum(lines, 1)), per_text(width > 20)]
    )


def _map_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            rows = statistics(*column_bytes(part.column("text")))
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), N_STATISTICS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), values], ["doc_id", "x"])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(-1, N_STATISTICS)


def _sums(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum of `of(batch)`, a matrix of a fixed size, over all batches: one matrix per task, whose rows are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        part = TaskContext.get().partitionId() % PARTS
        values = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), width).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(height), pa.int64()), pa.array(np.full(height, part), pa.int64()), values], ["i", "part", "v"]
        )

    def add(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width).sum(axis=0)
        return pa.table({"i": table.column("i").slice(0, 1), "part": table.column("part").slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    schema = "i long, part long, v array<double>"
    by_part = rows.mapInArrow(run, schema).groupBy("i", "part").applyInArrow(add, schema)
    out = np.zeros((height, width))
    for row in by_part.groupBy("i").applyInArrow(add, schema).toArrow().to_pylist():
        out[row["i"]] = row["v"]
    return out


class Model:
    """Fixed random features, the fitted weights, and the steps of the calibration."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.spread = mean, spread
        self.w = rng.normal(0, SCALE, (N_STATISTICS, FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.at, self.share = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.column_stack([np.ones(len(x)), np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mostly the calibrated share; a hundredth is the raw score, which orders equals."""
        raw = self.raw(x)
        return 0.99 * np.interp(raw, self.at, self.share) + 0.01 * raw


def pool_adjacent(weight: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Shares that do not fall from bin to bin, closest to good / weight."""
    blocks: list[list[float]] = []
    for w, g in zip(weight.tolist(), good.tolist(), strict=True):
        blocks.append([w, g, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, g2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + g2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), g / w) for w, g, n in blocks])


def fit(train: DataFrame, calibrate: DataFrame) -> Model:
    """A model of train(x, y), calibrated on the rows of calibrate(x, y), which it has not seen. If either has no row, the other stands for both;
    with no row at all it scores 0.5; with one class only, its share."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.stack([np.full(N_STATISTICS, len(x), float), x.sum(axis=0), (x**2).sum(axis=0)])

    count, total, squares = _sums(train, moments, 3, N_STATISTICS)
    if count[0] == 0:
        train = calibrate
        count, total, squares = _sums(train, moments, 3, N_STATISTICS)
    n = count[0]
    if n == 0:
        return Model(np.zeros(N_STATISTICS), np.ones(N_STATISTICS))
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(_matrix(batch))
        return z.T @ np.column_stack([z, batch.column("y").to_numpy()])

    sums = _sums(train, equations, FEATURES + 1, FEATURES + 2)
    penalty = np.eye(FEATURES + 1) * RIDGE * n
    penalty[0, 0] = 0
    model.weights = np.linalg.solve(sums[:, :-1] + penalty + 1e-9 * np.eye(FEATURES + 1), sums[:, -1])

    def bins(batch: pa.RecordBatch) -> np.ndarray:
        at = np.minimum((model.raw(_matrix(batch)) * BINS).astype(int), BINS - 1)
        return np.stack([np.bincount(at, minlength=BINS).astype(float), np.bincount(at, batch.column("y").to_numpy(), minlength=BINS)])

    weight, good = _sums(calibrate, bins, 2, BINS)
    if not weight.any():
        weight, good = _sums(train, bins, 2, BINS)
    used = weight > 0
    model.at, model.share = (np.flatnonzero(used) + 0.5) / BINS, pool_adjacent(weight[used], good[used])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text), learned from labels(doc_id, quality).

    Labels of rows where the condition `held_out` on doc_id holds are not learned from. Of the others, one in CALIBRATE_ONE_IN, by a hash of doc_id, is
    kept out of the fit and calibrates it. score lies in 0 to 1 and estimates the
    chance of quality 1; predicted is 1 from `threshold` on. A null or empty text is scored by its statistics, all
    zero. Null labels are left out; a doc_id with several labels counts with their mean; labels without a document are ignored, and a document given several times is
    learned as often. Without labels every score is 0.5. Rows come out as often as they come in, null doc_ids too (not held out). Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = new_folder(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts.mapInArrow(_map_statistics, "doc_id long, x array<double>").write.parquet(folder)
    rows = spark.read.parquet(folder).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    marks = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").cast("double").alias("y"))
    learned = rows.where("not held_out").join(marks, "doc_id")
    fold = F.pmod(F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string"))), F.lit(CALIBRATE_ONE_IN)) == 0
    model = fit(learned.where(~fold).select("x", "y"), learned.where(fold).select("x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return rows.select("doc_id", "x", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
