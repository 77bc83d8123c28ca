"""Similarity join of documents on word shingles: a prefix join over groups.

Two sets can only be similar if they share an element among the first of each, in any one order of elements (prefix filter),
and if their sizes are near. The order here puts elements that few documents have first.

1. Document frequencies of all shingles are counted; the frequent ones, a list of bounded length,
   go to the end of the order.
2. Documents with equal sets form a class; classes with identical prefixes and size form a group, and only
   groups are compared. Rare elements of the prefixes are in few documents, so their group pairs are made at once. A frequent
   element compares its groups with one of them, the pivot.
3. Group pairs that pass the size and position filters are expanded to classes and verified on the words of the texts.
4. Classes linked so far have one label. Of the groups that meet in a frequent element, or have several classes,
   only classes with different labels are still compared: nothing inside a label could add to it. So a large
   group of near copies costs rows in proportion to its size.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logbraid.llm.arrow_text import by_part, column_bytes, mix, pack, runs_of, slices, tidy_group, tidy_map, unpack
from logbraid.llm.shingles import shingle_sets
from logbraid.operators.components import star_roots
from logbraid.session import broadcast_within, cut, new_folder

_U = np.uint64
#: An element is its 64-bit hash; frequencies go by its high 40 bits.
SHIFT = _U(24)
FLUSH, FLUSH_RARE = 1_000_000, 400_000
BUCKETS_PER_PARTITION = 4
#: Elements in so many documents count as frequent, or in more if the list would exceed MAX_FREQUENT.
FREQUENT = 32
MAX_FREQUENT = 1_000_000
#: Sides of at most so many ids are broadcast.
MAX_IDS = 2_000_000
SETS = "doc_id long, n long, sig_a long, sig_b long, prefix_key long, rare binary, frequent binary"


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = column_bytes(part.column("text"))
            yield part, *shingle_sets(data, offsets, k)


def _map_counts(k: int, buckets: int):
    width = -(-(1 << 40) // buckets)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.sort(np.concatenate(held)) >> SHIFT
        starts, counts = runs_of(tokens)
        tokens = tokens[starts].astype(np.int64)
        edges = np.searchsorted(tokens, np.arange(buckets + 1) * width)
        used = np.flatnonzero(np.diff(edges))
        blobs = []
        for p in used.tolist():
            own = slice(edges[p], edges[p + 1])
            blobs.append(pack(np.diff(tokens[own], prepend=p * width), counts[own]))
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, hashes, _ in _sets(batches, k):
            held.append(hashes)
            size += len(hashes)
            if size >= FLUSH:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)

    return run


def _sum_counts(buckets: int):
    width = -(-(1 << 40) // buckets)

    def run(table: pa.Table) -> pa.Table:
        low = table.column("part")[0].as_py() * width
        got = [unpack(b.as_buffer()) for b in table.column("blob")]
        tokens = np.concatenate([low + np.cumsum(g[0]) for g in got])
        counts = np.concatenate([g[1] for g in got])
        order = np.argsort(tokens, kind="stable")
        tokens, counts = tokens[order], counts[order]
        starts, _ = runs_of(tokens)
        total = np.add.reduceat(counts, starts)
        keep = total >= FREQUENT
        return pa.table({"token": pa.array(tokens[starts][keep], pa.int64()), "df": pa.array(total[keep], pa.int64())})

    return run


def _frequent(docs: DataFrame, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent elements and their frequencies, at most MAX_FREQUENT."""
    counted = docs.select("text").mapInArrow(tidy_map(_map_counts(k, buckets)), "part long, blob binary")
    frequent = cut(counted.groupBy("part").applyInArrow(tidy_group(_sum_counts(buckets)), "token long, df long"))
    magnitude = F.floor(F.log2(F.col("df"))).cast("long")
    sizes = {r["m"]: r["n"] for r in frequent.groupBy(magnitude.alias("m")).agg(F.count("*").alias("n")).collect()}
    least, total = 63, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= MAX_FREQUENT:
        least -= 1
        total += sizes.get(least, 0)
    rows = frequent.where(F.col("df") >= F.lit(1 << least)).toArrow().combine_chunks()
    tokens, df = (rows.column(c).to_numpy() for c in ("token", "df"))
    order = np.argsort(tokens)
    return tokens[order].astype(np.uint64), df[order]


def _least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * n // 100)


def _map_prefixes(k: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, df = frequent.value
        for part, hashes, ends in _sets(batches, k):
            n = np.diff(ends)
            has = n > 0
            firsts = ends[:-1][has]
            sig = np.zeros((2, len(n)), np.uint64)
            if len(hashes):
                for i, salt in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
                    sig[i, has] = np.add.reduceat(mix(hashes ^ _U(salt)), firsts)
            often = np.zeros(len(hashes), np.int64)
            if len(tokens) and len(hashes):
                at = np.minimum(np.searchsorted(tokens, hashes >> SHIFT), len(tokens) - 1)
                often = np.where(tokens[at] == hashes >> SHIFT, df[at], 0)
            rare, common, keys = [], [], []
            lengths = (n - _least_shared(n, percent) + 1) * has
            for a, b, take in zip(ends[:-1].tolist(), ends[1:].tolist(), lengths.tolist(), strict=True):
                own, own_df = hashes[a:b], often[a:b]
                light = own[own_df == 0][:take]
                heavy = own[:0]
                if len(light) < take:
                    heavy, heavy_df = own[own_df > 0], own_df[own_df > 0]
                    heavy = heavy[np.lexsort((heavy, heavy_df))][: take - len(light)]
                rare.append(light.tobytes())
                common.append(heavy.tobytes())
                prefix = np.concatenate([light, heavy])
                keys.append((mix(prefix * _U(2) + np.arange(len(prefix), dtype=np.uint64))).sum())
            arrays = [
                part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()),
                *(pa.array(s.view(np.int64), pa.int64(), mask=~has) for s in sig),
                pa.array(np.array(keys, np.uint64).view(np.int64), pa.int64()), pa.array(rare, pa.binary()), pa.array(common, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "sig_a", "sig_b", "prefix_key", "rare", "frequent"])

    return run


def _elements(batch: pa.RecordBatch, column: str):
    """(element, group, size, place in the prefix) of the prefixes."""
    data, offsets = column_bytes(batch.column(column))
    if not len(data):
        return None
    counts = np.diff(offsets) // 8
    before = np.zeros(len(counts), np.int64)
    if column == "frequent":
        before = np.diff(column_bytes(batch.column("rare"))[1]) // 8
    ends = np.cumsum(counts)
    place = np.arange(ends[-1]) - np.repeat(ends - counts - before, counts)
    gid, n = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("gid", "n"))
    return np.frombuffer(data.tobytes(), np.uint64).view(np.int64), gid, n, place


def _map_rare(buckets: int):
    def send(held) -> Iterator[pa.RecordBatch]:
        element, gid, n, place = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(element, kind="stable")
        element, gid, n, place = element[order], gid[order], n[order], place[order]
        rows = []
        to = (mix(element.view(np.uint64)) % _U(buckets)).astype(np.int64)
        for p, (e, g, s, at) in by_part(to, element, gid, n, place):
            # Sorted, so that the differences need fewer bytes than the hashes.
            rows.append((p, pack(np.diff(e, prepend=e[:1]), e[:1].repeat(len(e)), g, s, at)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if (got := _elements(batch, "rare")) is not None:
                held.append(got)
                size += len(got[0])
            if size >= FLUSH_RARE:
                yield from send(held)
                held, size = [], 0
        if size:
            yield from send(held)

    return run


def _may_link(n_a, n_b, at_a, at_b, percent: int):
    """Size filter, and position filter for the first element that two sets share."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    shared = np.minimum(n_a - at_a, n_b - at_b)
    return sizes & ((100 + percent) * shared >= percent * (n_a + n_b))


def _pair_rare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        got = [unpack(b.as_buffer()) for b in table.column("blob")]
        element, gid, n, place = (np.concatenate(c) for c in zip(*([np.cumsum(g[0]) + g[1], *g[2:]] for g in got), strict=True))
        order = np.lexsort((gid, element))
        element, gid, n, place = element[order], gid[order], n[order], place[order]
        new = np.ones(len(element), bool)
        new[1:] = element[1:] != element[:-1]
        left, pairs, step = np.arange(len(element)), [], 1
        # `left`: rows with a further row of the same element `step` rows below. Rare elements have few rows.
        run_id = np.cumsum(new)
        while True:
            left = left[left + step < len(element)]
            left = left[run_id[left] == run_id[left + step]]
            if not len(left):
                break
            ok = left[_may_link(n[left], n[left + step], place[left], place[left + step], percent)]
            pairs.append(np.stack([gid[ok], gid[ok + step]]))
            step += 1
        if not pairs:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = np.concatenate(pairs, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        new &= a != b
        return pa.table({"a": pa.array(a[new], pa.int64()), "b": pa.array(b[new], pa.int64())})

    return run


def _map_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if (got := _elements(batch, "frequent")) is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], ["element", "gid", "n", "place"])


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                (sets_a, ends_a), (sets_b, ends_b) = (shingle_sets(*column_bytes(part.column(c)), k) for c in ("text_a", "text_b"))
                linked = []
                for a, b, c, d in zip(ends_a[:-1].tolist(), ends_a[1:].tolist(), ends_b[:-1].tolist(), ends_b[1:].tolist(), strict=True):
                    both = np.concatenate([sets_a[a:b], sets_b[c:d]])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    linked.append(100 * shared >= percent * (b - a + d - c - shared) and b > a and d > c)
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _linked(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) that link."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    ids = pairs.select("a").union(pairs.select("b")).distinct()
    # Ids only; beyond the limit the texts are shuffled.
    texts = docs.join(broadcast_within(ids.withColumnRenamed("a", "doc_id"), MAX_IDS), "doc_id", "left_semi")
    side = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(
        tidy_map(_verify(k, percent)), "a long, b long"
    )


def _link_filter(a: str, b: str, percent: int):
    """`_may_link` as a condition between two sides."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    shared = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * shared >= percent * (n_a + n_b))


def similarity_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: documents link if their sets of k-word shingles have a Jaccard
    similarity of at least `percent` / 100, and component_id is the smallest doc_id that links reach.

    Words are what ASCII white space leaves, with A-Z in lower case. A text of fewer than k words is one shingle. A null or empty
    text, or one of white space, has no shingle and no link: component_id is its own doc_id. Repeated rows have
    equal sets, so they share a component; a doc_id that comes with several texts has the links of all of them. A
    row without doc_id links with nothing and has a null component_id. An empty table gives no rows. Other columns are ignored.
    """
    if not 0 < percent <= 100 or not 0 < k <= 64:
        raise ValueError("percent must lie in (0, 100] and k in [1, 64]")
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = new_folder(spark)
    frequent = spark.sparkContext.broadcast(_frequent(docs, k, buckets))
    docs.mapInArrow(tidy_map(_map_prefixes(k, percent, frequent)), SETS).write.parquet(folder)
    every = spark.read.schema(SETS).parquet(folder)
    sets = every.where("n > 0 and doc_id is not null")
    classes = cut(
        sets.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix_key").alias("prefix_key"))
    )
    groups = sets.groupBy("prefix_key", "n").agg(
        F.min("doc_id").alias("gid"), F.first("rare").alias("rare"), F.first("frequent").alias("frequent")
    )
    members = cut(
        classes.join(classes.groupBy("prefix_key", "n").agg(F.min("rep").alias("gid")), ["prefix_key", "n"])
        .select("gid", "rep")
        .distinct()
    )
    several = members.where("rep <> gid").select("gid", "rep")
    prefixes = groups.select("gid", "n", "rare", "frequent")
    rare_pairs = cut(
        prefixes.select("gid", "n", "rare")
        .mapInArrow(tidy_map(_map_rare(buckets)), "part long, blob binary")
        .groupBy("part")
        .applyInArrow(tidy_group(_pair_rare(percent)), "a long, b long")
        .distinct()
    )
    meets = cut(
        prefixes.where("length(frequent) > 0").mapInArrow(_map_frequent, "element long, gid long, n long, place long")
    )
    pivots = meets.groupBy("element").agg(F.min(F.struct("gid", "n", "place")).alias("p"), F.count("*").alias("meet")).where("meet > 1")
    pivots = pivots.select("element", "p.gid", "p.n", "p.place")
    star = (
        meets.alias("x").join(pivots.alias("p"), "element").where((F.col("x.gid") != F.col("p.gid")) & _link_filter("x", "p", percent))
        .select(F.col("p.gid").alias("a"), F.col("x.gid").alias("g"))
        .distinct()
        .join(members.withColumnRenamed("gid", "g"), "g")
        .select("a", F.col("rep").alias("b"))
    )
    within = several.select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    links = cut(_linked(docs, star.union(within).union(rare_pairs), k, percent))

    roots = star_roots(links, "a", "b")
    label = cut(
        members.join(roots, F.col("rep") == F.col("node"), "left").select("gid", "rep", F.coalesce("root", "rep").alias("label"))
    )
    # Frequent elements that still hold several labels: all that is not in the largest label meets the rest.
    held = meets.join(label, "gid").select("element", "rep", "n", "place", "label")
    mixed = (
        held.groupBy("element", "label").agg(F.count("*").alias("rows"))
        .groupBy("element").agg(F.max_by("label", F.struct("rows", "label")).alias("main"), F.count("*").alias("labels"))
        .where("labels > 1")
    )
    held = held.join(mixed.select("element", "main"), "element")
    apart = (
        held.where("label <> main").alias("x").join(held.alias("y"), "element")
        .where("x.label <> y.label and (y.label = x.main or x.rep < y.rep)")
        .where(_link_filter("x", "y", percent))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    )
    # Groups of several classes: their classes against each other, and against the groups they pair with.
    many = several.select("gid").distinct()
    wide = rare_pairs.join(many.select(F.col("gid").alias("a")), "a", "left_semi").union(
        rare_pairs.join(many.select(F.col("gid").alias("b")), "b", "left_semi").select("a", "b")
    ).union(many.select("gid", F.col("gid").alias("b")))
    one, two = (label.select(F.col("gid").alias(c), F.col("rep").alias(f"rep_{c}"), F.col("label").alias(f"label_{c}")) for c in "ab")
    across = wide.distinct().join(one, "a").join(two, "b").where("label_a <> label_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    more = _linked(docs, apart.union(across), k, percent)
    # Labels are smallest documents, so the links between labels settle the components.
    ends = label.select(F.col("rep"), F.col("label"))
    between = (
        more.join(ends.select(F.col("rep").alias("a"), F.col("label").alias("label_a")).distinct(), "a")
        .join(ends.select(F.col("rep").alias("b"), F.col("label").alias("label_b")).distinct(), "b")
        .select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    )
    last = star_roots(between, "a", "b")
    final = (
        label.select("rep", "label").distinct().join(last, F.col("label") == F.col("node"), "left")
        .select("rep", F.coalesce("root", "label").alias("component_id"))
    )
    located = classes.select("sig_a", "sig_b", "rep").join(final, "rep").select("sig_a", "sig_b", "component_id")
    return every.select("doc_id", F.col("n").alias("n_shingles"), "sig_a", "sig_b").join(located, ["sig_a", "sig_b"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def one_per_class(docs: DataFrame, columns: list[str], k: int = 5, percent: int = 80) -> DataFrame:
    """Of each class of `similarity_classes` the document with the smallest doc_id, in `columns` (doc_id and text among them).

    Rows with one doc_id are one document: each of its texts stays once, with the least other columns of the rows that have it. Rows without a doc_id stay.
    """
    folder = new_folder(docs.sparkSession)
    similarity_classes(docs, k, percent).where("doc_id = component_id").select("doc_id").write.parquet(folder)
    rows = docs.sparkSession.read.schema("doc_id long").parquet(folder).groupBy("doc_id").agg(F.count("*").alias("rows"))
    docs = docs.select(*columns)
    once = docs.join(broadcast_within(rows.where("rows = 1").select("doc_id"), MAX_IDS), "doc_id", "left_semi")
    more = docs.join(broadcast_within(rows.where("rows > 1").select("doc_id"), MAX_IDS), "doc_id", "left_semi")
    rest = [c for c in columns if c not in ("doc_id", "text")]
    least = F.min(F.struct(*rest)) if rest else F.lit(None)
    more = more.groupBy("doc_id", "text").agg(least.alias("rest")).select("doc_id", "text", *(F.col(f"rest.{c}").alias(c) for c in rest))
    parts = [part.select(*columns) for part in (once, more, docs.where("doc_id is null"))]
    return parts[0].union(parts[1]).union(parts[2])
