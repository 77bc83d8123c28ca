"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of all hashes of `K` words in a row, the least of each `WINDOW` neighbours is a fingerprint of its text. Two texts that share
K + WINDOW - 1 words share a fingerprint. Texts with a fingerprint of a benchmark item are candidates; only in these
are the hits extended to whole windows of words and compared as words, so the result is exact.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbraid.llm.native_words import ascii_lower, split_words, with_grams, with_hashes, with_window_minima
from logbraid.session import broadcast_within, cut

WINDOW = 8
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_A_WORD_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Tables of at most so many rows of some 100 bytes are broadcast; larger ones are shuffled.
MAX_ROWS = 200_000


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", split_words(ascii_lower(F.col("text")), NOT_A_WORD))


def _windows(df: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """(keep, at, length, gram): the words of each window of each of `lengths` words, and its first place, from 0."""

    def of(length: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("words") - (length - 1))
        gram = lambda i: F.struct(
            (i - 1).alias("at"), F.lit(length).alias("length"), F.array_join(F.slice("words", i, F.lit(length)), " ").alias("gram")
        )
        return F.when(F.size("words") >= length, F.transform(starts, gram))

    none = F.array().cast("array<struct<at:int,length:int,gram:string>>")
    every = of(lengths[0]) if len(lengths) == 1 else F.concat(*(F.coalesce(of(n), none) for n in lengths))
    # Outer, as an inner explode would be preceded by a filter that evaluates the whole array, and its words for each element, again.
    return df.select(*keep, F.explode_outer(every).alias("window")).where("window is not null").select(*keep, "window.*")


def _fingerprints(df: DataFrame, k: int) -> DataFrame:
    return with_window_minima(with_grams(with_hashes(df, "words"), k), f"h{k}", WINDOW, "fingerprints")


def _marks(df: DataFrame, k: int, lengths: list[int]) -> DataFrame:
    """Adds fingerprints, and h{n} for each n of `lengths`: the hash of each n words in a row, which finds items of n words."""
    df = _fingerprints(df, k)
    for n in lengths:
        df = with_grams(df, n)
    return df


def contamination(docs: DataFrame, items: DataFrame, span: int = 13) -> DataFrame:
    """(doc_id, text_key = xxhash64(text), n_words, n_hit, n_items, item_ids array<string>) for each row of docs(doc_id, text), against items(item_id, text).

    Words are runs of 0-9, a-z and characters beyond ASCII, after A-Z became lower case. A window is `span` words in a
    row of an item, or a whole item of fewer words. n_hit counts the words of a document inside any occurrence of a window;
    item_ids are the items with such a window, as sorted strings. A null or empty text has no words, and hits nothing. Repeated rows are judged
    one by one, also with equal or null doc_id; an item given twice counts once by its item_id, and null item_ids do not count as items though their
    windows hit. Empty tables and texts of any length are fine; other columns are ignored.
    """
    if span < WINDOW + 1:
        raise ValueError(f"span must be at least {WINDOW + 1}")
    k = span - WINDOW + 1
    key = ["doc_id", "text_key"]
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    items = cut(_words(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))).select("item_id", "words"))
    worded = _words(docs).select(*key, "words")

    # At most span - 1 rows: the lengths of items that are shorter than a window.
    few = F.size("words").alias("n")
    short = sorted(r["n"] for r in items.select(few).where(f"n > 0 and n < {span}").distinct().collect())
    marked = _marks(items, k, short)
    whole = reduce(lambda other, n: F.when(F.size("words") == n, F.get(f"h{n}", F.lit(0))).otherwise(other), short, F.lit(None).cast("bigint"))
    own = F.when(F.size("words") < span, F.array(whole)).otherwise(F.col("fingerprints"))
    prints = marked.select(F.explode_outer(own).alias("fingerprint")).where("fingerprint is not null").distinct()
    theirs = F.concat("fingerprints", *(f"h{n}" for n in short)) if short else F.col("fingerprints")
    found = (
        _marks(worded, k, short)
        .select(*key, F.explode_outer(theirs).alias("fingerprint"))
        .join(broadcast_within(prints, MAX_ROWS), "fingerprint", "left_semi")
        .select(*key)
        .distinct()
    )
    found = cut(found)
    candidates = worded.alias("d").join(broadcast_within(found, MAX_ROWS).alias("f"), _same("d", "f"), "left_semi")

    size = F.size("words")
    windows = _windows(items, [span], ["item_id"]).select("item_id", "gram").union(
        items.where((size > 0) & (size < span)).select("item_id", F.array_join("words", " "))
    )
    windows = windows.distinct()
    every = _windows(candidates, [span, *short], key).join(broadcast_within(windows, MAX_ROWS), "gram").select(*key, "item_id", "at", "length")
    every = cut(every)
    covered = (
        every.select(*key, "at", "length").distinct()
        .select(*key, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("length") - 1)).alias("word"))
        .distinct().groupBy(*key).agg(F.count("*").alias("n_hit"))
    )
    listed = (
        every.select(*key, "item_id").distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    )
    judged = covered.alias("c").join(listed.alias("i"), _same("c", "i"), "inner").select("c.doc_id", "c.text_key", "n_hit", "item_ids")
    counted = docs.select(*key, F.size(split_words(F.col("text"), NOT_A_WORD_ANY_CASE)).cast("long").alias("n_words"))
    return counted.alias("d").join(judged.alias("j"), _same("d", "j"), "left").select(
        "d.doc_id",
        "d.text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def _same(a: str, b: str):
    return (F.col(f"{a}.text_key") == F.col(f"{b}.text_key")) & F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id"))


def contaminated(docs: DataFrame, items: DataFrame, span: int = 13, share: int = 20) -> DataFrame:
    """(bad_id, bad_text = xxhash64(text)) of the documents of which at least one word in `share` is hit; each once."""
    bad = contamination(docs, items, span).where(f"n_hit > 0 and {share} * n_hit >= n_words")
    return cut(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_text")).distinct())
