"""Quality rules from histograms, in DataFrame functions only.

A document is compared with its language: the Jensen-Shannon distance between its histogram of character classes, or of
common words, and that of all documents of the language. Short documents are not judged so, as their
histograms are noise.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbraid.llm.native_words import paired, split_words, with_grams, with_hashes
from logbraid.session import broadcast_within, cut, new_folder

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Character classes that are counted; what is left is one more class.
CLASSES = (r"[A-Z]", r"[0-9]", r"[.,;:'\"()?!-]", SYMBOLS)
#: Common words, eight of each language.
COMMON_WORDS = (
    "the of and to in is that it "
    "der die und zu das nicht mit sich "
    "de la le et les des que pour "
    "el los en y por con una se"
).split()
CODES = "".join(chr(0x41 + i) for i in range(len(COMMON_WORDS)))
MIN_WORDS = 50
#: Limits of the two distances: for long texts, and what is added to it over the root of the number of words, as short texts scatter more.
CHARACTER_LIMIT, WORD_LIMIT = (0.18, 1.2), (0.14, 3.0)
MAX_LANGUAGES = 10_000


def _counts(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the histograms `characters` and `common`."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("words", split_words(F.col("text"), f"{SPACE}+")).withColumn("lines", lines)
    df = with_grams(with_hashes(df, "words"), 8)
    df = df.withColumn("repeats", F.size(F.array_distinct("h8")) < F.size("h8"))
    df = df.withColumn("pairs", F.when(F.col("repeats"), F.sort_array(F.arrays_zip(F.col("h8").alias("gram"), F.sequence(F.lit(1), F.size("h8")).alias("place")))))
    gram = lambda i: F.get("pairs", i)["gram"]
    twice = F.filter(
        F.sequence(F.lit(0), F.size("pairs") - 1),
        lambda i: (gram(i) == gram(i + 1)) | ((i > 0) & (gram(i) == gram(F.greatest(i - 1, F.lit(0))))),
    )
    df = df.withColumn("places", F.when(F.col("repeats"), F.sort_array(F.transform(twice, lambda i: F.get("pairs", i)["place"]))))
    steps = paired(F.col("places"), F.col("places"), 1, F.size("places") - 1, lambda a, b: F.least(b - a, F.lit(8)))
    repeated = F.when(F.col("repeats"), F.aggregate(steps, F.lit(8), lambda total, step: total + step)).otherwise(0)
    code = F.create_map(*(F.lit(x) for pair in zip(COMMON_WORDS, CODES, strict=True) for x in pair))
    hits = F.filter("words", lambda w: w.isin(COMMON_WORDS))
    df = df.withColumn("codes", F.array_join(F.transform(hits, lambda w: F.element_at(code, w)), ""))
    spaces = F.regexp_count(text, F.lit(SPACE))
    df = df.withColumn("length", F.char_length(text)).withColumn("classes", F.array(spaces, *(F.regexp_count(text, F.lit(c)) for c in CLASSES)))
    counted = F.aggregate("classes", F.lit(0), lambda a, b: a + b)
    shares = [F.col("length") - counted, F.octet_length(text) - F.col("length")]
    n_codes = [F.length("codes") - F.length(F.replace("codes", F.lit(c), F.lit(""))) for c in CODES]
    return (
        df.withColumn("n_words", F.size("words").cast("long"))
        .withColumn("word_chars", (F.col("length") - F.element_at("classes", 1)).cast("long"))
        .withColumn("n_symbols", F.element_at("classes", len(CLASSES) + 1).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated.cast("long"))
        .withColumn("characters", F.concat("classes", F.array(*shares)).cast("array<long>"))
        .withColumn("common", F.array(*n_codes, F.size("words") - F.length("codes")).cast("array<long>"))
    )


def _shares(histogram: Column) -> Column:
    total = F.greatest(F.aggregate(histogram, F.lit(0).cast("long"), lambda a, b: a + b), F.lit(1))
    return F.transform(histogram, lambda n: n / total)


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance, from 0 to 1, between two histograms given as shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def quality_rules(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    character_limit: tuple[float, float] = CHARACTER_LIMIT,
    word_limit: tuple[float, float] = WORD_LIMIT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, the columns in `keep`, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, character_distance, word_distance, base_failed, kept, text_key = xxhash64(text))
    for each row of docs(doc_id, text, lang).

    base_failed: fewer than 20 words, or more than 30 % of the words in windows of eight words that the text has twice or more.
    kept: not base_failed, and either fewer than `min_words` words or both distances within their limits,
    which are a + b / sqrt(n_words) for a limit (a, b). A null or empty
    text has no words and fails. Rows without a language are compared with each other. Repeated rows count as often as
    they are given and come out as often; an empty table gives no rows; other columns are ignored unless named.
    """
    spark = docs.sparkSession
    folder = new_folder(spark)
    row = docs.select(
        F.col("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce("lang", F.lit("")).alias("language"),
        *(F.col(c).alias(f"kept_{c}") for c in keep),
        F.xxhash64("text").alias("text_key"),
    )
    names = ["doc_id", "text_key", "language", *(f"kept_{c}" for c in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "characters", "common"]
    _counts(row).select(*names).write.parquet(folder)
    counted = spark.read.parquet(folder)
    bins = lambda c, n: F.array(*(F.sum(F.element_at(c, i + 1)) for i in range(n)))
    languages = counted.groupBy("language").agg(
        bins("characters", len(CLASSES) + 3).alias("all_characters"), bins("common", len(COMMON_WORDS) + 1).alias("all_common")
    )
    judged = (
        counted.join(broadcast_within(languages, MAX_LANGUAGES), "language")
        .withColumn("character_distance", jensen_shannon(_shares(F.col("characters")), _shares(F.col("all_characters"))))
        .withColumn("word_distance", jensen_shannon(_shares(F.col("common")), _shares(F.col("all_common"))))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )
    root = F.sqrt(F.greatest("n_words", F.lit(1)))
    limit = lambda pair: F.lit(pair[0]) + F.lit(pair[1]) / root
    near = (F.col("character_distance") <= limit(character_limit)) & (F.col("word_distance") <= limit(word_limit))
    return judged.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") < min_words) | near)).select(
        "doc_id", *(F.col(f"kept_{c}").alias(c) for c in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "character_distance", "word_distance", "base_failed", "kept", "text_key",
    )


def rejected(docs: DataFrame) -> DataFrame:
    """(bad_id, bad_text = xxhash64(text)) of the documents that are not kept, each once."""
    bad = quality_rules(docs).where("not kept")
    return cut(bad.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_text")).distinct())
