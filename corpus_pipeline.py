"""A pipeline over `documents`: each stage works on all rows the one before it kept, and its decisions take effect.

Rows that share a doc_id are one document: from the second stage on each of its texts is there once. Every stage but the last returns the
columns of `documents`; the last returns where each piece of each document is packed.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logbraid.session import broadcast_within, new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Sides of at most so many ids are broadcast; beyond that the texts are shuffled.
MAX_IDS = 2_000_000


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """Documents that are not in `bad` (bad_id, bad_text = xxhash64(text))."""
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_text"])
    return docs.join(broadcast_within(bad, MAX_IDS), same, "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    from logbraid.llm.quality_rules import rejected

    return _without(docs, rejected(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 80 % of five-word shingles hold together, the document with the smallest doc_id stays. Documents without a
    word or an id are in no group."""
    from logbraid.llm.ngram_join import one_per_class

    return one_per_class(docs, list(COLUMNS), k=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that an earlier document has are cut out; a document of which nothing stays goes."""
    from logbraid.llm.suffix_dedup import remove_repeats

    rest = remove_repeats(docs, keep=("lang", "source"), as_text=True)
    return rest.where("n_removed < n_bytes or n_bytes = 0").select(
        "doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars")
    )


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in 13-word windows of the benchmark go."""
    from logbraid.llm.decontamination import contaminated

    return _without(docs, contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens."""
    import public_tokenizers

    from logbraid.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Tokens cannot be made in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        folder = new_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
