"""A filter of ids that tells, before any shuffle, which rows of a large table cannot be among them.

A Bloom filter as rows (block, words): a key sets two bits of one block of 32 768 bits. Its size follows the number of ids up to MAX_BITS, so what is
broadcast is bounded; a row that passes may be among the ids or not, one that fails is not.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 16 bits for each id let 2 % of the other ids pass.
BITS_PER_ID = 16
#: 32 MB. With more than a fourth as many ids as bits, too much would pass and no filter is built.
MAX_BITS = 1 << 28
_BLOCK_WORDS = 512
_BLOCK_BITS = 64 * _BLOCK_WORDS


def _places(key: list[str], blocks: int) -> tuple[Column, Column, Column]:
    """The block of a key and its two bits there; they come from different bits of the hash."""
    h = F.xxhash64(*key)
    place = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(_BLOCK_BITS - 1)).cast("int")
    return F.pmod(h, F.lit(blocks)), place(34), place(49)


def _blocks(ids: DataFrame, key: list[str], blocks: int) -> DataFrame:
    block, one, two = _places(key, blocks)
    bits = ids.select(block.alias("block"), F.explode(F.array(one, two)).alias("bit")).select(
        (F.col("block") * _BLOCK_WORDS + F.expr("bit div 64")).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.expr("bit % 64").cast("int")).alias("bits"),
    )
    every = ids.sparkSession.range(blocks * _BLOCK_WORDS).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = bits.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return words.groupBy(F.expr(f"word div {_BLOCK_WORDS}").alias("_block")).agg(in_order["bits"].alias("_words"))


def maybe_among(rows: DataFrame, ids: DataFrame, key: list[str], n_ids: int | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows whose `key` may be among `ids`; all rows whose key is, and few others. `n_ids` is the number of ids, if it is known. Keys with a null are
    kept or not: they equal nothing."""
    if n_ids is None:
        n_ids = ids.count()
    if n_ids == 0:
        return rows.limit(0)
    if 4 * n_ids > max_bits:
        return rows
    blocks = -(-min(BITS_PER_ID * n_ids, max_bits) // _BLOCK_BITS)
    block, one, two = _places(key, blocks)
    has = lambda bit: F.call_function("shiftright", F.get("_words", F.expr(f"{bit} div 64")), F.expr(f"{bit} % 64")).bitwiseAND(F.lit(1)) == 1
    return (
        rows.withColumns({"_block": block, "_one": one, "_two": two})
        .join(F.broadcast(_blocks(ids, key, blocks)), "_block")
        .where(has("_one") & has("_two"))
        .select(*rows.columns)
    )
