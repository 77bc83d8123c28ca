"""URL filters: host and path rules, and for the rest a cascade of Bloom filters, in DataFrame functions only.

Level 0 of the cascade encodes the listed keys. Level 1 encodes the unlisted keys of the universe that pass level 0 by
mistake, level 2 the listed keys that pass level 1 by mistake, and so on until no mistake is left. A key of the universe
is listed if the first level that it fails is odd. So membership is exact for all keys of the universe, and pages need no join:
the filters are literals of bounded size in the plan.

More keys than one cascade is to hold are dealt by hash to several. These are built together, level by level, stay on the executors as one row per
cascade and level, and judge all pages in one pass: each level is broadcast, up to a bound of its bytes.
"""
from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logbraid.llm.native_words import ascii_lower
from logbraid.session import cut

BITS_PER_KEY, HASHES = 10, 5
#: A byte of a filter holds seven bits, so that it is an ASCII character.
BITS = 7
#: Keys that one filter is to hold; more are split by hash into several cascades, each of which judges its own pages.
MAX_KEYS = 1_000_000
#: Bytes of one level of all cascades that are broadcast; a larger level is joined by shuffling the keys by cascade.
MAX_BROADCAST = 256 << 20
#: Bytes of a filter that come to the driver as one row.
BLOCK = 4096
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """The part after the first `://`, up to `/`, `?`, `#` or the end, with A-Z in lower case; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, action) of the longest of the rules (action, `host/path`) that fits; null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, action = F.when(fits, text).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def _bits(key: Column, level: int, size: int) -> list[Column]:
    first = F.pmod(F.xxhash64(key, F.lit(level)), F.lit(size))
    step = F.pmod(F.xxhash64(F.lit(level), key), F.lit(size))
    return [F.pmod(first + i * step, F.lit(size)) for i in range(HASHES)]


def _filter(keys: DataFrame, level: int, count: int) -> tuple[bytes, int]:
    """A Bloom filter of `count` keys; one row per BLOCK bytes of it comes to the driver."""
    size = max(64, count * BITS_PER_KEY)
    n_bytes = -(-size // BITS)
    ones = keys.select(F.explode(F.array(*_bits(F.col("key"), level, size))).alias("bit")).select(
        F.expr(f"bit div {BITS}").alias("at"), F.call_function("shiftleft", F.lit(1), F.pmod("bit", F.lit(BITS)).cast("int")).alias("bits")
    )
    every = keys.sparkSession.range(n_bytes).select(F.col("id").alias("at"), F.lit(0).alias("bits"))
    rows = (
        ones.union(every)
        .groupBy("at")
        .agg(F.bit_or("bits").alias("bits"))
        .groupBy(F.expr(f"at div {BLOCK}").alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct("at", F.char("bits").alias("byte")))).alias("bytes"))
        .select("block", F.encode(F.array_join("bytes.byte", ""), "UTF-8").alias("data"))
        .collect()
    )
    return b"".join(bytes(r.data) for r in sorted(rows, key=lambda r: r.block)), size


def _shards(universe: DataFrame) -> int:
    """Cascades for universe(key, listed): level 0 holds listed keys, level 1 unlisted ones that pass it, all others fewer of either. The
    share that passes is taken twice as large as expected."""
    n, n_listed = universe.agg(F.count("*"), F.count_if("listed")).first()
    passing = min(1, 2 * (1 - math.exp(-HASHES / BITS_PER_KEY)) ** HASHES)
    return max(1, math.ceil((n_listed + (n - n_listed) * passing) / MAX_KEYS)) if n_listed else 1


def _passes(key: Column, level: int, built: tuple[bytes, int]) -> Column:
    data, size = built
    tests = []
    for bit in _bits(key, level, size):
        inside = F.pmod(bit, F.lit(BITS))
        byte = F.substring(F.lit(data), ((bit - inside) / BITS + 1).cast("int"), F.lit(1))
        tests.append(F.call_function("shiftright", F.ascii(byte.cast("string")), inside.cast("int")).bitwiseAND(F.lit(1)) == 1)
    return reduce(lambda a, b: a & b, tests)


def cascade(universe: DataFrame) -> list[tuple[bytes, int]]:
    """The filters for universe(key, listed), whose keys are distinct."""
    levels: list[tuple[bytes, int]] = []
    encode, other = universe.where("listed").select("key"), universe.where("not listed").select("key")
    count = encode.count()
    while count:
        levels.append(_filter(encode, len(levels), count))
        wrong = cut(other.where(_passes(F.col("key"), len(levels) - 1, levels[-1])))
        encode, other, count = wrong, encode, wrong.count()
    return levels


def member(key: Column, levels: list[tuple[bytes, int]]) -> Column:
    """True if a key of the universe is listed."""
    out = F.lit(len(levels) % 2 == 1)
    for level in reversed(range(len(levels))):
        out = F.when(_passes(key, level, levels[level]), out).otherwise(F.lit(level % 2 == 1))
    return out


def _level(keys: DataFrame, level: int, shards: int, count: int) -> tuple[DataFrame, int]:
    """(shard, words array<long>), one row per cascade, of `keys`(key, shard), of which no cascade has more than `count`; and the bits of each filter."""
    n_words = max(1, -(-count * BITS_PER_KEY // 64))
    size = 64 * n_words
    ones = keys.select("shard", F.explode(F.array(*_bits(F.col("key"), level, size))).alias("bit")).select(
        (F.col("shard") * n_words + F.expr("bit div 64")).alias("at"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("bit", F.lit(64)).cast("int")).alias("bits"),
    )
    every = keys.sparkSession.range(shards * n_words).select(F.col("id").alias("at"), F.lit(0).cast("bigint").alias("bits"))
    words = ones.union(every).groupBy("at").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("at", "bits")))["bits"]
    return cut(words.groupBy(F.expr(f"at div {n_words}").alias("shard")).agg(in_order.alias("words"))), size


def _passes_level(key: Column, words: Column, level: int, size: int) -> Column:
    tests = []
    for bit in _bits(key, level, size):
        inside = F.pmod(bit, F.lit(64))
        word = F.get(words, ((bit - inside) / 64).cast("int"))
        tests.append(F.call_function("shiftright", word, inside.cast("int")).bitwiseAND(F.lit(1)) == 1)
    return reduce(lambda a, b: a & b, tests)


def _with_level(rows: DataFrame, level: int, built: tuple[DataFrame, int], shards: int) -> DataFrame:
    """Adds `f{level}`, the filter of the row's cascade on that level."""
    words, size = built
    words = words.withColumnRenamed("words", f"f{level}")
    return rows.join(F.broadcast(words) if shards * size // 8 <= MAX_BROADCAST else words, "shard")


def cascades(universe: DataFrame, shards: int) -> list[tuple[DataFrame, int]]:
    """The levels of `shards` cascades for universe(key, listed, shard), whose keys are distinct. A cascade that ends early has empty filters from there on."""

    def most(keys: DataFrame) -> int:
        return keys.groupBy("shard").count().agg(F.max("count")).first()[0] or 0

    levels: list[tuple[DataFrame, int]] = []
    encode, other = universe.where("listed").select("key", "shard"), universe.where("not listed").select("key", "shard")
    count = most(encode)
    while count:
        level = len(levels)
        levels.append(_level(encode, level, shards, count))
        tested = _with_level(other, level, levels[-1], shards)
        wrong = cut(tested.where(_passes_level(F.col("key"), F.col(f"f{level}"), level, levels[-1][1])).select("key", "shard"))
        encode, other, count = wrong, encode, most(wrong)
    return levels


def _member_of(rows: DataFrame, key: Column, levels: list[tuple[DataFrame, int]], shards: int) -> DataFrame:
    """Adds `listed`: true if a key of the universe is listed. Levels are tested one by one, so a filter is not carried past its own."""
    columns = [*rows.columns, "listed"]
    rows = rows.withColumn("listed", F.lit(None).cast("boolean"))
    for level, built in enumerate(levels):
        failed = ~_passes_level(key, F.col(f"f{level}"), level, built[1])
        answer = F.when(F.col("listed").isNull() & failed, F.lit(level % 2 == 1)).otherwise(F.col("listed"))
        rows = _with_level(rows, level, built, shards).withColumn("listed", answer).select(*columns)
    return rows.withColumn("listed", F.coalesce("listed", F.lit(len(levels) % 2 == 1)))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(page_id, host, path, rule, listed, verdict) for each row of pages(page_id, url). `listed`(host) holds the hosts to block.

    The longest fitting rule (action, `host/path`) decides; a rule fits its host and all subdomains if the path begins with the rule's.
    Without a rule, a listed host is blocked and any other allowed. A null url or one without `://` has an empty host
    and path, fits no rule with a host, and is blocked only if the empty host is listed. Null hosts in `listed` are ignored, as are
    repeated ones and hosts that no page has; repeated pages are judged one by one; either table may be empty, and other columns are ignored.
    """
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    marks = parts.select(F.col("host").alias("key"), F.lit(False).alias("listed"), F.lit(True).alias("seen")).union(
        listed.where("host is not null").select("host", F.lit(True), F.lit(False))
    )
    universe = cut(marks.groupBy("key").agg(F.max("listed").alias("listed"), F.max("seen").alias("seen")).where("seen"))
    shards = _shards(universe)
    if shards == 1:
        judged = parts.withColumn("listed", member(F.col("host"), cascade(universe)))
    else:
        shard = lambda c: F.pmod(F.xxhash64(F.lit("shard"), c), F.lit(shards))
        levels = cascades(universe.withColumn("shard", shard(F.col("key"))), shards)
        judged = _member_of(parts.withColumn("shard", shard(F.col("host"))), F.col("host"), levels, shards)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "listed", verdict.alias("verdict"))
