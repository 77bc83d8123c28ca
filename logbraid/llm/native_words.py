"""Column expressions over arrays of words: each is a chain of built-in functions, so no step leaves the JVM."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """What the regular expression `separators` leaves; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def paired(left: Column, right: Column, shift: int, length: Column, f: Callable) -> Column:
    """f(left[i], right[i + shift]) for the first `length` places."""
    n = F.greatest(length, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(shift + 1), n), f)


def with_hashes(df: DataFrame, words: str, name: str = "h1") -> DataFrame:
    return df.withColumn(name, F.transform(words, lambda w: F.xxhash64(w)))


def with_grams(df: DataFrame, k: int, prefix: str = "h") -> DataFrame:
    """Adds h2, h4, ... and h{k}, the hashes of k words in a row, from h1, by joining hashes of powers of two."""
    join = lambda a, b: F.xxhash64(a, b)
    have = 1
    while have * 2 <= k:
        one = F.col(f"{prefix}{have}")
        df = df.withColumn(f"{prefix}{have * 2}", paired(one, one, have, F.size(one) - have, join))
        have *= 2
    while have < k:
        step = 1
        while step * 2 <= k - have:
            step *= 2
        one, two = F.col(f"{prefix}{have}"), F.col(f"{prefix}{step}")
        df = df.withColumn(f"{prefix}{have + step}", paired(one, two, have, F.size(one) - step, join))
        have += step
    return df


def with_window_minima(df: DataFrame, column: str, window: int, name: str) -> DataFrame:
    """Adds the least value of each `window` neighbours; `window` is a power of two."""
    have = 1
    while have < window:
        one = F.col(column if have == 1 else f"{name}_{have}")
        df = df.withColumn(f"{name}_{have * 2}", paired(one, one, have, F.size(one) - have, lambda a, b: F.least(a, b)))
        have *= 2
    return df.withColumn(name, F.array_distinct(column if window == 1 else f"{name}_{window}"))
