"""Column builders on token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hits(a: Column, pattern: list[int]) -> Column:
    """0-based positions of all, also overlapping, occurrences of the pattern; empty for a longer pattern."""
    m = len(pattern)

    def here(i):
        test = F.get(a, i) == pattern[0]
        for j in range(1, m):
            test &= F.get(a, i + j) == pattern[j]
        return test

    return F.when(F.size(a) >= m, F.filter(F.sequence(F.lit(0), F.size(a) - m), here)).otherwise(F.array().cast("array<int>"))


def pad(a: Column, length: int, value: int, left: bool = False) -> Column:
    """Cut or filled up to the length."""
    cut = F.slice(a, 1, length)
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def ngrams(a: Column, n: int) -> Column:
    return F.when(F.size(a) >= n, F.transform(F.sequence(F.lit(1), F.size(a) - n + 1), lambda i: F.slice(a, i, n))).otherwise(F.array())


def count_of(a: Column, value: int) -> Column:
    return F.size(F.filter(a, lambda x: x == value))


def hash_unit(key: Column) -> Column:
    """A reproducible number in [0, 1) from a key, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") / 4294967296
