"""Column expressions on text that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is neither letter, digit, mark nor white space.
NOISE = r"[^\p{L}\p{N}\p{M}\p{Z}\s]+"
BLANK = r"[\p{Z}\s]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, even where the optimizer merges projections into lambdas or filters."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """Lower-case words without punctuation; null for null."""
    clean = F.regexp_replace(F.lower(text), NOISE, "")
    return F.filter(F.split(clean, BLANK), lambda w: w != "")


def ngram_hashes(tokens: Column, n: int) -> Column:
    """The 64-bit hashes of the n-grams of an array of words, in order; empty where there are fewer than n words."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)])),
    ).otherwise(F.array().cast("array<bigint>"))
