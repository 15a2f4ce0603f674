"""Row filters of the corpus pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions import arrays, spans


def ingest(df: DataFrame, text: str, score: str, min_length: int, min_score: float) -> DataFrame:
    return df.where((F.length(text) >= min_length) & (F.col(score) >= min_score))


def toxic_mix(df: DataFrame, min_english: float = 0.5, min_toxic: float = 0.9, max_clean: float = 0.1) -> DataFrame:
    """English documents with toxic and clean spans; expects english_score, toxic_score and typed spans."""
    v = spans.scores(F.col("spans"))
    return df.where((F.col("english_score") >= min_english) & (F.col("toxic_score") >= min_toxic) & (F.size("spans") > 1) & (F.array_max(v) >= min_toxic) & (F.array_min(v) <= max_clean))


def non_toxic(df: DataFrame, min_english: float = 0.5, max_toxic: float = 0.1) -> DataFrame:
    v = spans.scores(F.col("spans"))
    return df.where((F.col("english_score") >= min_english) & (F.col("toxic_score") <= max_toxic) & (F.size("spans") > 1) & (F.array_max(v) <= max_toxic))


def toxic_ratio(df: DataFrame, min_toxic: float = 0.9, max_clean: float = 0.1, min_ratio: float = 0.3) -> DataFrame:
    v = spans.scores(F.col("spans"))
    return df.where((F.size("spans") > 1) & (F.array_max(v) >= min_toxic) & (F.array_min(v) <= max_clean) & (spans.share_above(F.col("spans"), min_toxic) >= min_ratio))


def clean_only(df: DataFrame, limit: float = 0.1) -> DataFrame:
    """No span above the limit; documents without spans are dropped."""
    return df.where(F.array_max(spans.scores(F.col("spans"))) <= limit)


def share_between(df: DataFrame, low: float, high: float, limit: float) -> DataFrame:
    share = F.try_divide(spans.count_where(F.col("spans"), lambda v: v > limit), F.nullif(F.size("spans"), F.lit(0)))
    return df.where((share >= low) & (share < high))


def exclude_any(df: DataFrame, *tests: Column) -> DataFrame:
    """Rows for which none of the tests is true."""
    bad = F.lit(False)
    for t in tests:
        bad = bad | F.coalesce(t, F.lit(False))
    return df.where(~bad)


def not_listed(df: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """Anti join with a block list of one column of that name; null values are kept."""
    return df.join(listed, column, "left_anti")


def outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(column) <= low) | (F.col(column) >= high))


def has_word(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def has_pattern(a: Column, pattern: list[int]) -> Column:
    return F.size(arrays.hits(a, pattern)) > 0


def conversations(pairs: DataFrame, english: float, bad: float, good: float) -> DataFrame:
    """Pairs in English whose parent is toxic or nsfw (at least bad) and whose child is neither (at most good).

    Expects parent_ and child_ columns of english, toxic and nsfw scores; a null score excludes the pair where it decides."""
    p, c = lambda k: F.col("parent_" + k), lambda k: F.col("child_" + k)
    return pairs.where((p("english") >= english) & (c("english") >= english) & ((p("toxic") >= bad) | (p("nsfw") >= bad)) & (c("toxic") <= good) & (c("nsfw") <= good))


def mentions_any(df: DataFrame, key: str, text: str, names: DataFrame, name: str) -> DataFrame:
    """Distinct keys of the texts that hold any of the names as a word between blanks: a semi-join on words, for lists of any length."""
    words = df.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("_w"))
    return words.join(names.select(F.col(name).alias("_w")), "_w", "left_semi").select(key).distinct()
