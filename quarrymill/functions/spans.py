"""Column builders on scored character spans: array<struct<start,end,score>>, offsets 0-based in code points, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def typed(raw: Column) -> Column:
    """array<array<double>> of [start, end, score] as typed spans; malformed entries are dropped, null stays null."""
    good = F.filter(raw, lambda s: F.coalesce((F.size(s) == 3) & ~F.exists(s, lambda v: v.isNull()), F.lit(False)))
    return F.transform(good, lambda s: F.struct(F.get(s, 0).cast("int").alias("start"), F.get(s, 1).cast("int").alias("end"), F.get(s, 2).alias("score")))


def scores(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["score"])


def count_where(spans: Column, test) -> Column:
    """How many spans pass a test of their score."""
    return F.size(F.filter(spans, lambda s: test(s["score"])))


def share_above(spans: Column, limit: float) -> Column:
    """The share of spans with a score of at least limit; null without spans."""
    return F.try_divide(count_where(spans, lambda v: v >= limit), F.nullif(F.size(spans), F.lit(0)))


def label(score: Column, safe: float, toxic: float) -> Column:
    """1 above toxic, 0 below safe, -1 in between."""
    return F.when(score > toxic, 1).when(score < safe, 0).otherwise(-1)


def mask_code(score: Column, safe: float, toxic: float) -> Column:
    """3 above toxic, 2 above safe, 1 else; exactly at safe this is 1 where label gives -1."""
    return F.when(score > toxic, 3).when(score > safe, 2).otherwise(1)


def excise(text: Column, spans: Column, limit: float, inclusive_end: bool = True) -> Column:
    """The text without the spans whose score exceeds limit.

    With inclusive_end the character at the end offset, usually the blank behind the sentence, goes too.
    """
    skip = 1 if inclusive_end else 0
    hot = F.reverse(F.filter(spans, lambda s: s["score"] > limit))
    return F.aggregate(hot, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.substring(acc, s["end"] + 1 + skip, F.length(acc))))


def shifted(spans: Column, limit: float) -> Column:
    """The spans that excise keeps, moved left by what it removes before them."""
    def before(s):
        return F.aggregate(F.filter(spans, lambda x: (x["score"] > limit) & (x["start"] < s["start"])), F.lit(0), lambda n, x: n + x["end"] - x["start"] + 1)

    return F.transform(F.filter(spans, lambda s: ~(s["score"] > limit)), lambda s: F.struct((s["start"] - before(s)).alias("start"), (s["end"] - before(s)).alias("end"), s["score"].alias("score")))
