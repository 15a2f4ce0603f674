"""Measures of predictions as aggregate columns and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binary(label: Column, predicted: Column) -> dict[str, Column]:
    """accuracy, precision, recall, f1 as aggregates; null where there is nothing to divide by."""
    tp, fp, fn = [F.count_if(t) for t in (label & predicted, ~label & predicted, label & ~predicted)]
    return {
        "accuracy": F.avg((label == predicted).cast("double")),
        "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn),
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    }


def matthews(label: Column, predicted: Column) -> Column:
    tp, fp, fn, tn = [F.count_if(t).cast("double") for t in (label & predicted, ~label & predicted, label & ~predicted, ~label & ~predicted)]
    return F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


LEVELS = 4096


def by_score(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives of each distinct score with those of equal or higher scores.

    Scores are counted, then summed up in two levels: LEVELS ranges between the least and the highest score, and the
    scores within a range; so no task has all distinct scores, and the window over ranges has at most LEVELS + 1 rows
    for each group."""
    by = by or []
    c = df.groupBy(*by, score).agg(F.count_if(F.col(label)).alias("p"), F.count_if(~F.col(label)).alias("n"))
    ends = c.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    c = c.crossJoin(F.broadcast(ends)).withColumn("_range", F.coalesce(F.floor(F.try_divide(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * LEVELS), F.lit(0))).drop("_lo", "_hi")
    higher = Window.partitionBy(*by).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy(*by, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    sums = sums.select(*by, "_range", *[F.coalesce(F.sum(x).over(higher), F.lit(0)).alias(f"_above{x}") for x in ("_p", "_n")])
    w = Window.partitionBy(*by, "_range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = c.join(sums, [*by, "_range"])
    return out.withColumn("cp", F.col("_above_p") + F.sum("p").over(w)).withColumn("cn", F.col("_above_n") + F.sum("n").over(w)).drop("_range", "_above_p", "_above_n")


def median(df: DataFrame, value: str) -> DataFrame:
    """One row with the exact median as med; null without values.

    Distinct values are counted, LEVELS ranges between the ends tell which hold the middle ranks, and only those are
    ordered within themselves; nothing passes through one task but the counts of ranges."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    ends = c.agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.sum("c").alias("_n"))
    c = c.crossJoin(F.broadcast(ends)).withColumn("_range", F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * LEVELS), F.lit(0)))
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = c.groupBy("_range").agg(F.sum("c").alias("_c")).select("_range", F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_at"), "_c")
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = c.join(F.broadcast(starts), "_range").where((F.col("_at") <= high) & (F.col("_at") + F.col("_c") > low))
    w = Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = middle.withColumn("_first", F.col("_at") + F.coalesce(F.sum("c").over(w), F.lit(0)))
    inside = lambda rank: (F.col("_first") <= rank) & (F.col("_first") + F.col("c") > rank)
    return placed.agg(((F.max(F.when(inside(low), F.col("v"))) + F.max(F.when(inside(high), F.col("v")))) / 2).alias("med"))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; null for one class."""
    c = by_score(df, label, score, by)
    wins = F.sum(F.col("n") * (F.col("cp") - F.col("p")) + F.col("n") * F.col("p") / 2)
    return c.groupBy(*(by or [])).agg(F.try_divide(wins, F.sum("p").cast("double") * F.sum("n")).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    c = by_score(df, label, score)
    return c.agg(F.try_divide(F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cn"))), F.sum("p")).alias("ap"))
