"""Reproducible orders, samples, splits and running sums that don't need one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible shuffle: order by this."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def numbered(df: DataFrame, by: Column, name: str = "pos", digits: int = 4, by_key: list[str] = ()) -> DataFrame:
    """0-based positions in the order of a hexadecimal digest: counts of the digest's first digits give the offsets, row
    numbers within them the rest, so that no task sorts more than its share. Four digits make 65 536 buckets of about
    equal size, within each value of by_key; rows that are equal in `by` are numbered by chance."""
    keyed = df.withColumn("_by", by).withColumn("_bucket", F.conv(F.substring("_by", 1, digits), 16, 10).cast("bigint"))
    return _offset(keyed, F.lit(1), name, ["_by"], row=True, by=list(by_key))


def running(df: DataFrame, value: Column, order: list[str], bucket: Column, name: str, by: list[str] = ()) -> DataFrame:
    """The sum of value over all rows before (of equal `by`), in the order of the integer bucket and then `order`."""
    return _offset(df.withColumn("_bucket", bucket.cast("bigint")), value, name, order, row=False, by=list(by))


GROUP = 4096  # buckets in a group of buckets


def _offset(df: DataFrame, value: Column, name: str, order: list[str], row: bool, by: list[str] = ()) -> DataFrame:
    """Three levels: sums of groups of GROUP buckets, of buckets within their group, of rows within their bucket. The only
    window without a key is over groups of buckets, a few rows for each million buckets."""
    by = list(by)
    valued = df.withColumn("_v", value)
    sums = valued.groupBy(*by, "_bucket").agg(F.sum("_v").alias("_s")).withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    up_to = lambda keys, at: Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    groups = sums.groupBy(*by, "_group").agg(F.sum("_s").alias("_t"))
    groups = groups.select(*by, "_group", (F.sum("_t").over(up_to(by, "_group")) - F.col("_t")).alias("_far"))
    before = sums.join(groups, [*by, "_group"]).select(*by, "_bucket", (F.col("_far") + F.sum("_s").over(up_to([*by, "_group"], "_bucket")) - F.col("_s")).alias("_before"))
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    inner = F.row_number().over(within) - 1 if row else F.sum("_v").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v")
    out = valued.join(before, [*by, "_bucket"]).withColumn(name, (F.col("_before") + inner).cast("bigint"))
    return out.drop("_bucket", "_before", "_v", *(["_by"] if row else []))


def balanced(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows of each label, by hash order."""
    w = Window.partitionBy(label).orderBy(hash_order(F.col(key), seed))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def indexed(lines: DataFrame, line: str, df: DataFrame, key: str) -> DataFrame:
    """step, place (from 1) and the row of df for every id in lines of a step and ids, separated by tabs."""
    parts = F.split(line, "\t")
    each = lines.select(F.get(parts, F.lit(0)).cast("bigint").alias("step"), F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("_p", "_id"))
    return each.select("step", (F.col("_p") + 1).cast("bigint").alias("place"), F.col("_id").cast("bigint").alias(key)).join(df, key)


def nucleus(logits: Column, p: float) -> Column:
    """0-based positions of the smallest set of most likely values whose probability passes p; ties by position."""
    order = F.array_sort(F.transform(logits, lambda x, k: F.struct((-x).alias("x"), k.alias("k"))))
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))

    def step(acc, s):
        return F.struct((acc["sum"] + F.exp(-s["x"]) / total).alias("sum"), F.when(acc["sum"] <= p + 1e-9, F.concat(acc["kept"], F.array(s["k"]))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(order, start, step)["kept"]


def assign_ranges(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """points joined with the ranges [start, end) they lie in: an equi-join on buckets of `width`, each range in the
    buckets it touches. Points in no range have no row; ranges much longer than width touch many buckets."""
    cut = ranges.where(F.col(start) < F.col(end)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("_bucket", F.floor(F.col(point) / width)).join(cut, "_bucket").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bucket")


def proportions(text: str, n: int) -> list[int]:
    """Boundaries of three parts of n rows from "a,b,c" or "a/b/c": missing shares are 0, shares are normalised, the
    boundaries rounded, and what rounding leaves over is taken from each of them."""
    shares = [float(x) for x in text.replace("/", ",").split(",") if x.strip()][:3]
    shares += [0.0] * (3 - len(shares))
    total = sum(shares)
    if total <= 0:
        raise ValueError(f"no shares in {text!r}")
    ends = [0]
    for x in shares:
        ends.append(ends[-1] + round(x / total * n))
    over = ends[-1] - n
    return [0, *[e - over for e in ends[1:]]]


def named_parts(df: DataFrame, pos: str, sizes: dict[str, int], n: int) -> DataFrame:
    """The rows of a numbered frame with the name of their part; a size of -1 takes all that is left.

    Raises ValueError if the parts are larger than the n rows."""
    if sum(max(k, 0) for k in sizes.values()) > n:
        raise ValueError(f"the parts need {sum(max(k, 0) for k in sizes.values())} of {n} rows")
    at, name = 0, F.lit(None).cast("string")
    for part, size in sizes.items():
        end = n if size < 0 else at + size
        name = F.when((F.col(pos) >= at) & (F.col(pos) < end), part).otherwise(name)
        at = end
    return df.withColumn("part", name).where("part is not null")
