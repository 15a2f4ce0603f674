"""Operators on token arrays and their masks: building rows, trimming, masking, collating, windows and packing.

All are column expressions of one row, except collate (one join on the batch) and the packing, which needs the tokens
before each row (two-level running sums).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import let
from quarrymill.operators.ordering import running

VOCABULARY = 50021
WORD = "[^ \\t\\n\\r\\f]+"


def word_ids(text: Column) -> Column:
    """The words of a text (between blanks) as ids of a hashed vocabulary; the same in any engine with md5."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % VOCABULARY)


def segments(text: Column, spans: Column) -> Column:
    """Every span with the gap before it, as texts."""
    return let(spans, lambda s: F.transform(s, lambda x, i: F.substring(text, F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"]) + 1, F.greatest(x["end"] - F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"]), F.lit(0)))))


def labelled_tokens(text: Column, spans: Column, code, tokenize=word_ids) -> Column:
    """A struct of ids (the segments' tokens one after the other) and mask (the code of each segment's span, repeated for its tokens)."""

    def both(each):
        mask = F.flatten(F.zip_with(each, spans, lambda t, s: F.array_repeat(code(s["score"]), F.size(t))))
        return F.struct(F.flatten(each).alias("ids"), mask.alias("mask"))

    return let(F.transform(segments(text, spans), tokenize), both)


def kept_positions(key: Column, ids: Column, share: float, banned: list[int] = ()) -> Column:
    """0-based positions of a reproducible share of the tokens (those of the smallest hashes), without banned tokens, in order."""
    order = F.array_sort(F.transform(ids, lambda x, k: F.struct(F.md5(F.concat_ws(":", key, k)).alias("h"), k.alias("k"), x.alias("x"))))
    some = F.slice(order, F.lit(1), F.floor(F.size(ids) * share + 1e-9).cast("int"))
    return F.array_sort(F.transform(F.filter(some, lambda s: ~s["x"].isin(*banned)) if banned else some, lambda s: s["k"]))


def fill(a: Column, length: int, value, left: bool = False) -> Column:
    """Filled up to the length; longer arrays stay."""
    more = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0)))
    return F.concat(more, a) if left else F.concat(a, more)


def zeros(a: Column) -> Column:
    return F.array_repeat(F.lit(0), F.size(a))


def ones(a: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(a))


def fair_trim(x: Column, y: Column, length: int) -> tuple[Column, Column]:
    """Two token lists cut so that both fit into length: the longer one gives way first, then both to half."""
    n, m, half = F.size(x), F.size(y), length // 2
    nx = F.when(n + m <= length, n).when(m <= half, F.lit(length) - m).when(n <= length - half, n).otherwise(length - half)
    return F.slice(x, F.lit(1), nx), F.slice(y, F.lit(1), F.lit(length) - F.least(n, nx))


def reply_row(x: Column, y: Column, length: int, left: bool = False, pad: int = 0) -> tuple[Column, Column]:
    """ids and mask of context x and reply y: the mask is 1 on the reply only; both are filled up."""
    return fill(F.concat(x, y), length, pad, left), fill(F.concat(zeros(x), ones(y)), length, 0, left)


def occurs(a: Column, k: Column, pattern: list[int]) -> Column:
    """Whether the pattern stands in a at the 0-based position k; false where it would reach over an end."""
    test = k >= 0
    for j, p in enumerate(pattern):
        test &= F.coalesce(F.get(a, F.greatest(k, F.lit(0)) + j) == p, F.lit(False))
    return test


def in_pattern(a: Column, k: Column, patterns: list[list[int]], chosen=None) -> Column:
    """Whether position k lies in an occurrence of a pattern; chosen(start) may leave out occurrences."""
    test = F.lit(False)
    for p in patterns:
        for j in range(len(p)):
            one = occurs(a, k - j, p)
            test |= one & chosen(k - j) if chosen else one
    return test


def pattern_mask(a: Column, patterns: list[list[int]]) -> Column:
    """0 on tokens of any occurrence of a pattern, 1 elsewhere."""
    return F.transform(a, lambda x, k: F.when(in_pattern(a, k, patterns), 0).otherwise(1))


def pattern_labels(key: Column, a: Column, pattern: list[int], p: float, ignored: int = -100) -> Column:
    """The tokens with `ignored` on each occurrence of the pattern that its hash chooses with probability p; overlaps merge."""

    def chosen(k):
        return F.conv(F.substring(F.md5(F.concat_ws(":", key, k)), 1, 8), 16, 10).cast("bigint") / 4294967296 < p

    return F.transform(a, lambda x, k: F.when(in_pattern(a, k, [pattern], chosen), ignored).otherwise(x))


def chat_row(turns: Column, length: int, pad: int = 0, tokenize=word_ids) -> tuple[Column, Column]:
    """ids and mask of turns (array of role, content): a header of the role, the content and an end token for each; the
    mask is 1 on the content of the assistant, but not on the end token; cut and filled up to the length."""
    each = F.transform(turns, lambda t: F.struct(tokenize(F.concat(F.lit("<|"), t["role"], F.lit("|>"))).alias("h"), tokenize(t["content"]).alias("c"), (t["role"] == "assistant").alias("own")))
    end = F.lit(VOCABULARY)
    ids = F.flatten(F.transform(each, lambda t: F.concat(t["h"], t["c"], F.array(end))))
    mask = F.flatten(F.transform(each, lambda t: F.concat(zeros(t["h"]), F.array_repeat(F.when(t["own"], 1).otherwise(0), F.size(t["c"])), F.array(F.lit(0)))))
    return fill(F.slice(ids, 1, length), length, pad), fill(F.slice(mask, 1, length), length, 0)


def collate(df: DataFrame, batch: Column, columns: dict[str, object], left: bool = False) -> DataFrame:
    """List columns filled up to the longest of their batch with the given values; adds width.

    The widths come from the sizes alone; the lists only take part in one join.
    """
    first = next(iter(columns))
    keyed = df.withColumn("_batch", batch)
    widths = keyed.groupBy("_batch").agg(F.max(F.size(first)).alias("width"))
    both = keyed.join(widths, "_batch").drop("_batch")
    for c, value in columns.items():
        more = F.array_repeat(F.lit(value), F.col("width") - F.size(c))
        both = both.withColumn(c, F.concat(more, c) if left else F.concat(c, more))
    return both


def rolling_windows(a: Column, length: int, context: int, prefix: int) -> Column:
    """Windows that predict every token once with at least `context` - 1 tokens before them: array of start, inputs, targets.

    The first one predicts up to `length` tokens from the prefix token on, each further one up to length - context + 1.
    """
    n, step = F.size(a), length - context + 1
    more = F.when(n > length, F.sequence(F.lit(length), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def one(s):
        end = F.least(F.when(s == 0, length).otherwise(s + step), n)
        inputs = F.when(s == 0, F.concat(F.array(F.lit(prefix)), F.slice(a, F.lit(1), end - 1))).otherwise(F.slice(a, F.greatest(end - length, F.lit(1)), F.lit(length)))
        return F.struct(s.alias("start"), inputs.alias("inputs"), F.slice(a, s + 1, end - s).alias("targets"))

    return F.transform(F.concat(F.array(F.lit(0)), more), one)


def truncate(a: Column, length: int, end: int, left: bool = False) -> Column:
    """At most length tokens with an end token last: cut on the right or the left, the end token put in if it isn't there."""
    body = F.when(F.element_at(a, -1) == end, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    n = F.size(body)
    kept = F.slice(body, F.greatest(n - (length - 2), F.lit(1)), F.lit(length - 1)) if left else F.slice(body, 1, length - 1)
    return F.concat(kept, F.array(F.lit(end)))


def placed(df: DataFrame, key: str, ids: str, shard: Column | None = None, bucket: int = 256) -> DataFrame:
    """Rows with n (tokens and an end token), g (tokens before it in the order of the integer key) and shard."""
    rows = df.withColumn("n", F.size(ids) + 1).withColumn("shard", F.lit(0).cast("bigint") if shard is None else shard)
    return running(rows, F.col("n"), [key], F.floor(F.col(key) / bucket), "g", by=["shard"])


def pack(df: DataFrame, key: str, columns: dict[str, int], length: int, shard: Column | None = None, overlap: int = 0) -> DataFrame:
    """Rows in the order of key, each with an end value, concatenated and cut into sequences of length + overlap tokens.

    columns maps list columns of equal lengths to their end values; the first is the ids. A last partial sequence is
    dropped, in each shard its own. With overlap, the last tokens of a sequence are the first of the next.
    Returns shard, seq and the columns.
    """
    first = next(iter(columns))
    o = placed(df, key, first, shard)
    total = o.groupBy("shard").agg(F.sum("n").alias("total"))
    lo_seq, hi_seq = F.greatest(F.ceil((F.col("g") - (length + overlap) + 1) / length), F.lit(0)), F.floor((F.col("g") + F.col("n") - 1) / length)
    rows = o.select("shard", "g", "n", *[F.concat(c, F.array(F.lit(e))).alias(c) for c, e in columns.items()], F.explode(F.sequence(lo_seq, hi_seq)).alias("seq"))
    lo = F.greatest(F.col("seq") * length - F.col("g"), F.lit(0))
    hi = F.least((F.col("seq") + 1) * length + overlap - F.col("g"), F.col("n"))
    cut = rows.join(F.broadcast(total), "shard").where((F.col("seq") + 1) * length + overlap <= F.col("total"))  # one row for each shard
    parts = cut.select("shard", "seq", F.struct("g", *[F.slice(c, (lo + 1).cast("int"), (hi - lo).cast("int")).alias(c) for c in columns]).alias("p"))
    whole = parts.groupBy("shard", "seq").agg(F.sort_array(F.collect_list("p")).alias("p"))  # at most length + overlap rows each

    def parts_of(c):
        return F.flatten(F.transform("p", lambda x: x[c])).alias(c)

    return whole.select("shard", "seq", *[parts_of(c) for c in columns])


def blocks(df: DataFrame, key: str, size: str, limit: int) -> DataFrame:
    """Rows with a block number within their size: as many of one size as fit into limit, by key. Sizes over the limit are alone."""
    per = F.greatest(F.floor(F.lit(limit) / F.col(size)), F.lit(1))
    numbered = running(df, F.lit(1), [key], F.floor(F.col(key) / 4096), "_k", by=[size])
    return numbered.withColumn("block", F.floor(F.col("_k") / per)).drop("_k")


def basename(path: Column) -> Column:
    """What stands behind the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def clean_name(path: Column) -> Column:
    """The base name up to its first dot, with everything but letters and digits as underscores."""
    return F.regexp_replace(F.split_part(basename(path), F.lit("."), F.lit(1)), "[^A-Za-z0-9]+", "_")


# Marks that tokenized text puts around separators.
MARKS = ((" @,@ ", ","), (" @.@ ", "."), (" @-@ ", "-"))


def detokenized(text: Column) -> Column:
    """Text with its separators' marks resolved and no blanks inside brackets or before punctuation."""
    for mark, sign in MARKS:
        text = F.replace(text, F.lit(mark), F.lit(sign))
    text = F.regexp_replace(text, r"\( (.*) \)", "($1)")
    return F.regexp_replace(F.regexp_replace(text, r" ([;:,.!?])", "$1"), "  +", " ")


def math_answer(text: Column) -> Column:
    """An answer in mathematical notation without units, bracket sizes, percent signs and blanks, and with braces around the
    arguments of fractions and roots."""
    text = F.regexp_replace(text, r"\\text\{[^}]*\}", "")
    for gone in ("\\left", "\\right", "\\%", " "):
        text = F.replace(text, F.lit(gone), F.lit(""))
    text = F.regexp_replace(text, r"\\[td]?frac(\d)(\d)", r"\\frac{$1}{$2}")
    return F.regexp_replace(text, r"\\sqrt(\d)", r"\\sqrt{$1}")


def gram_ranges(text: Column, n: int) -> Column:
    """start and end (in characters) of every n-gram of words between single blanks."""
    words = F.split(text, " ")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("r"))
    walk = F.aggregate(words, start, lambda a, w: F.struct((a["at"] + F.length(w) + 1).alias("at"), F.concat(a["r"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(w)).alias("end")))).alias("r")))["r"]
    return let(walk, lambda r: F.when(F.size(r) >= n, F.transform(F.sequence(F.lit(0), F.size(r) - n), lambda k: F.struct(F.get(r, k)["start"].alias("start"), F.get(r, k + (n - 1))["end"].alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
