"""Measures of choices, likelihoods, labels and answers as columns and aggregates, and a registry of tasks made of both."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Of rows with equal keys the first in an order."""
    names = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in names])


def best_choice(value: Column, choice: Column) -> Column:
    """The choice of the highest value, the first of equal ones."""
    return -F.max(F.struct(value.alias("v"), (-choice).alias("c")))["c"]


def choice_table(choices: DataFrame, doc: str, cont: str, n: int, order: list) -> DataFrame:
    """One row for each document with exactly n different choices (repeated ones: the first in the order): the choices
    picked by log-likelihood ll, by ll per length and by ll less the domain's dc, the label, and the label's loss.

    Expects ll, length, dc and label columns; choices count from 0."""
    one = first_of(choices, [doc, cont], order)
    per = one.groupBy(doc).agg(
        F.count("*").alias("k"),
        best_choice(F.col("ll"), F.col(cont)).alias("acc"),
        best_choice(F.col("ll") / F.col("length"), F.col(cont)).alias("len_norm"),
        best_choice(F.col("ll") - F.col("dc"), F.col(cont)).alias("pmi_dc"),
        F.max("label").alias("label"),
        F.max(F.when(F.col(cont) == F.col("label"), -F.col("ll"))).alias("loss"),
    )
    return per.where(F.col("k") == n)


def choice_metrics(table: DataFrame) -> DataFrame:
    """One row: documents, accuracies by the three rules, mean loss of the label, and the F1 of label 0 under the first rule."""
    right = lambda c: F.avg((F.col(c) == F.col("label")).cast("int"))
    hit, said, is_ = [F.count_if(t) for t in ((F.col("acc") == 0) & (F.col("label") == 0), F.col("acc") == 0, F.col("label") == 0)]
    return table.agg(F.count("*").alias("documents"), right("acc").alias("acc"), right("len_norm").alias("len_norm"), right("pmi_dc").alias("pmi_dc"), F.avg("loss").alias("ce_loss"), F.try_divide(2 * hit, said + is_).alias("f1"))


def likelihood_metrics(ll: Column, words: Column, bytes_: Column) -> dict[str, Column]:
    """Word and byte perplexity and bits per byte of summed log-likelihoods; weighted by words and bytes."""
    total = F.sum(ll)
    return {"word_perplexity": F.exp(-total / F.sum(words)), "byte_perplexity": F.exp(-total / F.sum(bytes_)), "bits_per_byte": -total / F.sum(bytes_) / F.ln(F.lit(2.0))}


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def weighted_perplexity(ll: Column, weight: Column) -> Column:
    return F.exp(-F.try_divide(F.sum(ll), F.sum(weight)))


def unigram_likelihoods(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ll, words, bytes: the log-likelihood of each text's words (between blanks) under the corpus' own word frequencies.

    A language model that needs no weights; a real model's scores take the place of ll."""
    words = df.where(F.length(text) > 0).select(key, F.explode(F.split(text, " ")).alias("w"), (F.octet_length(text) / F.size(F.split(text, " "))).alias("b"))
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    scored = counts.crossJoin(F.broadcast(total)).select("w", F.ln(F.col("n") / F.col("total")).alias("l"))
    per = words.groupBy(key, "w").agg(F.count("*").alias("c"), F.sum("b").alias("b"))  # a word counts once a text before the join
    return per.join(scored, "w").groupBy(key).agg(F.sum(F.col("c") * F.col("l")).alias("ll"), F.sum("c").alias("words"), F.sum("b").alias("bytes"))


def multi_label(long: DataFrame, row: str, label: str) -> tuple[DataFrame, DataFrame]:
    """F1 of each label, and one row of macro F1, micro F1 and the share of rows with all labels right. Expects boolean y and p."""
    y, p = F.col("y"), F.col("p")
    sums = long.groupBy(label).agg(F.count_if(y & p).alias("tp"), F.count_if(y).alias("gold"), F.count_if(p).alias("said"))
    f1 = lambda tp, gold, said: F.coalesce(F.try_divide(2.0 * tp, gold + said), F.lit(0.0))
    each = sums.select(label, f1(F.col("tp"), F.col("gold"), F.col("said")).alias("f1"))
    total = sums.agg(F.avg(f1(F.col("tp"), F.col("gold"), F.col("said"))).alias("macro_f1"), f1(F.sum("tp"), F.sum("gold"), F.sum("said")).alias("micro_f1"))
    exact = long.groupBy(row).agg(F.bool_and(y == p).alias("ok")).agg(F.avg(F.col("ok").cast("int")).alias("exact_match"))
    return each, total.crossJoin(exact)  # one row each


def truthfulness(ll: Column, true: Column, choice: Column) -> dict[str, Column]:
    """Of one question's references: mc1 (the first true one is likeliest of all), mc2 (probability mass of true ones), and
    best true, best false, their difference and whether it is above 0."""
    best_true, best_false = F.max(F.when(true, ll)), F.max(F.when(~true, ll))
    mass = F.sum(F.when(true, F.exp(ll)).otherwise(0.0))
    return {
        "mc1": (best_choice(ll, choice) == F.min(F.when(true, choice))).cast("int"),
        "mc2": mass / F.sum(F.exp(ll)),
        "max_true": best_true,
        "diff": best_true - best_false,
        "acc": (best_true > best_false).cast("int"),
    }


def answer_words(text: Column) -> Column:
    """Lower case, without punctuation and articles; the words of an answer."""
    clean = F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")
    return F.filter(F.split(clean, " "), lambda w: ~w.isin("", "the", "a", "an"))


def bag_common(x: Column, y: Column) -> Column:
    """The size of the common part of two word lists as bags."""
    return F.aggregate(F.array_distinct(x), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(x, lambda v: v == w)), F.size(F.filter(y, lambda v: v == w))))


def bag_f1(x: Column, y: Column) -> Column:
    """F1 of two word lists as bags; 1 for two empty ones, 0 for one."""
    n = F.size(x) + F.size(y)
    return F.when(n == 0, 1.0).otherwise(2.0 * bag_common(x, y) / n)


def rouge_l(x: Column, y: Column) -> Column:
    """F1 of the longest common subsequence of two word lists (for references of moderate length: the table is folded row by row)."""
    row = lambda prev, w: F.aggregate(
        F.sequence(F.lit(0), F.size(y) - 1),
        F.struct(F.array(F.lit(0)).alias("r")),
        lambda acc, j: F.struct(F.concat(acc["r"], F.array(F.when(F.get(y, j) == w, F.get(prev, j) + 1).otherwise(F.greatest(F.get(prev, j + 1), F.element_at(acc["r"], -1))))).alias("r")),
    )["r"]
    last = F.aggregate(x, F.array_repeat(F.lit(0), F.size(y) + 1), row)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2.0 * F.element_at(last, -1) / (F.size(x) + F.size(y)))


def judge_rates(response: Column, right: str, wrong: str, partial: str, entities: Column) -> dict[str, Column]:
    """Shares of answers that begin with the words for right, wrong and partial, and that name any of a row's entities."""
    low = F.lower(F.ltrim(response))
    share = lambda t: F.avg(F.coalesce(t, F.lit(False)).cast("int"))
    return {"right": share(F.startswith(low, F.lit(right))), "wrong": share(F.startswith(low, F.lit(wrong))), "partial": share(F.contains(low, F.lit(partial))), "mentions": share(F.exists(entities, lambda e: F.contains(low, F.lower(e))))}


def object_hash(*columns: Column) -> Column:
    """A hash of a row's content, the same in every session: md5 of its JSON with the fields in their given order."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def leave_one_out(df: DataFrame, key: str, words: str) -> DataFrame:
    """For each reference of a key the best F1 against the key's other references, as a mean over them; 1 for a single one."""
    w = Window.partitionBy(key)
    all_ = df.select(key, words).distinct().withColumn("all", F.collect_list(words).over(w))  # the references of one question
    other = F.array_max(F.transform(F.filter("all", lambda x: x != F.col(words)), lambda x: bag_f1(F.col(words), x)))
    return all_.groupBy(key).agg(F.avg(F.coalesce(other, F.lit(1.0))).alias("f1"))


@dataclass
class Task:
    """A scored task: columns of each row by name, and the aggregate of each of them over a group."""

    rows: dict[str, Column]
    aggregates: dict[str, Column]
    by: list[str] = field(default_factory=list)

    def score(self, df: DataFrame) -> DataFrame:
        each = df.select(*self.by, *[v.alias(k) for k, v in self.rows.items()])
        out = [v.alias(k) for k, v in self.aggregates.items()]
        return each.groupBy(*self.by).agg(*out) if self.by else each.agg(*out)


TASKS: dict[str, Task] = {}


def register(name: str, task: Task) -> Task:
    """Adds a task under a name that is still free."""
    if name in TASKS:
        raise ValueError(f"{name} is taken")
    TASKS[name] = task
    return task


class Accumulator:
    """A metric over batches: named sums that add up, and a column of them that is the result."""

    def __init__(self, sums: dict[str, Column], result):
        self.sums, self.result, self.state = sums, result, dict.fromkeys(sums, 0.0)

    def update(self, df: DataFrame) -> None:
        row = df.agg(*[F.sum(v.cast("double")).alias(k) for k, v in self.sums.items()]).first()
        for k in self.sums:
            self.state[k] += row[k] or 0.0

    def compute(self) -> float:
        return self.result(**self.state)
