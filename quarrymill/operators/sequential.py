"""Operators that need Python or an order-dependent loop: each states why, and what bounds it."""

from __future__ import annotations

import math
from collections import Counter
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeats(a: np.ndarray, period: int) -> int:
    """How often the longest run with this period says the period, at least once."""
    if len(a) <= period:
        return 1
    same = np.flatnonzero(np.diff(np.r_[0, (a[period:] == a[:-period]).astype(np.int8), 0]))
    longest = int((same[1::2] - same[::2]).max()) if len(same) else 0
    return 1 + longest // period


def periodic(a: Column, low: int = 1, high: int = 13, times: int = 32) -> Column:
    """Whether some period of low to high tokens is repeated at least `times` times (in Arrow batches: run lengths of many periods)."""

    @F.pandas_udf("boolean")
    def test(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x is not None and any(repeats(np.asarray(x), p) >= times for p in range(low, high + 1)))

    return test(a)


def blending(weights: list[float], n: int) -> list[int]:
    """The source of each of n samples: the one furthest behind its share of the samples so far, the first of equal ones;
    before the first sample the shares are those of one. Sequential, on the driver; n is an index of samples, not data."""
    w = np.array(weights, dtype=float) / sum(weights)
    taken, out = np.zeros(len(w)), []
    for drawn in range(n):
        s = int(np.argmax(w * (drawn or 1) - taken))
        taken[s] += 1
        out.append(s)
    return out


def blended_index(df: DataFrame, source: str, n: int) -> DataFrame:
    """sample, source, nth (which record of its source) of n blended samples, with weights in proportion to the sources' rows
    (as many rows as sources come to the driver)."""
    c = [(r[0], r[1]) for r in df.where(F.col(source).isNotNull()).groupBy(source).count().orderBy(source).collect()]
    rows, seen = [], Counter()
    for k, s in enumerate(blending([x for _, x in c], n) if c else []):
        rows.append((k, c[s][0], seen[s]))
        seen[s] += 1
    return df.sparkSession.createDataFrame(rows, f"sample long, {source} string, nth long")


def poisson_means(df: DataFrame, key: Column, value: Column, replicates: int) -> DataFrame:
    """k, m: the mean of value in each bootstrap replicate, with Poisson weights from hashes of replicate and key.

    Rows aren't copied: a task adds each one's weights to its sums, and only the sums of the replicates are shuffled."""
    limits = np.array([0.367879, 0.735759, 0.919699, 0.981012, 0.996340])
    lead = [f"{k}:".encode() for k in range(1, replicates + 1)]

    def run(batches):
        w, wv = np.zeros(replicates), np.zeros(replicates)
        for b in batches:
            for key, v in zip(b["key"], b["value"]):
                tail = str(key).encode()
                u = np.array([int.from_bytes(md5(x + tail).digest()[:4]) for x in lead]) / 4294967296
                times = np.searchsorted(limits, u, side="right")
                w += times
                wv += times * v
        yield pd.DataFrame({"k": range(1, replicates + 1), "w": w, "wv": wv})

    sums = df.select(key.cast("string").alias("key"), value.cast("double").alias("value")).mapInPandas(run, "k int, w double, wv double")
    return sums.groupBy("k").agg(F.try_divide(F.sum("wv"), F.sum("w")).alias("m"))


def encoded(text: Column, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.json") -> Column:
    """Token ids by a public tokenizer file (of the tokenizers package), without special tokens; null for null."""

    @F.pandas_udf("array<int>")
    def run(t: pd.Series) -> pd.Series:
        enc = _tokenizer(vocabulary)
        return t.map(lambda x: None if x is None else enc.encode(x, add_special_tokens=False).ids)

    return run(text)


def decoded(ids: Column, vocabulary: str = "/opt/tokenizers/byte_bpe_50k.json") -> Column:
    """The text of token ids by a public tokenizer file."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        enc = _tokenizer(vocabulary)
        return t.map(lambda x: None if x is None else enc.decode(list(x), skip_special_tokens=False))

    return run(ids)


_tokenizers: dict = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        _tokenizers[path] = t
    return _tokenizers[path]


def bleu_parts(candidate: Column, reference: Column) -> Column:
    """Clipped n-gram matches and totals of one pair for n = 1 to 4, and both lengths."""

    @F.pandas_udf("array<long>")
    def parts(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            x, y = x.split(), y.split()
            out = []
            for n in range(1, 5):
                p, q = Counter(zip(*[x[k:] for k in range(n)])), Counter(zip(*[y[k:] for k in range(n)]))
                out += [(p & q).total(), p.total()]
            return [*out, len(x), len(y)]

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return parts(candidate, reference)


def corpus_bleu(df: DataFrame, candidate: str, reference: str) -> DataFrame:
    """Corpus BLEU-4 in percent, with the brevity penalty; sums are distributed, the formula is a column."""
    each = df.where(F.col(candidate).isNotNull() & F.col(reference).isNotNull()).select(bleu_parts(F.col(candidate), F.col(reference)).alias("p"))
    s = each.agg(*[F.sum(F.get("p", F.lit(k))).alias(f"s{k}") for k in range(10)])
    logs = sum((F.ln(F.col(f"s{2 * k}") / F.col(f"s{2 * k + 1}")) for k in range(4)), F.lit(0.0)) / 4
    brevity = F.least(F.lit(0.0), 1 - F.col("s9") / F.col("s8"))
    return s.select((100 * F.exp(brevity + logs)).alias("bleu"), F.col("s8").alias("words"))


def chrf_parts(x: str, y: str, most: int = 6) -> list[int]:
    """Common, own and reference counts of character n-grams (blanks left out) for n = 1 to most."""
    x, y = "".join(x.split()), "".join(y.split())
    out = []
    for n in range(1, most + 1):
        p, q = Counter(x[k : k + n] for k in range(len(x) - n + 1)), Counter(y[k : k + n] for k in range(len(y) - n + 1))
        out += [(p & q).total(), p.total(), q.total()]
    return out


def edit_rate_parts(x: list[str], y: list[str]) -> int:
    """Edits that turn x into y: words put in, left out or replaced, and blocks moved (as long as a move saves edits)."""

    def distance(a):
        row = list(range(len(y) + 1))
        for i, u in enumerate(a, 1):
            new = [i]
            for j, v in enumerate(y, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (u != v)))
            row = new
        return row[-1]

    moves, now = 0, distance(x)
    while now > 1:
        best = None
        for start in range(len(x)):
            for j in range(len(y)):
                n = 0
                while n < 10 and start + n < len(x) and j + n < len(y) and x[start + n] == y[j + n]:
                    n += 1
                if n and start != j:
                    rest = x[:start] + x[start + n :]
                    moved = rest[:j] + x[start : start + n] + rest[j:]
                    d = distance(moved)
                    if d < now - 1 and (best is None or d < best[0]):
                        best = d, moved
        if best is None:
            break
        moves, now, x = moves + 1, best[0], best[1]
    return moves + now


def text_distances(df: DataFrame, candidate: str, reference: str, move_limit: int = 60) -> DataFrame:
    """chrf (percent, recall counted twice), ter (edits a reference word; moves are looked for in texts of at most move_limit
    words, longer ones count plain edits) and sentence_bleu (mean over pairs, counts of n > 1 smoothed by one)."""

    @F.pandas_udf("struct<c:array<long>,edits:long,words:long,bleu:double>")
    def parts(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            u, v = x.split(), y.split()
            logs = 0.0
            for n in range(1, 5):
                p, q = Counter(zip(*[u[k:] for k in range(n)])), Counter(zip(*[v[k:] for k in range(n)]))
                more = int(n > 1)
                logs += math.log(max((p & q).total() + more, 1e-9) / max(p.total() + more, 1)) / 4
            brevity = min(0.0, 1 - len(v) / max(len(u), 1))
            long = max(len(u), len(v)) > move_limit
            rows.append((chrf_parts(x, y), _plain_edits(u, v) if long else edit_rate_parts(u, v), len(v), math.exp(brevity + logs) if u and v else 0.0))
        return pd.DataFrame(rows, columns=["c", "edits", "words", "bleu"])

    each = df.where(F.col(candidate).isNotNull() & F.col(reference).isNotNull()).select(parts(F.col(candidate), F.col(reference)).alias("p"))
    s = each.agg(*[F.sum(F.get("p.c", F.lit(k))).alias(f"s{k}") for k in range(18)], F.sum("p.edits").alias("edits"), F.sum("p.words").alias("words"), F.avg("p.bleu").alias("sentence_bleu"))
    mean = lambda at: sum((F.coalesce(F.try_divide(F.col(f"s{3 * k}"), F.col(f"s{3 * k + at}")), F.lit(0.0)) for k in range(6)), F.lit(0.0)) / 6
    precision, recall = mean(1), mean(2)
    return s.select(F.coalesce(F.try_divide(100 * 5 * precision * recall, 4 * precision + recall), F.lit(0.0)).alias("chrf"), F.try_divide(F.col("edits"), F.col("words")).alias("ter"), "sentence_bleu")


def _plain_edits(x: list[str], y: list[str]) -> int:
    row = np.arange(len(y) + 1)
    codes = {w: k for k, w in enumerate({*x, *y})}
    b = np.array([codes[w] for w in y])
    for i, u in enumerate(x, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != codes[u]))
        new = np.r_[i, new]
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))  # words put in
    return int(row[-1])


def linear_probe(df: DataFrame, features: str, label: Column, steps: int = 60) -> DataFrame:
    """A balanced logistic regression on an array of features by Spark's own solver; training accuracy and norm of the weights.

    The weights of a class sum to half of the rows' number."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), label.cast("double").alias("y")).where("x is not null and y is not null")
    counts = x.groupBy("y").agg(F.count("*").alias("n"))  # two rows
    total = counts.agg(F.sum("n").alias("total"))
    weighted = x.join(F.broadcast(counts.crossJoin(total)), "y").withColumn("w", F.col("total") / (2 * F.col("n")))
    if weighted.limit(1).count() == 0:
        return df.sparkSession.createDataFrame([], "accuracy double, norm double")
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=steps, regParam=0.0).fit(weighted)
    right = model.transform(weighted).agg(F.avg((F.col("prediction") == F.col("y")).cast("int")).alias("accuracy"))
    w = np.append(model.coefficients.toArray(), model.intercept)
    return right.withColumn("norm", F.lit(math.sqrt(float(w @ w))))


def word_spans(text: Column, at: Column, n: int) -> Column:
    """Start and end in characters of the n words (separated by single blanks) from each of the given word positions on; none for null positions."""

    @F.pandas_udf("array<array<int>>")
    def spans(t: pd.Series, a: pd.Series) -> pd.Series:
        def one(x, places):
            if x is None or places is None:
                return []
            ends = np.cumsum([len(w) + 1 for w in x.split(" ")]) - 1
            return [[int(ends[k - 1]) + 1 if k else 0, int(ends[k + n - 1])] for k in sorted(places)]

        return pd.Series([one(x, p) for x, p in zip(t, a)])

    return spans(text, at)


def decontaminated(text: Column, hits: Column, window: int = 200, least: int = 200, most_hits: int = 10) -> Column:
    """What is left of a text after cutting `window` characters around each hit (its start and end): slices over `least` characters, none from most_hits hits on."""

    @F.pandas_udf("array<string>")
    def cut(t: pd.Series, h: pd.Series) -> pd.Series:
        def one(x, spans):
            if x is None:
                return None
            spans = [] if spans is None else sorted((int(a), int(b)) for a, b in spans)
            if not spans:
                return [x]
            if len(spans) >= most_hits:
                return []
            out, at = [], 0
            for a, b in spans:
                if a - window - at > least:
                    out.append(x[at : a - window])
                at = max(at, b + window)
            return [*out, x[at:]] if len(x) - at > least else out

        return pd.Series([one(x, s) for x, s in zip(t, h)])

    return cut(text, hits)


def _numbers(bag: set[str]) -> set[str]:
    return {w for w in bag if w.replace(".", "", 1).replace(",", "").lstrip("-").isdigit()}


def best_alignment(table: np.ndarray) -> float:
    """The largest sum of entries no two of which share a row or a column (shortest augmenting paths, cubic)."""
    if not table.size:
        return 0.0
    cost = -(table if table.shape[0] <= table.shape[1] else table.T)
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        match[0], col = row, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[col] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[col] - 1, free - 1] - u[match[col]] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], col
            new = free[np.argmin(least[free])]
            delta = least[new]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            col = new
            if match[col] == 0:
                break
        while col:
            match[col], col = match[way[col]], way[col]
    return float(-sum(cost[match[j] - 1, j - 1] for j in range(1, m + 1) if match[j]))


def map_shards(df: DataFrame, shards: int, key: Column, fn, schema: str) -> DataFrame:
    """fn (a frame's rows of one shard to a frame) on each of so many shards by the hash of key; shards must fit a task."""
    return df.withColumn("_shard", F.pmod(F.xxhash64(key), F.lit(shards))).groupBy("_shard").applyInPandas(lambda part: fn(part.drop(columns="_shard")), schema)


def bag_scores(predicted: Column, gold: Column) -> Column:
    """Exact match and the best one-to-one alignment's F1 (percent, two decimals) of two lists of answers as word bags."""

    @F.pandas_udf("struct<em:double,f1:double>")
    def score(p: pd.Series, g: pd.Series) -> pd.DataFrame:
        def f1(a, b):
            numbers = _numbers(a)
            if numbers and not numbers & _numbers(b):  # a number that is missing spoils the answer
                return 0.0
            both = len(a & b)
            return 0.0 if not both else 2 * both / (len(a) + len(b))

        def one(x, y):
            a, b = [set(w.lower().split()) for w in x], [set(w.lower().split()) for w in y]
            table = np.array([[f1(u, v) for v in b] for u in a]).reshape(len(a), len(b))
            n = max(len(a), len(b), 1)
            return float(sorted(map(sorted, a)) == sorted(map(sorted, b))), round(100 * best_alignment(table) / n, 2)

        return pd.DataFrame([one(x, y) for x, y in zip(p, g)], columns=["em", "f1"])

    return score(predicted, gold)
