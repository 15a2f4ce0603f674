"""Mixing sources to target weights by iterative proportional fitting (problem 8).

Documents fall into cells of source, language and topic. The tokens to take from each cell are raked until the
source marginals are the target weights and the language and topic marginals are those of the documents at hand; then
no cell takes more than its source's repeats allow, and the source marginals are restored among the cells with room.
A cell's quotient of wanted and present tokens is the expected number of copies of its documents. Fractions are drawn
by systematic sampling along the sizes within each source, so that the tokens drawn hardly vary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.encoding import TOKENIZERS, encoder
from quarrymill.session import cut

ROOM = 0.97
ROUNDS = 200
SALTS = 64

# Spellings of language codes.
LANGUAGES = {"eng": "en", "english": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "zho": "zh", "chi": "zh", "rus": "ru"}
# Words that tell a topic; the first that fits counts.
TOPICS = {"code": r"(?m)^\s*(def|const|SELECT|import|for i in|#!)", "dialogue": r"(?m)^(User|Assistant):", "food": r"(?i)\b(recipe|soup|bread|pie|cake|trout|chili)\b", "places": r"(?i)\b(river|museum|town|station|library)\b"}


def canonical_source(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def canonical_lang(c: Column) -> Column:
    short = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,})", 1)
    mapped = short
    for a, b in LANGUAGES.items():
        mapped = F.when(short == a, b).otherwise(mapped)
    return F.when(F.length(mapped) == 2, mapped).otherwise("und")


def topic(text: Column) -> Column:
    out = F.lit("other")
    for name, pattern in reversed(TOPICS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def rake(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Weights of cells with the target marginals; axes give each cell's level on each margin. The first margin is met exactly."""
    w = tokens.astype(float)
    for k in range(rounds):
        for axis, target in reversed(list(zip(axes, targets))):
            now = np.bincount(axis, weights=w, minlength=len(target))
            w = w * (target / np.where(now > 0, now, 1))[axis]
        gap = max(np.abs(np.bincount(a, weights=w, minlength=len(t)) - t).max() for a, t in zip(axes, targets))
        if gap < 1e-9 * max(w.sum(), 1):
            break
    return w


def cap_cells(want: np.ndarray, most: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Wanted tokens with no cell above most; what is cut goes to the source's other cells in proportion, as long as there is room."""
    for s in range(len(target)):
        mine = source == s
        for _ in range(60):
            over = want[mine] > most[mine]
            w = np.minimum(want[mine], most[mine])
            free = target[s] - w.sum()
            if not over.any() or free <= 1e-9 * max(target[s], 1) or over.all():
                want[mine] = w
                break
            room = ~over & (w < most[mine])
            if not room.any() or w[room].sum() <= 0:
                want[mine] = w
                break
            w[room] *= 1 + free / w[room].sum()
            want[mine] = w
        want[mine] = np.minimum(want[mine], most[mine])
    return want


def rake_capped(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """rake() with no cell above most: cells that would be are fixed there, and the others are raked to what is left of all
    margins, until none is above; at last the first margin is restored among the cells with room."""
    fixed = np.zeros(len(tokens), bool)
    want = np.zeros(len(tokens))
    for _ in range(len(tokens)):
        held = np.where(fixed, most, 0.0)
        rest = [np.maximum(t - np.bincount(a, weights=held, minlength=len(t)), 0) for a, t in zip(axes, targets)]
        want = held + rake(np.where(fixed, 0.0, tokens), axes, rest)
        over = ~fixed & (want > most * (1 + 1e-9))
        if not over.any():
            break
        fixed |= over
    return cap_cells(np.minimum(want, most), most, axes[0], targets[0])


def sized_documents(documents: DataFrame, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, source, lang, topic, tokens of the documents with tokens and a source; repeated ids count once."""

    def count(batches):
        enc = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                x = b.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*[x.column(k) for k in range(4)], pa.array([len(enc.encode(t)) for t in x.column(4).to_pylist()], type=pa.int64())], names=["doc_id", "source", "lang", "topic", "tokens"])

    some = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), canonical_source(F.col("source")).alias("source"), canonical_lang(F.col("lang")).alias("lang"), topic(F.col("text")).alias("topic"), "text")
    sized = some.where("source is not null").mapInArrow(count, "doc_id bigint, source string, lang string, topic string, tokens bigint")
    return sized.where("tokens > 0").groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("source", "lang", "topic", "tokens")])


def mixed_documents(documents: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, copies (at least 1) of the documents taken.

    total is the wanted number of tokens; without it, or where its repeats allow no more, the total is ROOM times the
    largest that the scarcest source allows.

    Documents without tokens, without source or of a source without target aren't taken. A target whose source has no
    documents can't be met; its weight goes to the others in proportion, and mix_report shows it with share 0. Without documents or targets the result is empty.
    """
    wanted = targets.where("source is not null and weight > 0 and max_repeats > 0").select(canonical_source(F.col("source")).alias("source"), "weight", "max_repeats")
    docs = cut(sized_documents(documents).join(F.broadcast(wanted), "source"), "sized")
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.max("weight").alias("weight"), F.max("max_repeats").alias("most")).orderBy("source", "lang", "topic").toPandas()
    schema = "source string, lang string, topic string, rate double"
    if len(cells):
        levels = {c: {x: k for k, x in enumerate(sorted(cells[c].unique()))} for c in ("source", "lang", "topic")}
        axes = [cells[c].map(levels[c]).to_numpy() for c in levels]
        tokens = cells["tokens"].to_numpy(float)
        have = [np.bincount(a, weights=tokens) for a in axes]
        weight = np.zeros(len(have[0]))
        most = np.zeros(len(have[0]))
        weight[axes[0]], most[axes[0]] = cells["weight"], cells["most"]
        weight /= weight.sum()
        largest = ROOM * float(np.min(have[0] * most / weight))
        wanted_total = largest if total is None else min(float(total), largest)
        want = rake_capped(tokens, axes, [weight * wanted_total, *[h / h.sum() * wanted_total for h in have[1:]]], tokens * most[axes[0]])
        rates = documents.sparkSession.createDataFrame(cells[["source", "lang", "topic"]].assign(rate=want / tokens), schema)
    else:
        rates = documents.sparkSession.createDataFrame([], schema)
    rated = docs.join(F.broadcast(rates), ["source", "lang", "topic"]).withColumn("part", F.col("rate") - F.floor("rate")).withColumn("bucket", F.floor(F.log2("tokens") * 8).cast("bigint") * SALTS + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    # running sums of the fractions along the sizes, in two levels; a size class of a source is split by hash
    sums = rated.groupBy("source", "bucket").agg(F.sum("part").alias("s"))
    before = sums.select("source", "bucket", (F.sum("s").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("before"))
    order = Window.partitionBy("source", "bucket").orderBy("tokens", F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = rated.join(F.broadcast(before), ["source", "bucket"]).withColumn("run", F.col("before") + F.sum("part").over(order) + F.lit(0.5))
    copies = F.floor("rate") + F.floor(F.col("run") + 1e-9) - F.floor(F.col("run") - F.col("part") + 1e-9)
    return drawn.select("doc_id", "source", "lang", "topic", "tokens", F.least(copies, F.col("max_repeats").cast("bigint")).cast("int").alias("copies")).where("copies > 0")


def mix_report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target: source, weight, documents taken, copies, tokens and the actual share of all tokens."""
    taken = mixed_documents(documents, targets).groupBy("source").agg(F.count("*").alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    rows = targets.select(canonical_source(F.col("source")).alias("source"), "weight").join(taken, "source", "left").na.fill(0, ["documents", "copies", "tokens"])
    total = F.sum("tokens").over(Window.partitionBy())
    return rows.withColumn("share", F.round(F.coalesce(F.try_divide("tokens", total), F.lit(0.0)), 6))


def margin_report(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """For each language and topic: margin, level, its share of the tokens at hand (what raking aims at) and of the mix."""
    wanted = targets.where("source is not null and weight > 0 and max_repeats > 0").select(canonical_source(F.col("source")).alias("source"))
    at_hand = sized_documents(documents).join(F.broadcast(wanted), "source").select("lang", "topic", F.lit(1).alias("copies"), "tokens", F.lit("at_hand").alias("side"))
    both = at_hand.unionByName(mixed_documents(documents, targets).select("lang", "topic", "copies", "tokens", F.lit("mix").alias("side")))
    levels = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("level")) for m in ("lang", "topic")])).alias("m")
    sums = both.select(levels, "side", (F.col("copies") * F.col("tokens")).alias("t")).groupBy("m.margin", "m.level").agg(*[F.sum(F.when(F.col("side") == s, F.col("t")).otherwise(0)).alias(s) for s in ("at_hand", "mix")])
    every = Window.partitionBy("margin")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0)), 6)
    return sums.select("margin", "level", share("at_hand").alias("share_at_hand"), share("mix").alias("share_of_mix"))
