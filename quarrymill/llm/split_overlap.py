"""Records of evaluation splits that recur in the training split, exactly or almost (problem 5).

Normalised records are cut into chunks where a rolling hash of the last words says so, so that an edit changes only
the chunks around it. Chunk digests are joined across the splits, and the lengths of the chunks two records share,
summed up and divided by the length of the evaluation record, are the pair's overlap fraction. Pairs whose fraction
reaches the wanted one are compared exactly.

To join without the chunks that stand in a large part of all records, an evaluation record leaves out its most
frequent chunks as long as these make up less than the wanted fraction of it: a pair that reaches the fraction shares
at least one of the others (prefix filter), so nothing is lost by it. Exact copies on either side are one class.
Only digests and sizes of chunks travel through these joins; the texts are read again for the pairs that are left.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.arrow import lists, mix, segments, starts_of, sums
from quarrymill.llm.words import odd_powers, word_hashes
from quarrymill.session import cut


@dataclass(frozen=True)
class Cutting:
    """One word in `every` ends a chunk, by the hash of the last `window` words; chunks have `least` to `most` words.

    A record is cut `cuttings` times by independent hashes; its overlap is the mean of theirs, which varies less with
    the place of an edit.
    """

    every: int
    window: int
    least: int
    most: int
    fraction: float
    cuttings: int


LONG = Cutting(every=6, window=2, least=3, most=24, fraction=0.15, cuttings=2)
SHORT = Cutting(every=3, window=1, least=2, most=8, fraction=0.25, cuttings=3)


def chunk_ends(h: np.ndarray, n: np.ndarray, how: Cutting, salt: int = 0) -> np.ndarray:
    """The positions behind the last word of each chunk, over all records."""
    roll = np.zeros(len(h), dtype=np.uint64)
    at = np.arange(len(h)) - np.repeat(starts_of(n)[:-1], n)
    for k in range(how.window):
        roll[k:] += np.where(at[k:] >= k, mix(h[: len(h) - k], 70 + 50 * salt + k), np.uint64(0))
    marked = np.flatnonzero(roll % np.uint64(how.every) == 0) + 1
    start = starts_of(n)
    ends: list[int] = []
    lo = np.searchsorted(marked, start[:-1], side="right")
    hi = np.searchsorted(marked, start[1:], side="right")
    marks = marked.tolist()
    for a, b, i, j in zip(start[:-1].tolist(), start[1:].tolist(), lo.tolist(), hi.tolist()):
        s = a
        for e in marks[i:j]:
            while e - s > how.most:
                s += how.most
                ends.append(s)
            if e - s >= how.least:
                ends.append(e)
                s = e
        while b - s > how.most:
            s += how.most
            ends.append(s)
        if s < b:
            ends.append(b)
    return np.array(ends, dtype=np.int64)


def _chunks(batches, how, min_words):
    for batch in batches:
        h, n = word_hashes(batch.column("text"))
        keep = n >= max(min_words, 1)
        if not keep.any():
            continue
        batch = batch.filter(pa.array(keep))
        h, n = h[np.repeat(keep, n)], n[keep]
        start = starts_of(n)
        whole = np.stack([sums(mix(h, 21) * odd_powers(n, 21), start), sums(mix(h, 22) * odd_powers(n, 22), start)], axis=1)
        digests, sizes, recs = [], [], []
        for salt in range(how.cuttings):
            ends = chunk_ends(h, n, how, salt)
            sizes.append(np.diff(np.r_[0, ends]))
            digests.append(mix(sums(mix(h, 31) * odd_powers(sizes[-1], 31), np.r_[0, ends]), 33 + salt))
            recs.append(np.searchsorted(start, ends, side="left") - 1)
        digest, size, rec = np.concatenate(digests), np.concatenate(sizes), np.concatenate(recs)
        o = np.lexsort((digest, rec))
        rec, digest, size = rec[o], digest[o], size[o]
        new = np.r_[True, (rec[1:] != rec[:-1]) | (digest[1:] != digest[:-1])]
        total = np.add.reduceat(size, np.flatnonzero(new))
        per = np.bincount(rec[new], minlength=len(n))
        yield pa.RecordBatch.from_arrays(
            [batch.column("side"), batch.column("id"), pa.array([x.tobytes() for x in whole], type=pa.binary()), pa.array(n.astype(np.int32)), lists((digest[new] >> np.uint64(32)).astype(np.uint32).view(np.int32), per, pa.int32()), lists(total, per, pa.int32())],
            names=["side", "id", "digest", "n", "chunks", "sizes"],
        )


_CHUNKED = "side string, id string, digest binary, n int, chunks array<int>, sizes array<int>"


def same_runs(a: np.ndarray, b: np.ndarray) -> bool:
    """At least half of the distinct three-word runs of both together in common."""
    x = {*zip(a[:-2].tolist(), a[1:-1].tolist(), a[2:].tolist())}
    y = {*zip(b[:-2].tolist(), b[1:-1].tolist(), b[2:].tolist())}
    both = len(x & y)
    return both > 0 and 2 * both >= len(x) + len(y) - both


def few_edits(a: np.ndarray, b: np.ndarray, most: int = 3) -> bool:
    """Equal but for at most three words put in, left out or replaced."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.tolist(), b.tolist()
    if len(set(x) - set(y)) > most or (Counter(x) & Counter(y)).total() < max(len(x), len(y)) - most:
        return False
    row = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        new = [i]
        for j, v in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (u != v)))
        row = new
        if min(row) > most:
            return False
    return row[-1] <= most


def _shares(batches, how):
    """Overlap fractions of all pairs of a batch at once; only pairs that reach the wanted one go on."""
    for batch in batches:
        (ce, me), (se, _), (ct, mt) = [segments(batch.column(c)) for c in ("ce", "se", "ct")]
        of = np.repeat(np.arange(len(me), dtype=np.uint64), me)
        mine = of << np.uint64(32) | ce.view(np.uint32).astype(np.uint64)
        other = np.sort(np.repeat(np.arange(len(mt), dtype=np.uint64), mt) << np.uint64(32) | ct.view(np.uint32).astype(np.uint64))
        near = np.minimum(np.searchsorted(other, mine), max(len(other) - 1, 0))
        shared = other[near] == mine if len(other) else np.zeros(len(mine), bool)
        n = batch.column("n").to_numpy()
        share = np.bincount(of.astype(np.int64), weights=se * shared, minlength=len(n)) / np.maximum(n * how.cuttings, 1)
        yield pa.RecordBatch.from_arrays([batch.column("e"), batch.column("t"), pa.array(share)], names=["e", "t", "share"]).filter(pa.array(share >= how.fraction))


def _verify(batches, same):
    """The exact comparison of the texts of each pair."""
    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            (we, ne), (wt, nt) = word_hashes(batch.column("te")), word_hashes(batch.column("tt"))
            es, ts = starts_of(ne), starts_of(nt)
            keep = [same(we[es[k] : es[k + 1]], wt[ts[k] : ts[k + 1]]) for k in range(batch.num_rows)]
            yield batch.select(["e", "t", "share"]).filter(pa.array(keep, type=pa.bool_()))


def overlapping_records(evaluation: DataFrame, training: DataFrame, how: Cutting, same, min_words: int = 1) -> DataFrame:
    """eval_key, train_key, share of all pairs that overlap by `how` and pass the exact comparison `same`.

    Both inputs have the columns key and text. Rows that repeat a key count once; null keys and texts, and texts under
    min_words words, aren't records. No pair of keys comes twice. Empty inputs give an empty result.
    """
    sides = evaluation.select(F.lit("e").alias("side"), F.col("key").cast("string").alias("id"), "text").unionByName(training.select(F.lit("t").alias("side"), F.col("key").cast("string").alias("id"), "text"))
    sides = sides.where("id is not null and text is not null")
    records = cut(sides.mapInArrow(lambda it: _chunks(it, how, min_words), _CHUNKED), "chunks")
    members = cut(records.select("side", "digest", "id").distinct(), "members")
    firsts = members.groupBy("side", "digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    # most records have no copies; those that stand for others, or are stood for, are few beside them
    copies = members.join(firsts.where("copies > 1").select("side", "digest", F.col("id").alias("cls")), ["side", "digest"]).where("id != cls").select("side", "id", "cls")
    copies = cut(copies, "copies")
    classes = records.join(copies, ["side", "id"], "left_anti").dropDuplicates(["side", "id"]).select("side", F.col("id").alias("cls"), "n", "chunks", "sizes")
    classes = cut(classes, "classes")
    e, t = classes.where("side = 'e'"), classes.where("side = 't'")
    ek = e.select(F.col("cls").alias("e"), "n", F.posexplode("chunks").alias("at", "chunk"), "sizes").select("e", "n", "chunk", F.get("sizes", F.col("at")).alias("size"))
    tk = t.select(F.col("cls").alias("t"), F.explode("chunks").alias("chunk")).join(ek.select("chunk").distinct(), "chunk", "left_semi")
    seen = tk.groupBy("chunk").agg(F.count("*").alias("df"))
    frequent_first = Window.partitionBy("e").orderBy(F.desc("df"), "chunk").rowsBetween(Window.unboundedPreceding, 0)
    kept = ek.join(seen, "chunk", "left").withColumn("sofar", F.sum("size").over(frequent_first)).where((F.col("sofar") >= how.fraction * how.cuttings * F.col("n")) & F.col("df").isNotNull())
    pairs = kept.select("e", "chunk").join(tk, "chunk").select("e", "t").distinct()
    full = pairs.join(e.select(F.col("cls").alias("e"), "n", F.col("chunks").alias("ce"), F.col("sizes").alias("se")), "e").join(t.select(F.col("cls").alias("t"), F.col("chunks").alias("ct")), "t")
    near = cut(full.mapInArrow(lambda it: _shares(it, how), "e string, t string, share double"), "near")
    texts = {s: sides.where(F.col("side") == s).select(F.col("id").alias(s), F.col("text").alias(f"t{s}")).join(near.select(s).distinct(), s, "left_semi").distinct() for s in "et"}
    exact = cut(near.join(texts["e"], "e").join(texts["t"], "t").select("e", "t", "share", "te", "tt").mapInArrow(lambda it: _verify(it, same), "e string, t string, share double").distinct(), "exact")
    me, mt = [copies.where(F.col("side") == s).select(F.col("cls").alias(s), F.col("id").alias(f"own_{s}")) for s in "et"]
    # each class stands for itself and for its copies
    found = exact
    for s, m in (("e", me), ("t", mt)):
        found = found.unionByName(found.join(m, s).drop(s).withColumnRenamed(f"own_{s}", s))
    return found.select(F.col("e").alias("eval_key"), F.col("t").alias("train_key"), "share")


def cross_split_overlaps(unseen: DataFrame, non_toxic: DataFrame, paradetox: DataFrame) -> DataFrame:
    """dataset, eval_key, train_key, share: unseen_data against non_toxic_reddit, and valid and test rows of paradetox against its train rows."""
    one = overlapping_records(unseen.select(F.col("id").alias("key"), "text"), non_toxic.select(F.col("id").alias("key"), "text"), LONG, same_runs, 40)
    comments = paradetox.select(F.col("pair_id").alias("key"), F.col("en_toxic_comment").alias("text"), "split")
    two = overlapping_records(comments.where(F.col("split").isin("valid", "test")), comments.where("split = 'train'"), SHORT, few_edits)
    return one.select(F.lit("unseen_data").alias("dataset"), "*").unionByName(two.select(F.lit("paradetox").alias("dataset"), "*"))


def overlap_report(unseen: DataFrame, non_toxic: DataFrame, paradetox: DataFrame) -> DataFrame:
    """For each dataset, split and source (null where it is unknown): evaluation records, those that overlap, and pairs."""
    found = cross_split_overlaps(unseen, non_toxic, paradetox).groupBy("dataset", "eval_key").agg(F.count("*").alias("n"))
    rows = unseen.select(F.lit("unseen_data").alias("dataset"), F.col("id").alias("eval_key"), "split", "source").unionByName(
        paradetox.where(F.col("split").isin("valid", "test")).select(F.lit("paradetox").alias("dataset"), F.col("pair_id").cast("string").alias("eval_key"), "split", "source")
    )
    each = rows.where("eval_key is not null").groupBy("dataset", "eval_key").agg(F.max("split").alias("split"), F.max("source").alias("source"))
    return (
        each.join(found, ["dataset", "eval_key"], "left")
        .groupBy("dataset", "split", "source")
        .agg(F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    )
