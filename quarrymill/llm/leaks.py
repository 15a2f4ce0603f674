"""Evaluation texts inside training texts by greedy string tiling (problem 1).

The words of the evaluation items, as seeds of a few words each, are joined with the word runs of every document. For
each document and item that share a seed, greedy string tiling repeatedly marks the longest match of unmarked words
(found by running Karp-Rabin hashes, extended to both sides), until no match of the least length is left. The marked
words cover the item however its passages are ordered, and the covered share of the item's words is what decides: a
pair whose coverage reaches the threshold is a leak. Beside it stands the best stretch of the item in its own order,
with at most two words between replaced by others (replaced words don't count as standing in the text), which the
query on cases compares with half of the item's words.

A seed has so many words that every leak holds one: m equal words in at most three runs have a run of at least
ceil(m / 3), and no tile is shorter than a seed. Items with the same words are one class. Seeds that many classes
share (openings, set phrases) are left out of the index as long as those left out of a class can't make up a leak by
themselves; a leak then holds another seed of the class, and the pair is compared in full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.arrow import starts_of
from quarrymill.llm.words import hashes_of, runs, split_words, word_hashes

REPLACED = 2
SEED = 4
TILE = 3
LEAST = 4
HOT = 8
COVERAGE = 0.5
ITEM_BLOCK_WORDS = 4_000_000


class Items:
    """Evaluation items (ids, texts) as classes of equal words, with the index of their seeds.

    An item of fewer than LEAST words is a short phrase and can't leak; one of LEAST words or more needs at least
    half of its words and at least LEAST.
    """

    def __init__(self, ids: list, texts: list):
        by_words: dict[bytes, int] = {}
        self.ids: list[list] = []
        self.words, self.need, self.size, self.seeds_of = [], [], [], []
        for i, text in zip(ids, texts):
            h = hashes_of(split_words(text))
            if len(h) < LEAST:
                continue
            k = by_words.setdefault(h.tobytes(), len(self.ids))
            if k < len(self.ids):
                if i not in self.ids[k]:
                    self.ids[k].append(i)
                continue
            need = max(LEAST, -(-len(h) // 2))
            size = min(SEED, -(-need // (REPLACED + 1)))
            self.ids.append([i])
            self.words.append(h)
            self.need.append(need)
            self.size.append(size)
            self.seeds_of.append(runs(h, size)[: len(h) - size + 1])
        self.index: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size in set(self.size):
            mine = [k for k, s in enumerate(self.size) if s == size]
            each = [np.unique(self.seeds_of[k]) for k in mine]
            found, count = np.unique(np.concatenate(each), return_counts=True)
            seeds, item = [], []
            for k, own in zip(mine, each):
                kept = self._kept(k, own, count[np.searchsorted(found, own)])
                seeds.append(kept)
                item.append(np.full(len(kept), k))
            s, i = np.concatenate(seeds), np.concatenate(item)
            o = np.argsort(s, kind="stable")
            self.index[size] = s[o], i[o]

    def _kept(self, k: int, own: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The seeds of class k without its hottest ones; those left out cover fewer words than the seeds of any leak."""
        size = self.size[k]
        spare = self.loose(k) - 1
        covered = np.zeros(len(self.words[k]), bool)
        drop = set()
        for j in np.argsort(-count, kind="stable").tolist():
            if count[j] <= HOT:
                break
            more = covered.copy()
            for at in np.flatnonzero(self.seeds_of[k] == own[j]).tolist():
                more[at : at + size] = True
            if more.sum() <= spare:
                covered = more
                drop.add(j)
        return own[[j not in drop for j in range(len(own))]]

    def loose(self, k: int) -> int:
        """The words that whole seeds cover in any leak of class k: runs shorter than a seed may be the rest."""
        return max(1, self.need[k] - REPLACED * (self.size[k] - 1))

    def candidates(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Distinct rows (document, class) that share a seed of the index."""
        start = starts_of(n)
        room = np.repeat(start[1:], n) - np.arange(len(h))
        out = [np.zeros((0, 2), np.int64)]
        for size, (s, item) in self.index.items():
            g = runs(h, size)
            lo = np.searchsorted(s, g)
            some = np.flatnonzero((room >= size) & (s[np.minimum(lo, len(s) - 1)] == g))
            doc = np.searchsorted(start, some, side="right") - 1
            once = np.unique(np.stack([doc, lo[some]], axis=1), axis=0)  # a seed counts once in a document
            times = np.searchsorted(s, s[once[:, 1]], side="right") - once[:, 1]
            which = np.repeat(once[:, 1], times) + np.arange(times.sum()) - np.repeat(starts_of(times)[:-1], times)
            out.append(np.unique(np.stack([np.repeat(once[:, 0], times), item[which]], axis=1), axis=0))
        return np.concatenate(out)

    def matches(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the document and in the item of all their common seeds."""
        seeds, size = self.seeds_of[k], self.size[k]
        o = np.argsort(seeds, kind="stable")
        g = runs(words, size)[: len(words) - size + 1]
        lo, hi = np.searchsorted(seeds[o], g, side="left"), np.searchsorted(seeds[o], g, side="right")
        some = np.flatnonzero(hi > lo)
        times = (hi - lo)[some]
        pos = np.repeat(some, times)
        at = o[np.repeat(lo[some], times) + np.arange(len(pos)) - np.repeat(starts_of(times)[:-1], times)]
        return pos, at


def tiles(doc: np.ndarray, item: np.ndarray, pos: np.ndarray, at: np.ndarray, least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling from seed hits: (position in doc, position in item, length), the longest first."""
    found = {}
    for d in np.unique(pos - at):
        d = int(d)
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        equal = doc[lo + d : hi + d] == item[lo:hi]
        edge = np.flatnonzero(np.diff(np.r_[0, equal.astype(np.int8), 0]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= least:
                found[lo + a, d] = b - a
    marked_item, marked_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    todo = [(size, a, d) for (a, d), size in found.items()]
    while todo:
        todo.sort(reverse=True)
        size, a, d = todo.pop(0)
        free = ~(marked_item[a : a + size] | marked_doc[a + d : a + d + size])
        if free.all():
            marked_item[a : a + size] = True
            marked_doc[a + d : a + d + size] = True
            out.append((a + d, a, size))
        else:  # what is left of it is a shorter match
            edge = np.flatnonzero(np.diff(np.r_[0, free.astype(np.int8), 0]))
            todo += [(y - x, a + x, d) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()) if y - x >= least]
    return out


def longest_stretch(doc: np.ndarray, item: np.ndarray, shift: int, replaced: int = REPLACED) -> int:
    """Equal words in the best stretch of item that stands in doc at this shift, with at most `replaced` other words between them."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    equal = doc[lo + shift : hi + shift] == item[lo:hi]
    bad = np.r_[-1, np.flatnonzero(~equal), len(equal)]
    good = np.flatnonzero(equal)
    if not len(good):
        return 0
    best = 0
    for k in range(len(bad) - 1):  # the stretch lies between bad[k] and the bad word after `replaced` more
        end = bad[min(k + replaced + 1, len(bad) - 1)]
        a, b = np.searchsorted(good, bad[k] + 1), np.searchsorted(good, end) - 1
        if b >= a:
            best = max(best, int(b - a + 1))
    return best


def _scan(batches, items):
    for batch in batches:
        for part in range(0, batch.num_rows, 4000):
            some = batch.slice(part, 4000)
            h, n = word_hashes(some.column("text"))
            start = starts_of(n)
            rows: list[tuple[int, int, float, int]] = []
            for d, k in items.candidates(h, n).tolist():
                words, wanted = h[start[d] : start[d + 1]], items.words[k]
                size, need = items.size[k], items.need[k]
                pos, at = items.matches(words, k)
                covered = np.zeros(len(wanted) + size, bool)
                for j in range(size):
                    covered[at + j] = True
                if covered.sum() < items.loose(k):  # no tiling covers more
                    continue
                found = tiles(words, wanted, pos, at, max(TILE, size))
                share = sum(x for _, _, x in found) / len(wanted)
                shifts, count = np.unique(pos - at, return_counts=True)
                # a stretch of `need` equal words has at least so many seeds on its shift; else the fullest shift shows how far it is
                enough = shifts[count >= max(1, need - (REPLACED + 1) * (size - 1))] if count.max() >= need - (REPLACED + 1) * (size - 1) else shifts[count.argmax()][None]
                stretch = max(longest_stretch(words, wanted, int(x)) for x in enough)
                if stretch >= need or share >= COVERAGE and share * len(wanted) >= LEAST:
                    rows += [(d, i, share, stretch, need) for i in items.ids[k]]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_key").take(pa.array([r[0] for r in rows], type=pa.int64())),
                    pa.array([r[1] for r in rows], type=pa.int64()),
                    pa.array([r[2] for r in rows], type=pa.float64()),
                    pa.array([r[3] for r in rows], type=pa.int32()),
                    pa.array([r[4] for r in rows], type=pa.int32()),
                ],
                names=["doc_key", "item_id", "coverage", "stretch", "need"],
            )


def leaked_items(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """doc_key, item_id, coverage (share of the item's words in tiles), stretch (equal words of the best stretch in the
    item's order) and need (half of the item's words) of all leaks: coverage >= COVERAGE or stretch >= need.

    Rows that repeat a key count once, as do repeated items; null keys, null and empty texts leak nothing, nor do items
    of fewer than LEAST words; texts are scanned whole. Items are held by every task in blocks of at most
    ITEM_BLOCK_WORDS words; more items mean more scans of the documents. Empty tables give an empty result; other
    columns are ignored.
    """
    rows = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint").alias("k"), F.col(item_text).alias("t")).distinct()
    narrow = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("string").alias("doc_key"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = total // (ITEM_BLOCK_WORDS * 5) + 1
    out = None
    for b in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).orderBy("k", "t").toArrow()
        held = Items(some["k"].to_pylist(), some["t"].to_pylist())
        found = narrow.mapInArrow(lambda it, held=held: _scan(it, held), "doc_key string, item_id bigint, coverage double, stretch int, need int")
        out = found if out is None else out.unionByName(found)
    best = out.groupBy("doc_key", "item_id").agg(F.max(F.struct("stretch", "coverage", "need")).alias("b"), F.max("coverage").alias("coverage"))
    return best.select("doc_key", "item_id", "coverage", "b.stretch", "b.need")
