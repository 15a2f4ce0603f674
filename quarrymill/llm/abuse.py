"""Abusive, hateful or sexual content by a subsequence-kernel support vector machine (problem 3).

Two subsequence kernels work together. On characters, a gap-weighted kernel brings disguised words (letters starred
out, put in, repeated or replaced by digits and look-alikes) back to the word of the lexicon they are most similar
to; the lexicon holds the words that tell abusive from other sentences of the labelled sample. On words, the kernel
of gap-weighted subsequences of up to two words compares sentences. The machine is trained on a Nyström
approximation with landmark sentences of the sample. Its decision function is a weighted sum of kernels with the
landmarks, and as each kernel is an inner product over word pairs, the sum is folded into one weight for each pair of
landmark words: scoring a sentence is exact and needs no kernel evaluation.

Labels are the taggers' sentence scores, wrong here and there but without a bias for single wordings, and the pairs
of toxic and neutral comments. Only the model is fitted on a bounded sample; every record is scored as a whole.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.encoding import TOKENIZERS

DECAY = 0.7
GAP = 6
WINDOW = 18
STRIDE = 9
SAMPLE_RECORDS = 9_000  # the bound on the labelled records the model is fitted on
BEGINNING = 40  # of sentences that begin with the same two words, so many are used, whatever their labels
SAMPLE_PAIRS = 1500
LANDMARKS = 700
BLOCK = 1000
RIDGE = 0.003
LEXICON = 160
ALIKE = 0.55

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKE = str.maketrans("аеорсухіјѕԁӏһкмтвнɑοιєεаα", "aeopcyxijsdlhkmtbhaoieeaa")
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")

_ENDS = re.compile(r"[.!?…]+[\s\"')\]]+|[\r\n]+|[.!?…]+$")
_EDGES = " \t.,;:!?…\"'`()[]{}<>*_~-–—/\\|#@“”‘’«»"
_PLAIN = re.compile(r"[a-z]+(?:['’-][a-z]+)*$")
_REPEAT = re.compile(r"(\w)\1{2,}")
_SPACED = re.compile(r"(?<!\S)(?:[a-z*@$!0-9]([ ._-]))(?:[a-z*@$!0-9]\1){2,}[a-z*@$!0-9](?!\w)")
INSERTED = 2  # so many letters may be put into a word of the lexicon


def clean(text: str) -> str:
    """Lower case, compatibility forms folded, invisible characters gone, look-alikes Latin."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Mn"))
        text = text.lower().translate(LOOKALIKE)
    return text.lower()


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence, letters that are spelled one by one joined; long ones as overlapping windows."""
    out = []
    for part in _ENDS.split(_SPACED.sub(lambda m: m.group().replace(m.group(1), ""), clean(text))):
        w = [x for x in (y.strip(_EDGES) or ("*" if "*" in y else "") for y in part.split()) if x]
        if len(w) <= WINDOW + 4:
            if w:
                out.append(w)
        else:
            out += [w[k : k + WINDOW] for k in range(0, len(w) - STRIDE, STRIDE)]
    return out


def subsequence_kernel(a: str, b: str, order: int = 2, decay: float = DECAY) -> float:
    """The gap-weighted kernel of the common subsequences of `order` characters of two strings."""
    k = np.ones((len(a) + 1, len(b) + 1))
    same = np.array([[x == y for y in b] for x in a], dtype=float).reshape(len(a), len(b))
    total = 0.0
    for step in range(order):
        if step == order - 1:
            return float(decay**2 * (same * k[: len(a), : len(b)]).sum())
        new = np.zeros_like(k)
        for i in range(1, len(a) + 1):
            run = 0.0
            for j in range(1, len(b) + 1):
                run = decay * run + decay**2 * same[i - 1, j - 1] * k[i - 1, j - 1]
                new[i, j] = decay * new[i - 1, j] + run
        k = new
    return total


def likeness(a: str, b: str) -> float:
    """The normalised kernel, framed by word ends so that first and last letters count."""
    a, b = f"^{a}$", f"^{b}$"
    return subsequence_kernel(a, b) / max(1e-9, (subsequence_kernel(a, a) * subsequence_kernel(b, b)) ** 0.5)


class PairWeights:
    """Weights of pairs of word numbers in an open hash table: as many entries as the landmarks have pairs, at most
    LANDMARKS * WINDOW * GAP, however large the vocabulary is."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
        todo, probe = np.arange(len(keys)), 0
        first = self._slot(keys)
        while len(todo):
            at = first[todo] + probe & len(self.keys) - 1
            free = self.keys[at] < 0
            _, once = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[once]
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[todo[put]]
            todo = np.delete(todo, put)
            probe += 1
        self.probes = probe

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.float32(0))
        todo = np.flatnonzero((found != keys) & (found >= 0))
        for k in range(1, self.probes):
            if not len(todo):
                break
            where = at[todo] + k & len(self.keys) - 1
            found = self.keys[where]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[where[hit]]
            todo = todo[~hit & (found >= 0)]
        return out


@dataclass
class Model:
    """Word numbers, the folded weights of words and pairs, the offset, and ordinary words that are no disguises."""

    number: dict[str, int]
    lexicon: list[str]
    single: np.ndarray
    pair: PairWeights
    offset: float
    ordinary: frozenset[str] = frozenset()

    def __post_init__(self):
        self.known = dict(self.number)
        self.by_first: dict[str, list[str]] = {}
        for w in self.lexicon:
            self.by_first.setdefault(w[0], []).append(w)
        some = [w for w in self.lexicon if len(w) > 3]
        gap = f"[a-z]{{0,{INSERTED}}}"
        self.inserted = re.compile("|".join(f"(?={gap.join(w)}{gap}$)" for w in some)) if some else None

    def code(self, word: str) -> int:
        """The number of a word, of the lexicon word it is a disguise of, or 0."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known = dict(self.number)
            found = self.known[word] = self.number.get(self.uncover(word), 0)
        return found

    def uncover(self, word: str) -> str:
        """The word behind a disguise: the most similar of the lexicon, if similar enough; else the word itself.

        A word of plain letters is compared if it holds a lexicon word of over three letters with at most INSERTED
        letters between any two of its letters and so many more in all, and isn't an ordinary word itself.
        """
        if len(word) > 24:
            return word
        if _PLAIN.match(word) and "-" not in word and not _REPEAT.search(word):
            if self.inserted is None or word in self.ordinary or not self.inserted.match(word):
                return word
            near = [w for w in self.by_first.get(word[0], ()) if 3 < len(w) < len(word) <= len(w) + INSERTED and _within(w, word)]
        else:
            folded = word.translate(SIGNS)
            letters = re.sub(r"[^a-z]", "", folded)
            for w in (letters, _REPEAT.sub(r"\1", letters), _REPEAT.sub(r"\1\1", letters)):
                if w in self.number:
                    return w
            word_, word = word, _REPEAT.sub(r"\1", letters)
            if len(word) < 2:
                return word_
            near = [w for w in self.by_first.get(word[0], ()) if len(w) < len(word) + 5]
            best = max(((likeness(word, w), w) for w in near), default=(0.0, word_))
            return best[1] if best[0] >= ALIKE else word_
        best = max(((likeness(word, w), w) for w in near), default=(0.0, word))
        return best[1] if best[0] >= ALIKE else word

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest score of any sentence of each text; -1 for a text without words."""
        flat: list[int] = []
        sizes: list[int] = []
        owner: list[int] = []
        code, known = self.code, self.known
        for k, t in enumerate(texts):
            for w in sentences(t) if t else ():
                flat += [known[x] if x in known else code(x) for x in w]
                sizes.append(len(w))
                owner.append(k)
        out = np.full(len(texts), -1.0)
        if sizes:
            np.maximum.at(out, owner, self.decide(np.array(flat), np.array(sizes)))
        return out

    def decide(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        of = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(of, weights=self.single[flat], minlength=len(sizes))
        width = len(self.single)
        for g in range(1, GAP + 1):
            if len(flat) <= g:
                break
            some = np.flatnonzero((of[g:] == of[:-g]) & (flat[:-g] > 0) & (flat[g:] > 0))
            total += np.bincount(of[g:][some], weights=DECAY**g * self.pair.of(flat[some] * width + flat[some + g]), minlength=len(sizes))
        return total / length_norm(sizes) + self.offset


def _within(short: str, long: str) -> bool:
    """Whether short is a subsequence of long."""
    rest = iter(long)
    return all(c in rest for c in short)


def ordinary_words(vocabulary: str) -> frozenset[str]:
    """Words that a public tokenizer keeps whole; a file that can't be read gives none."""
    try:
        with open(vocabulary, encoding="ascii") as f:
            each = (base64.b64decode(line.split()[0]) for line in f)
            return frozenset(w[1:].decode() for w in each if re.fullmatch(rb" [a-z]{4,}", w))
    except OSError:
        return frozenset()


NO_PAIRS = PairWeights(np.zeros(0, np.int64), np.zeros(0, np.float32))


def length_norm(sizes: np.ndarray) -> np.ndarray:
    """The norm of a sentence of that many different words in the feature space of the kernel."""
    n = sizes.astype(float)
    return np.sqrt(n + sum(DECAY ** (2 * g) * np.maximum(n - g, 0) for g in range(1, GAP + 1)))


def _features(coded: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of sentences: features are word numbers and width * (1 + first) + second for pairs; 0 is no word."""
    sizes = np.array([len(c) for c in coded])
    flat = np.array([x for c in coded for x in c], dtype=np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    norm = length_norm(sizes)
    rows, feats, vals = [of], [flat], [np.ones(len(flat))]
    for g in range(1, GAP + 1):
        same = of[g:] == of[:-g]
        a, b = flat[:-g][same], flat[g:][same]
        rows.append(of[g:][same])
        feats.append(np.where((a > 0) & (b > 0), width * (1 + a) + b, 0))
        vals.append(np.full(len(a), DECAY**g))
    r, f, v = np.concatenate(rows), np.concatenate(feats), np.concatenate(vals)
    keep = f > 0
    return r[keep], f[keep], (v / norm[r])[keep]


def train(sents: list[list[str]], labels: np.ndarray, landmarks: int = LANDMARKS, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> Model:
    """Fit the machine on labelled sentences (lists of words, labels 0 or 1), in their given order."""
    y = np.where(labels > 0, 1.0, -1.0)
    pos: dict[str, int] = {}
    neg: dict[str, int] = {}
    for s, k in zip(sents, labels):
        for w in set(s):
            (pos if k else neg)[w] = (pos if k else neg).get(w, 0) + 1
    np_, nn = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    odds = {w: np.log((c + 0.5) / np_) - np.log((neg.get(w, 0) + 0.5) / nn) for w, c in pos.items() if c >= 4 and _PLAIN.match(w) and len(w) > 2}
    lexicon = sorted(odds, key=lambda w: (-odds[w] * min(pos[w], 20) ** 0.5, w))[:LEXICON]
    vocab = sorted({w for c in (pos, neg) for w in c if pos.get(w, 0) + neg.get(w, 0) >= 3} | set(lexicon))
    number = {w: k + 1 for k, w in enumerate(vocab)}
    width = len(number) + 1
    usual = ordinary_words(vocabulary) - set(lexicon)
    blank = Model(number, lexicon, np.zeros(width), NO_PAIRS, 0.0, usual)
    coded = [[blank.code(w) for w in s] for s in sents]
    # landmarks: half of each label, beginnings that are new first
    chosen: list[int] = []
    for want in (1, 0):
        seen: dict[tuple, int] = {}
        rank = []
        for k, s in enumerate(sents):
            if labels[k] == want:
                key = tuple(s[:2])
                seen[key] = seen.get(key, 0) + 1
                rank.append((seen[key], k))
        chosen += [k for _, k in sorted(rank)[: landmarks // 2]]
    m = len(chosen)
    r, f, v = _features(coded, width)
    mark = np.full(len(sents), -1)
    mark[chosen] = np.arange(m)
    own = mark[r] >= 0
    lf, lr, lv = f[own], mark[r[own]], v[own]
    o = np.argsort(lf, kind="stable")
    lf, lr, lv = lf[o], lr[o], lv[o]
    o = np.argsort(r, kind="stable")
    r, f, v = r[o], f[o], v[o]
    lo, hi = np.searchsorted(lf, f, side="left"), np.searchsorted(lf, f, side="right")
    # kernels of all sentences with the landmarks, a block of sentences at a time
    k = np.zeros((len(sents), m), np.float32)
    for a in range(0, len(sents), BLOCK):
        x, y_ = np.searchsorted(r, (a, a + BLOCK))
        times = hi[x:y_] - lo[x:y_]
        at = np.repeat(np.arange(x, y_), times)
        which = np.repeat(lo[x:y_], times) + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        rows = min(BLOCK, len(sents) - a)
        k[a : a + rows] = np.bincount((r[at] - a) * m + lr[which], weights=v[at] * lv[which], minlength=rows * m).reshape(rows, m)
    value, vector = np.linalg.eigh(k[chosen].astype(float))
    good = value > 1e-5 * value.max()
    root = (vector[:, good] / np.sqrt(value[good])).astype(np.float32)
    z = np.empty((len(sents), root.shape[1] + 1), np.float32)
    z[:, -1] = 1
    for a in range(0, len(sents), BLOCK):
        z[a : a + BLOCK, :-1] = k[a : a + BLOCK] @ root
    del k
    # squared hinge by Newton steps on the primal
    w = np.zeros(z.shape[1])
    reg = np.full(z.shape[1], RIDGE * len(sents) / 100)
    reg[-1] = 1e-6
    for _ in range(12):
        gram, side = np.diag(reg), np.zeros(z.shape[1])
        for a in range(0, len(sents), BLOCK):
            block, want = z[a : a + BLOCK], y[a : a + BLOCK]
            active = want * (block @ w) < 1
            block = block[active]
            gram += block.T @ block
            side += block.T @ want[active]
        new = np.linalg.solve(gram, side)
        if np.abs(new - w).max() < 1e-3:
            break
        w = new
    beta = root @ w[:-1]
    feats, of = np.unique(lf, return_inverse=True)
    weight = np.bincount(of, weights=beta[lr] * lv)
    words, pairs = feats < width, feats >= width
    single = np.zeros(width)
    single[feats[words]] = weight[words]
    single[0] = 0
    folded = PairWeights((feats[pairs] // width - 1) * width + feats[pairs] % width, weight[pairs].astype(np.float32))
    return Model(number, lexicon, single.astype(np.float32), folded, float(w[-1]), usual)


def labelled_sentences(records: DataFrame, pairs: DataFrame | None) -> tuple[list[list[str]], np.ndarray]:
    """Sentences and labels of at most about SAMPLE_RECORDS records and SAMPLE_PAIRS comment pairs, in a fixed order."""
    n = records.count()
    every = max(1, n // SAMPLE_RECORDS)
    some = records.where("text is not null and toxic_spans is not null and id is not null").where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)
    some = some.select("id", "text", "toxic_spans").orderBy("id").limit(SAMPLE_RECORDS).dropDuplicates(["id"])
    # only the labelled sentences come here, not the texts around them
    span = F.col("span")
    spans = some.select("id", "text", F.posexplode("toxic_spans").alias("at", "span")).where((F.size(span) >= 3) & ~F.exists(span, lambda v: v.isNull()))
    start, end = F.get(span, F.lit(0)).try_cast("int"), F.get(span, F.lit(1)).try_cast("int")
    good = spans.where((start >= 0) & (start < end) & (end <= F.length("text"))).select("id", "at", F.substring("text", start + 1, end - start).alias("part"), (F.get(span, F.lit(2)) > 0.5).alias("label"))
    sents, labels = [], []
    for r in good.orderBy("id", "at").toArrow().to_pylist():
        found = sentences(r["part"])
        if len(found) == 1 and len(found[0]) > 1:
            sents.append(found[0])
            labels.append(r["label"])
    if pairs is not None:
        every = max(1, pairs.count() // SAMPLE_PAIRS)
        some = pairs.where(F.pmod(F.xxhash64("pair_id"), F.lit(every)) == 0).select("pair_id", "en_toxic_comment", "en_neutral_comment").orderBy("pair_id", "en_neutral_comment").limit(SAMPLE_PAIRS)
        for r in some.toArrow().to_pylist():
            for text, label in ((r["en_toxic_comment"], True), (r["en_neutral_comment"], False)):
                for s in sentences(text) if text else ():
                    if len(s) > 1 and (label is False or len(s) > 8):
                        sents.append(s)
                        labels.append(label)
    return varied(sents, labels)


def varied(sents: list[list[str]], labels: list) -> tuple[list[list[str]], np.ndarray]:
    """The first BEGINNING sentences of each beginning: rare wordings keep their weight beside frequent ones."""
    seen: dict[tuple, int] = {}
    keep = []
    for k, s in enumerate(sents):
        n = seen[tuple(s[:2])] = seen.get(tuple(s[:2]), 0) + 1
        if n <= BEGINNING:
            keep.append(k)
    return [sents[k] for k in keep], np.array([labels[k] for k in keep], dtype=int)


def fitted(records: DataFrame, pairs: DataFrame | None = None) -> Model:
    """The model of a table's labelled sample; without labels of both kinds one that finds nothing. Its size is bounded by
    the sample's: SAMPLE_RECORDS records and SAMPLE_PAIRS pairs."""
    sents, labels = labelled_sentences(records, pairs)
    if not 0 < labels.sum() < len(labels):
        return Model({}, [], np.zeros(1, np.float32), NO_PAIRS, -1.0)
    return train(sents, labels)


def abuse_scores(records: DataFrame, pairs: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """id, source, score of every record; a score above 0 means abusive, hateful or sexual content.

    Null, empty and blank texts have the score -1, null ids are left out, repeated rows give repeated results (equal
    ones, as texts are). Texts are scored whole. Without labelled rows of both kinds every score is -1. Other columns
    are ignored.
    """
    model = model or fitted(records, pairs)
    held = records.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2500):
                b = whole.slice(at, 2500)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m.scores(b.column(2).to_pylist()))], names=["id", "source", "score"])

    return records.where("id is not null").select(F.col("id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(run, "id string, source string, score double")


def abusive_records(records: DataFrame, pairs: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """The ids of the records with such content, each once."""
    return abuse_scores(records, pairs, model).where("score > 0").select("id").distinct()


def abuse_rates(records: DataFrame, pairs: DataFrame | None = None, model: Model | None = None) -> DataFrame:
    """For each source (null where it is unknown): records, abusive ones and their rate; repeated ids count once."""
    each = abuse_scores(records, pairs, model).groupBy("id").agg(F.max("score").alias("score"), F.max("source").alias("source"))
    return each.groupBy("source").agg(F.count("*").alias("records"), F.count_if(F.col("score") > 0).alias("abusive")).withColumn("rate", F.round(F.col("abusive") / F.col("records"), 6))
