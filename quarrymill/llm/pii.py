"""Personal information in free text by a character BiLSTM with CRF transitions (problem 4).

A model in numpy labels every character of every text: outside, or begin or inside of one of five kinds. Nothing is
left out beforehand: texts are cut into overlapping windows that cover them whole. Each window is decoded by itself,
and the mentions are reconciled over the text: of two that overlap, the one further from its window's edges stands.

Decoding is exact but skips work that can't matter. With the emissions at hand, a recursion over the kinds, each by itself
but for moves between mentions that touch, bounds what any labelling that isn't outside at a position gains over
"outside" everywhere; where that bound isn't positive, the position is outside in a best labelling, and the Viterbi
recursion over all labels only runs over the stretches between such positions.

The gates are piecewise linear (hard sigmoid, clipped cell), which makes a step a matrix product and three clips. The
weights are trained by quarrymill.llm.pii_train from generated labelled spans and kept beside this file.
"""

from __future__ import annotations

import os
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "phone", "id_number", "address", "name"]
LABELS = 1 + 2 * len(KINDS)
WINDOW = 1536
OVERLAP = 96
BATCH = 1024
BATCH_CHARACTERS = 1_000_000
STEPS = 8
TEXTS = 10_000
NEVER = np.float32(-1e4)
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")

# Characters with a code of their own; all others go by class.
OWN = " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:!?'\"()[]<>@+-_/&#*|=~$%\n"
UPPER, LOWER, DIGIT, SPACE, OTHER, PAD = (len(OWN) + k for k in range(6))
CODES = len(OWN) + 6

_TABLE = np.full(0x3000, OTHER, dtype=np.int16)
for _c in range(0x3000):
    _x = chr(_c)
    _TABLE[_c] = UPPER if _x.isupper() else LOWER if _x.isalpha() else DIGIT if _x.isdigit() else SPACE if _x.isspace() else OTHER
for _k, _x in enumerate(OWN):
    _TABLE[ord(_x)] = _k


def codes(text: str) -> np.ndarray:
    """A small number for each character."""
    if text.isascii():
        return _TABLE.take(np.frombuffer(text.encode(), np.uint8))
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(u < 0x3000, _TABLE[np.minimum(u, 0x2FFF)], OTHER).astype(np.int16)


class Tagger:
    """The trained model: gate tables by character, recurrences, emissions and transitions."""

    def __init__(self, path: str = WEIGHTS):
        w = np.load(path)
        self.w = {k: w[k].astype(np.float32) for k in w.files}
        size = self.w["uf"].shape[0]
        for d in "fb":  # the slope and offset of the hard sigmoid go into the weights; gate by gate, so that each is contiguous
            x, u = self.w.pop("x" + d).copy(), self.w.pop("u" + d).copy()
            x[:, : 3 * size] *= 0.25
            u[:, : 3 * size] *= 0.25
            x[:, : 3 * size] += 0.5
            self.w["x" + d] = np.ascontiguousarray(x.reshape(len(x), 4, size).transpose(1, 0, 2))
            self.w["u" + d] = np.ascontiguousarray(u.reshape(size, 4, size).transpose(1, 0, 2))
        # inside only follows begin or inside of its kind
        for k in range(2, LABELS, 2):
            others = [j for j in range(LABELS) if j not in (k - 1, k)]
            self.w["move"][others, k] = NEVER
            self.w["start"][k] = NEVER
        move, start = self.w["move"] - self.w["move"][0, 0], self.w["start"] - self.w["start"][0]
        begin, inside = np.arange(1, LABELS, 2), np.arange(2, LABELS, 2)
        leave = np.stack([move[begin, 0], move[inside, 0]])
        again = (move[1:, begin] - move[1:, :1]).max(0)  # to a begin from no matter which mention, as if it were left first
        stay = np.stack([move[begin, inside], move[inside, inside]])
        self.bound = [x[..., None] for x in (start[begin], move[0, begin], again, leave, stay)]
        self.size = size
        self.begin = {"f": (np.float32(0), np.float32(0)), "b": self._settled("b")}

    def _settled(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The state and cell that padding, which followed most windows in training, leaves behind."""
        h, c = np.zeros((2, 1, self.size), np.float32)
        for _ in range(64):
            z = self.w["x" + name][:, PAD][:, None] + h @ self.w["u" + name]
            i, f, o = z[:3].clip(0, 1)
            c = (f * c + i * z[3].clip(-1, 1)).clip(-1, 1)
            h = o * c
        return h, c

    def _direction(self, x: np.ndarray, active: list[int], name: str, e: np.ndarray) -> None:
        """Adds one direction's share of the label scores to e (label by time by batch); x is time by batch.

        At time t only the columns from active[t] on have a character: each direction begins at its window's own first
        or last character, so no step is spent on padding and no window's scores depend on the windows beside it. Label
        scores are taken from a few steps at a time, while their states are in the cache.
        """
        table, u, size, wide, out = self.w["x" + name], self.w["u" + name], self.size, x.shape[1], self.w["out"]
        out = np.ascontiguousarray((out[:size] if name == "f" else out[size:]).T)
        states, c = np.empty((STEPS, wide, size), np.float32), np.empty((wide, size), np.float32)
        states[:], c[:] = self.begin[name]
        z, g = np.empty((4, wide, size), np.float32), np.empty((4, wide, size), np.float32)
        low, high, minus = np.float32(0), np.float32(1), np.float32(-1)
        add, multiply, matmul = np.add, np.multiply, np.matmul
        before, at = states[-1], -1
        blocks = range(0, len(x), STEPS)
        for lo in blocks if name == "f" else blocks[::-1]:
            hi = min(lo + STEPS, len(x))
            for t in range(lo, hi) if name == "f" else range(hi - 1, lo - 1, -1):
                if active[t] != at:
                    at = active[t]
                    zs, gs, cs = z[:, at:], g[:, at:], c[at:]
                    gates, i, f, o, q = zs[:3], zs[0], zs[1], zs[2], zs[3]
                table.take(x[t, at:], axis=1, out=gs, mode="clip")
                matmul(before[at:], u, out=zs)
                add(zs, gs, out=zs)
                gates.clip(low, high, out=gates)
                q.clip(minus, high, out=q)
                multiply(q, i, out=q)
                multiply(cs, f, out=cs)
                add(cs, q, out=cs)
                cs.clip(minus, high, out=cs)
                before = states[t - lo]
                multiply(o, cs, out=before[at:])
            first = active[lo]
            some = e[:, lo:hi, first:]
            some += (out @ states[: hi - lo, first:].reshape(-1, size).T).reshape(some.shape)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores, label by time by batch; those of PAD mean nothing."""
        n = (x != PAD).sum(0)
        if (n[1:] < n[:-1]).any():
            order = np.argsort(n, kind="stable")
            e = self.emissions(x[:, order])
            return e[:, :, np.argsort(order)]
        e = np.empty((LABELS, *x.shape), np.float32)
        e[:] = self.w["bias"][:, None, None]
        x, active = x.astype(np.intp), np.searchsorted(n, np.arange(len(x)), "right").tolist()
        for name in "fb":
            self._direction(x, active, name, e)
        return e

    def stretches(self, e: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """(column, first, end): wherever a best labelling may be other than outside; n has the windows' lengths.

        The best path through a begin or inside of each kind is bounded, from both ends; only moves from one mention
        right to another are taken together. A little is added, as these sums are rounded otherwise than the decoding's.
        """
        long, wide = e.shape[1:]
        start, enter, again, leave, stay = self.bound
        gain = np.empty((long, 2, len(KINDS), wide), np.float32)  # of begin and inside of each kind over outside
        for j in (0, 1):
            np.subtract(e[1 + j :: 2].transpose(1, 0, 2), e[0][:, None], out=gain[:, j])
        on, shortest = np.arange(long)[:, None] < n, int(n.min())
        np.copyto(gain[shortest:], np.float32(-1e9), where=~on[shortest:, None, None])
        ahead, a, b = np.empty_like(gain), np.empty_like(gain[0]), np.empty_like(gain[0, 0])
        outside, other = np.zeros(wide, np.float32), np.empty(wide, np.float32)
        add, maximum, most = np.add, np.maximum, np.maximum.reduce
        now = ahead[0]
        now[0], now[1] = gain[0, 0] + start, -1e9
        for t in range(1, long):
            was, now = now, ahead[t]
            most(add(was, leave, out=a).reshape(-1, wide), axis=0, out=other)
            add(was, stay, out=a)
            maximum(a[0], a[1], out=now[1])
            maximum(add(outside, enter, out=a[0]), add(other, again, out=b), out=now[0])
            now += gain[t]
            maximum(outside, other, out=outside)
        # what the rest adds to each label here and to outside; nothing at the end of a window
        rest, outside[:] = np.zeros_like(a), 0
        best, may = np.empty(wide, np.float32), np.zeros((long + 2, wide), np.int8)
        for t in range(long - 1, -1, -1):
            now = ahead[t]
            now += rest
            may[t + 1] = most(now.reshape(-1, wide), axis=0, out=best) > -0.01
            add(rest, gain[t], out=a)
            most(add(a[0], again, out=b), axis=0, out=other)
            most(add(a[0], enter, out=b), axis=0, out=best)
            add(a[1], stay, out=rest)
            maximum(rest, add(maximum(other, outside, out=other), leave, out=a), out=rest)
            maximum(outside, best, out=outside)
            if t >= shortest:
                rest *= on[t]
        col, at = np.nonzero(np.diff(np.ascontiguousarray(may.T), axis=1))
        return list(zip(col[::2].tolist(), at[::2].tolist(), at[1::2].tolist()))

    def pieces(self, x: np.ndarray, n: np.ndarray) -> list[tuple[int, int, bool, np.ndarray]]:
        """(column, first, whether the window ends there, label scores) of the stretches of windows of lengths n."""
        e = self.emissions(x)
        return [(c, f, end == n[c], e[:, f:end, c].copy()) for c, f, end in self.stretches(e, n)]

    def decode(self, found: list[tuple[int, bool, np.ndarray]]) -> list[np.ndarray]:
        """The best labels of stretches (first, whether the window ends there, label scores)."""
        move, out = self.w["move"], [np.zeros(0, np.int8)] * len(found)
        free, own = [0, *range(1, LABELS, 2)], np.arange(1, LABELS, 2)  # outside and begin may follow all labels; inside only two
        to_free, from_begin, from_inside = np.ascontiguousarray(move[:, free])[:, :, None], move[own, own + 1][:, None], move[own + 1, own + 1][:, None]
        order = sorted(range(len(found)), key=lambda k: found[k][2].shape[1])
        lengths = [found[k][2].shape[1] for k in order]
        lo = 0
        while lo < len(order):  # stretches of about one length together
            hi = bisect_right(lengths, 16 + lengths[lo] * 3 // 2, lo, min(lo + 512, len(order)))
            some, size = order[lo:hi], np.array(lengths[lo:hi])
            lo, longest = hi, lengths[hi - 1]
            every, active = np.arange(len(some)), np.searchsorted(size, np.arange(longest), "right").tolist()
            score = np.zeros((longest, LABELS, len(some)), np.float32)
            for j, k in enumerate(some):
                score[: size[j], :, j] = found[k][2].T
            first, ends = np.array([found[k][0] for k in some]), np.array([found[k][1] for k in some])
            score[0] += np.where((first == 0)[None, :], self.w["start"][:, None], move[0][:, None])
            for t in range(1, longest):  # columns from active[t] on go on at t
                was, now = score[t - 1, :, active[t] :], score[t, :, active[t] :]
                best = (was[:, None, :] + to_free).max(0)
                now[0] += best[0]
                now[1::2] += best[1:]
                now[2::2] += np.maximum(was[1::2] + from_begin, was[2::2] + from_inside)
            # the way back looks for the label before only along the best path
            y = np.zeros((longest, len(some)), np.int8)
            now = (score[size - 1, :, every] + np.where(ends[:, None], 0, move[:, 0][None, :])).argmax(1)
            for t in range(longest - 1, -1, -1):
                y[t, active[t] :] = now[active[t] :]
                if t:
                    now[active[t] :] = (score[t - 1, :, active[t] :] + move.take(now[active[t] :], axis=1)).argmax(0)
            for j, k in enumerate(some):
                out[k] = y[: size[j], j]
        return out


_tagger: dict[str, Tagger] = {}


def tagger(path: str = WEIGHTS) -> Tagger:
    if path not in _tagger:
        _tagger[path] = Tagger(path)
    return _tagger[path]


def windows_of(length: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover a text."""
    out, a = [], 0
    while length - a > WINDOW:
        out.append((a, a + WINDOW))
        a += WINDOW - OVERLAP
    out.append((a, length))
    return out


def spans_of(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the mentions in a sequence of labels."""
    y = np.append(labels, 0)
    kind = (y + 1) // 2
    start = (y > 0) & ((y % 2 == 1) | (kind != np.concatenate([[0], kind[:-1]])))
    at, stops = np.flatnonzero(start), np.flatnonzero(start | (y == 0))
    return list(zip(at.tolist(), stops[np.searchsorted(stops, at, "right")].tolist(), (kind[at] - 1).tolist()))


def find_mentions(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """The mentions (start, end, kind) of each text, in order and without overlap; copies of a text are searched once."""
    first_of: dict[str, int] = {}
    copy_of = [first_of.setdefault(t, len(first_of)) for t in texts]
    coded = [codes(t) for t in first_of]
    windows = [(k, a, b) for k, c in enumerate(coded) if len(c) for a, b in windows_of(len(c))]
    windows.sort(key=lambda w: w[2] - w[1])
    raw: list[list[tuple[int, int, int, int]]] = [[] for _ in coded]
    pieces: list[tuple] = []
    at = 0
    while at < len(windows):
        longest = windows[min(at + BATCH, len(windows)) - 1]
        some = windows[at : at + max(1, min(BATCH, BATCH_CHARACTERS // (longest[2] - longest[1])))]
        at += len(some)
        n = np.array([b - a for _, a, b in some])
        x = np.full((len(some), int(n[-1])), PAD, dtype=np.int16)
        for j, (k, a, b) in enumerate(some):
            x[j, : b - a] = coded[k][a:b]
        pieces += [(*some[j], first, ends, z) for j, first, ends, z in model.pieces(np.ascontiguousarray(x.T), n)]
    # all stretches in one sequence, each followed by a label outside
    labels = model.decode([p[3:] for p in pieces])
    begin = np.cumsum([0, *(len(y) + 1 for y in labels)])
    joined = np.zeros(begin[-1], np.int8)
    for y, s in zip(labels, begin.tolist()):
        joined[s : s + len(y)] = y
    found = spans_of(joined)
    for (s, e, kind), p in zip(found, (np.searchsorted(begin, [f[0] for f in found], "right") - 1).tolist()):
        k, a, b, first, _, _ = pieces[p]
        s, e = s - int(begin[p]) + first, e - int(begin[p]) + first
        inner = min(s if a else 9999, (b - a) - e if b < len(coded[k]) else 9999)
        raw[k].append((inner, a + s, a + e, kind))
    out = []
    for each in raw:
        chosen: list[tuple[int, int, int]] = []
        for _, s, e, kind in sorted(each, key=lambda f: (-f[0], f[1])):
            if all(e <= x or s >= y for x, y, _ in chosen):
                chosen.append((s, e, kind))
        out.append(sorted(chosen))
    return [out[k] for k in copy_of]


def placeholders(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with each mention replaced by its kind in brackets, everything else unchanged."""
    parts, at = [], 0
    for s, e, kind in found:
        parts += [text[at:s], f"[{KINDS[kind].upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, key: str, text: str, weights: str = WEIGHTS) -> DataFrame:
    """doc_key, mentions (pii_type, start_pos, end_pos; offsets in code points) and redacted text of every row.

    A null text has a null redacted text and no mentions, an empty one stays empty; repeated rows give repeated
    results; an empty table an empty result. Texts are searched whole; other columns are ignored.
    """

    def run(batches):
        model = tagger(weights)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                texts = batch.column(1).to_pylist()
                found = find_mentions([t or "" for t in texts], model)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([[{"pii_type": KINDS[k], "start_pos": s, "end_pos": e} for s, e, k in f] for f in found], type=pa.list_(pa.struct([("pii_type", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64())]))),
                        pa.array([None if t is None else placeholders(t, f) for t, f in zip(texts, found)], type=pa.string()),
                    ],
                    names=["doc_key", "mentions", "redacted"],
                )

    narrow = df.select(F.col(key).cast("string").alias("doc_key"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_key string, mentions array<struct<pii_type:string,start_pos:bigint,end_pos:bigint>>, redacted string")


def mentions(df: DataFrame, key: str, text: str, weights: str = WEIGHTS) -> DataFrame:
    """doc_key, pii_type, start_pos, end_pos: one row for each mention; repeated rows count once, null keys not at all."""
    each = redact(df.where(F.col(key).isNotNull() & F.col(text).isNotNull()), key, text, weights).select("doc_key", "mentions").where(F.size("mentions") > 0)
    return each.select("doc_key", F.inline("mentions")).distinct()
