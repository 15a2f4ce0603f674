"""Encoding whole texts with a byte-level BPE vocabulary (problem 7).

Exact without replaying merges: a sequence of tokens is the BPE encoding of a piece exactly if every adjacent pair is
compatible, that is, encoding the pair's joined bytes gives the pair again. So a piece is encoded from left to right
with the longest token that fits the last one; where nothing fits, the last token is given up for the next shorter
one, and positions known to lead nowhere aren't tried again, which keeps the work linear. All tokens that begin at a
position come from one pass of an Aho-Corasick automaton over the piece's bytes written as Latin-1 characters.
Compatibility of token pairs and the encodings of recent pieces are memoised.
"""

from __future__ import annotations

import base64

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"

# Fixed value: the published pre-tokenization pattern of the vocabulary.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PIECE_MEMORY = 500_000
PAIR_MEMORY = 2_000_000


class BytePairEncoder:
    """Encoder for a file of base64 tokens and ranks (path), ids being the ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.rank = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.text: list[str] = [""] * (max(self.rank.values()) + 1)
        for t, r in self.rank.items():
            self.text[r] = t
        self.automaton = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.automaton.add_word(t, r)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in self.text]
        self.left = list(range(len(self.text)))
        self.right = list(range(len(self.text)))
        self.fits: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for r, t in enumerate(self.text):
            if len(t) > 1:
                self._split(r, t)
        self.fits.clear()
        self.pieces: dict[str, list[int]] = {}
        self.cut = regex.compile(PIECES)

    def _prefix(self, t: str) -> int:
        """The longest token that is a proper prefix of t, or -1."""
        for n in range(len(t) - 1, 0, -1):
            r = self.rank.get(t[:n])
            if r is not None:
                return r
        return -1

    def _split(self, r: int, t: str) -> None:
        """Find the pair of earlier tokens whose merge makes token r."""
        a = self.shorter[r]
        while a >= 0:
            b = self.rank.get(t[len(self.text[a]) :])
            if b is not None and a < r and b < r and self.compatible(a, b):
                self.left[r], self.right[r] = a, b
                self.merged[a, b] = r
                return
            a = self.shorter[a]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is these two tokens."""
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > PAIR_MEMORY:
                self.fits.clear()
            found = self.fits[a, b] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        # Undo merges from the latest to the earliest along the seam; if an earlier merge joins what touches there, it would have come first.
        bound = len(self.text)
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < bound:
                return False
            if a > b:
                bound, a = a, self.right[a]
                if a != bound:
                    continue
                bound, b0 = b + 1, b
                b = self.left[b]
                if b == b0:
                    return True
            else:
                bound, b0 = b + 1, b
                b = self.left[b]
                if b != b0:
                    continue
                bound, a0 = a, a
                a = self.right[a]
                if a == a0:
                    return True

    def piece(self, t: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters of its bytes."""
        whole = self.rank.get(t)
        if whole is not None and self.left[whole] != self.right[whole] or len(t) == 1:
            return [whole]
        n = len(t)
        longest = [-1] * (n + 1)
        for end, r in self.automaton.iter(t):
            at = end + 1 - len(self.text[r])
            if longest[at] < 0 or len(self.text[r]) > len(self.text[longest[at]]):
                longest[at] = r
        hopeful = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.text[token])
                if hopeful[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at]
            else:
                hopeful[at] = 0
                token = out.pop()
                at -= len(self.text[token])
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text without special tokens; the empty list for an empty or null text."""
        out: list[int] = []
        known = self.pieces
        for p in self.cut.findall(text) if text else ():
            ids = known.get(p)
            if ids is None:
                if len(known) > PIECE_MEMORY:
                    known.clear()
                ids = known[p] = self.piece(p.encode("utf-8", "surrogatepass").decode("latin-1"))
            out += ids
        return out


_encoders: dict[str, BytePairEncoder] = {}


def encoder(path: str) -> BytePairEncoder:
    """One encoder for each vocabulary and process."""
    if path not in _encoders:
        _encoders[path] = BytePairEncoder(path)
    return _encoders[path]


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """key and ids of every row; null and empty texts have the empty list, a null key stays null.

    Texts are encoded whole, however long; white space and any other character counts. Repeated rows give repeated
    results, an empty table an empty one, and other columns are ignored.
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids = [enc.encode(t) for t in some.column(1).to_pylist()]
                flat = pa.array([i for x in ids for i in x], type=pa.int32())
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(texts: list[str | None], vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> list[int]:
    """Sizes of texts in tokens."""
    enc = encoder(vocabulary)
    return [len(enc.encode(t)) for t in texts]
