"""Words of texts as 64-bit hashes, a batch at a time.

Lower case; punctuation, symbols and format characters vanish; white space of any kind separates words.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from quarrymill.llm.arrow import mix

_NOISE = re.compile(r"[^\w\s]+|_+")
_known: dict[str, int] = {}
_KNOWN_LIMIT = 400_000


def split_words(text: str | None) -> list[str]:
    """The words of one text; none for a null text."""
    return _NOISE.sub("", text.lower()).split() if text else []


def hashes_of(found: list[str]) -> np.ndarray:
    """The hash of each word; equal in every process."""
    codes, unique = pd.factorize(np.array(found, dtype=object))
    if len(_known) > _KNOWN_LIMIT:
        _known.clear()
    out = np.empty(len(unique), dtype=np.uint64)
    for k, w in enumerate(unique):
        v = _known.get(w)
        if v is None:
            v = _known[w] = xxhash.xxh64_intdigest(w)
        out[k] = v
    return out[codes] if len(found) else np.zeros(0, dtype=np.uint64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts one after the other, and the number of words of each text."""
    each = [split_words(t) for t in texts.to_pylist()]
    flat = [w for ws in each for w in ws]
    return hashes_of(flat), np.fromiter(map(len, each), dtype=np.int64, count=len(each))


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of the n words from each position on (positions near the end of a text reach into the next)."""
    out = np.zeros(len(h), dtype=np.uint64)
    for k in range(n):
        out[: len(h) - k] += mix(h[k:], 40 + k) * np.uint64(2 * k + 3)
    return mix(out, 60)


def odd_powers(lengths: np.ndarray, salt: int) -> np.ndarray:
    """A factor for each position of each text, the same for the same position."""
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return mix(at.astype(np.uint64), salt) | np.uint64(1)
