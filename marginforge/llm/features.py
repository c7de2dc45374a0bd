"""Hashed word n-gram features, shared by the text classifiers.

Tokens are runs of letters, runs of digits and runs of other visible characters.
A text's features are the hashed tokens and pairs of tokens (case folded), a mark
for words in capitals and one for a token that repeats the one before. Values are
square roots of counts, scaled to unit length; an empty or null text has none.
Ids, sources, languages and labels are never looked at.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Tokens kept by a worker before it starts its cache anew.
CACHE_TOKENS = 200_000


class Hasher:
    """Text -> (indices, values); one cache of token hashes a process."""

    def __init__(self, bits: int, pairs: bool = True, prefixes: tuple[int, ...] = (), binary: bool = False):
        self.bits, self.pairs, self.prefixes, self.binary = bits, pairs, prefixes, binary
        self.shift = np.uint64(64 - bits)
        self.cache: dict[str, int] = {}
        self.stems: dict[str, tuple[int, ...]] = {}

    def _hashes(self, tokens: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHE_TOKENS:
            cache.clear()
        for t in set(tokens).difference(cache):
            low = t.lower()
            raw = low.encode()
            caps = len(t) > 1 and t.isupper()
            cache[t] = (zlib.crc32(raw) << 31 | (zlib.crc32(raw, 0x5BD1E995) & 0x3FFFFFFF) << 1 | caps) & 0x7FFFFFFFFFFFFFFF
        return np.fromiter(map(cache.__getitem__, tokens), np.uint64, len(tokens))

    def _stems(self, tokens: list[str]) -> np.ndarray:
        """Hashes of the beginnings of the given lengths, of the longer ones among the distinct tokens."""
        cache, out = self.stems, []
        if len(cache) > CACHE_TOKENS:
            cache.clear()
        for t in set(tokens):
            own = cache.get(t)
            if own is None:
                low = t.lower()
                own = cache[t] = tuple(zlib.crc32(low[:n].encode()) for n in self.prefixes if len(low) > n)
            out += own
        return np.array(out, np.uint64)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall(text or "")
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        h = self._hashes(tokens)
        caps = int((h & np.uint64(1)).sum())
        h = h >> np.uint64(1)
        parts = [(h * _M1) >> self.shift]
        if self.prefixes:
            stems = self._stems(tokens)
            if len(stems):
                parts.append(((stems + np.uint64(0x1234567)) * _M2) >> self.shift)
        marks = {1: caps}
        if self.pairs and len(h) > 1:
            parts.append(((h[:-1] * _M2 + h[1:] * np.uint64(0x165667B19E3779F9)) * _M1) >> self.shift)
            marks[2] = int((h[1:] == h[:-1]).sum())
        idx, n = np.unique(np.concatenate(parts), return_counts=True)
        n = n.astype(np.float64)
        idx = idx.astype(np.int64)
        for k, c in marks.items():  # the first few cells are the marks' own
            if c:
                idx, n = np.append(idx, k), np.append(n, float(c))
        if self.binary:
            return idx, np.ones(len(idx))
        x = np.sqrt(n)
        return idx, x / np.sqrt((x * x).sum())
