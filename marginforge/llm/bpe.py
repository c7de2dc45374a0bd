"""Byte-level BPE encoding and decoding.

Texts are cut into pieces by the tokenizer's pattern. The distinct pieces a
worker has not met yet are dealt into matrices of similar byte length, padded
with -1, one row a piece. Each round merges the leftmost pair of lowest rank in
every row at once; ranks come from an open-addressing hash table over pairs of
ids, only the two pairs beside a merge are looked up anew, every merge takes a
column out, and rows without a mergeable pair leave the matrix. Pieces too long
for a matrix (their rounds would cost the square of the length) are merged in
the same order with a heap. A piece that is itself a token is taken whole, as
the tiktoken library does.

Null text is encoded as empty text: no ids, empty bytes. Rows are handled one by
one, so repeated rows give repeated results, and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import col, mapped, released

BIG = np.int64(1) << 40
#: Pieces of more bytes go to the heap.
MATRIX_BYTES = 256
#: Pieces kept by a worker before it starts its cache anew.
CACHE_PIECES = 200_000
#: Characters of text handled at a time.
SLICE_CHARS = 1_000_000


def load_ranks(path: str) -> bytes:
    """The raw bytes of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as f:
        return f.read()


class PairTable:
    """(left id, right id) -> merged id by multiplicative hashing and linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << bits, BIG)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            at, who = slot[todo[free]], todo[free]
            first = np.unique(at, return_index=True)[1]  # one newcomer a slot
            self.keys[at[first]], self.values[at[first]] = keys[who[first]], merged[who[first]]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids; BIG where the pair does not merge or a side is padding."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        out = np.full(len(left), BIG)
        live = np.flatnonzero((left >= 0) & (right >= 0))
        keys = (left[live].astype(np.uint64) << np.uint64(32)) | right[live].astype(np.uint64)
        slot = self._slot(keys)
        while len(live):
            seen = self.keys[slot]
            hit = seen == keys
            out[live[hit]] = self.values[slot[hit]]
            on = ~hit & (seen != np.uint64(0xFFFFFFFFFFFFFFFF))
            live, keys, slot = live[on], keys[on], (slot[on] + 1) & self.mask
        return out.reshape(shape)


class Codec:
    """Encoder and decoder of one vocabulary in one process."""

    def __init__(self, raw: bytes, pattern: str):
        import regex

        rows = [line.split() for line in raw.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in rows}
        self.find = regex.compile(pattern).findall
        self.token = [b""] * (max(self.rank.values()) + 1)
        left, right, merged = [], [], []
        get = self.rank.get
        for tok, r in self.rank.items():
            self.token[r] = tok
            for k in range(1, len(tok)):
                a, b = get(tok[:k]), get(tok[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int64))
        self.byte = np.array([self.rank.get(bytes([i]), -1) for i in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("a byte-level vocabulary needs all 256 single bytes")
        self.decimal = [b"%d" % i for i in range(len(self.token))]
        self.ids = list(range(len(self.token)))  # one object an id, shared by all pieces
        self.cache: dict[str, tuple[int, ...]] = {}

    # -- merging -------------------------------------------------------------
    def _matrix(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        ids = np.full((len(pieces), width), -1, np.int64)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[tuple[int, ...]] = [()] * len(pieces)
        row = np.arange(len(pieces))
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((len(pieces), 0), BIG)
        while True:
            j = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), j] if rank.shape[1] else np.full(len(row), BIG)
            over = best >= BIG
            if over.any():  # compaction: finished rows leave
                for k, r in zip(row[over].tolist(), ids[over], strict=True):
                    out[k] = tuple(map(self.ids.__getitem__, r[r >= 0].tolist()))
                keep = ~over
                row, ids, rank, j, best = row[keep], ids[keep], rank[keep], j[keep], best[keep]
            if not len(row):
                return out
            at = np.arange(len(row))
            ids[at, j] = best
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > j[:, None]), 1)
            cols = cols[:-1]
            rank = np.take_along_axis(rank, cols + (cols >= j[:, None]), 1)
            if rank.shape[1]:
                right = j < rank.shape[1]
                rank[at[right], j[right]] = self.pairs.get(ids[at[right], j[right]], ids[at[right], j[right] + 1])
                left = j > 0
                rank[at[left], j[left] - 1] = self.pairs.get(ids[at[left], j[left] - 1], ids[at[left], j[left]])

    def _heap(self, piece: bytes) -> tuple[int, ...]:
        n = len(piece)
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        token, rank = self.token, self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or (k := after[i]) >= n or token[ids[i]] + token[ids[k]] != token[r]:
                continue  # one of the two has changed since
            ids[i], ids[k] = r, -1
            after[i] = k = after[k]
            if k < n:
                before[k] = i
                if (s := rank.get(token[r] + token[ids[k]])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := rank.get(token[ids[h]] + token[r])) is not None:
                heapq.heappush(heap, (s, h))
        return tuple(i for i in ids if i >= 0)

    def _learn(self, pieces: set[str]) -> None:
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in sorted(pieces):
            raw = p.encode()
            if (whole := self.rank.get(raw)) is not None:
                self.cache[p] = (whole,)
            elif len(raw) > MATRIX_BYTES:
                self.cache[p] = self._heap(raw)
            else:
                buckets.setdefault(len(raw) if len(raw) < 24 else 24 + (len(raw) // 16), []).append((p, raw))
        for _, own in sorted(buckets.items()):
            for k in range(0, len(own), 4096):
                part = own[k : k + 4096]
                self.cache.update(zip((p for p, _ in part), self._matrix([r for _, r in part]), strict=True))

    # -- texts ---------------------------------------------------------------
    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        """Ids of each text, a slice of texts at a time."""
        texts, on = iter(texts), True
        while on:
            chars, cut = 0, []
            while chars < SLICE_CHARS and (on := (t := next(texts, self)) is not self):
                cut.append(self.find(t or ""))
                chars += len(t or "")
            if len(self.cache) > CACHE_PIECES:
                self.cache.clear()
            if new := set(chain.from_iterable(cut)).difference(self.cache):
                self._learn(new)
            get = self.cache.__getitem__
            for pieces in cut:
                yield list(chain.from_iterable(map(get, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """The process's codec of this vocabulary, made once."""
    key = (hashlib.sha256(raw).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(raw, pattern)
    return _codecs[key]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Append the ids of every whole text as array<int> column ``out``.

    A column already named ``out`` is replaced. The vocabulary (its file is the
    size bound) is broadcast, so executors need not have the file.
    """
    return _mapped(df, path, pattern, text, {out: T.ArrayType(T.IntegerType(), False)}, lambda c, v: _ids(c.encode(x.as_py() for x in v)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Append the bytes that the ids in ``ids`` stand for (null ids: empty)."""
    return _mapped(df, path, pattern, ids, {out: T.BinaryType()}, lambda c, v: [pa.array([c.decode(x or []) for x in v.to_pylist()], pa.binary())])


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode, then decode the ids; append n_tokens, ids_sha256 and decoded_sha256."""

    def digests(c: Codec, v: pa.Array) -> list[pa.Array]:
        n, a, b = [], [], []
        for ids in c.encode(x.as_py() for x in v):
            n.append(len(ids))
            a.append(hashlib.sha256(b",".join(map(c.decimal.__getitem__, ids))).hexdigest())
            b.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return _mapped(df, path, pattern, text, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, digests)


def _ids(rows: Iterator[list[int]]) -> list[pa.Array]:
    return [pa.array(list(rows), pa.list_(pa.int32()))]


def _mapped(df: DataFrame, path: str, pattern: str, source: str, new: dict[str, T.DataType], make) -> DataFrame:
    df = df.select(*[col(c) for c in df.columns if c.lower() not in {k.lower() for k in new}])
    raw, at = df.sparkSession.sparkContext.broadcast(load_ranks(path)), df.columns.index(source)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(raw.value, pattern)
        try:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, *make(c, b.column(at))], names=[*b.schema.names, *[f"n{k}" for k in range(len(new))]])
        finally:
            c.cache.clear()  # workers live on; what a task has learned must not pile up beside the next one's
            released()

    return mapped(df, work, [T.StructField(k, t) for k, t in new.items()])
