"""Approximate nearest neighbours: one navigable small-world graph a shard.

Vectors are scaled to unit length; a shard's graph is built by inserting them in
order of a seeded permutation, and kept as flat neighbour arrays: for each layer
a row of at most m (2 m in the lowest) neighbour numbers a node, padded with -1.
Searches go down greedily and widen in the lowest layer; what a shard finds is
scored again with the original vectors in double precision and merged.

Null, zero and non-finite vectors take no part, nor do rows without id; very small
and very large components are scaled by powers of two first. Rows that share an id
are rows of their own: each is a query, and a candidate of the other. Equal vectors
form one node, so copies never fill a list; ties go to the smaller id; other
columns are ignored; empty tables give no rows. Measured recall at 5 is in the
README; tests hold it to brute force.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

SHARD_ROWS = 8192


class Graph:
    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 100, seed: int = 1):
        """Graph over the rows of ``x`` (unit vectors)."""
        rng = np.random.default_rng(seed)
        n = len(x)
        self.x = np.ascontiguousarray(x, np.float32)
        level = np.minimum((-np.log(np.maximum(rng.random(n), 1e-12)) / np.log(m)).astype(np.int64), 6)
        order = rng.permutation(n)
        self.entry, self.top = int(order[0]) if n else -1, int(level[order[0]]) if n else -1
        self.near = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.seen, self.stamp = np.zeros(n, np.int32), 0
        for i in order[1:].tolist():
            q, at = self.x[i], self.entry
            for k in range(self.top, int(level[i]), -1):
                at = self._greedy(q, at, k)
            for k in range(min(self.top, int(level[i])), -1, -1):
                found = self._widen(q, at, k, ef)
                self._link(i, [v for _, v in found], np.array([d for d, _ in found], np.float32), k, m)
                at = found[0][1]
            if level[i] > self.top:
                self.entry, self.top = i, int(level[i])

    def _greedy(self, q: np.ndarray, at: int, k: int) -> int:
        best = float(self.x[at] @ q)
        while True:
            near = self.near[k][at]
            near = near[near >= 0]
            if not len(near):
                return at
            s = self.x[near] @ q
            j = int(s.argmax())
            if s[j] <= best:
                return at
            best, at = float(s[j]), int(near[j])

    def _widen(self, q: np.ndarray, at: int, k: int, ef: int) -> list[tuple[float, int]]:
        """Up to ``ef`` nodes near ``q``: (-similarity, node), nearest first."""
        self.stamp += 1
        seen, stamp, near_k, x = self.seen, self.stamp, self.near[k], self.x
        seen[at] = stamp
        d = -float(x[at] @ q)
        todo, kept = [(d, at)], [(-d, at)]
        while todo:
            d, c = heapq.heappop(todo)
            if d > -kept[0][0] and len(kept) >= ef:
                break
            near = near_k[c]
            near = near[near >= 0]
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            ds = -(x[near] @ q)
            if len(kept) >= ef:
                fine = ds < -kept[0][0]
                near, ds = near[fine], ds[fine]
            for v, e in zip(near.tolist(), ds.tolist(), strict=True):
                if len(kept) < ef:
                    heapq.heappush(kept, (-e, v))
                elif e < -kept[0][0]:
                    heapq.heapreplace(kept, (-e, v))
                else:
                    continue
                heapq.heappush(todo, (e, v))
        return sorted((-a, v) for a, v in kept)

    def _choose(self, ids: np.ndarray, d: np.ndarray, m: int) -> np.ndarray:
        """Nearest first, leaving out nodes nearer to a chosen one than to the centre, then filled up."""
        order = np.lexsort((ids, d))
        ids, d = ids[order], d[order]
        pair = self.x[ids] @ self.x[ids].T
        taken: list[int] = []
        for k in range(len(ids)):
            if len(taken) >= m:
                break
            if not taken or -pair[k, taken].max() > d[k]:
                taken.append(k)
        if len(taken) < m:
            rest = np.setdiff1d(np.arange(len(ids)), taken)[: m - len(taken)]
            taken = sorted(taken + rest.tolist())
        return ids[taken]

    def _link(self, i: int, ids: list[int], d: np.ndarray, k: int, m: int) -> None:
        near, room = self.near[k], self.near[k].shape[1]
        chosen = self._choose(np.array(ids), d, m)
        near[i, : len(chosen)] = chosen
        for v in chosen.tolist():
            row = near[v]
            free = int((row >= 0).sum())
            if free < room:
                row[free] = i
            else:
                all_ids = np.append(row, i)
                best = self._choose(all_ids, -(self.x[all_ids] @ self.x[v]), room)
                row[:] = -1
                row[: len(best)] = best

    def search(self, q: np.ndarray, k: int, ef: int) -> list[int]:
        if self.entry < 0:
            return []
        at = self.entry
        for layer in range(self.top, 0, -1):
            at = self._greedy(q, at, layer)
        return [v for _, v in self._widen(q, at, 0, max(ef, k))[:k]]

    def dump(self, ids: np.ndarray, first: np.ndarray, x: np.ndarray) -> bytes:
        out = io.BytesIO()
        upper = [layer for layer in self.near[1:]]
        held = [np.flatnonzero((layer >= 0).any(axis=1)).astype(np.int32) for layer in upper]
        np.savez(out, ids=ids, first=first, x=x, base=self.near[0], ends=np.array([self.entry, self.top]), **{f"n{k}": h for k, h in enumerate(held)}, **{f"l{k}": layer[h] for k, (layer, h) in enumerate(zip(upper, held, strict=True))})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
        """(graph, class ids, first ids, scaled vectors)."""
        z = np.load(io.BytesIO(raw))
        g = cls.__new__(cls)
        x = z["x"]
        g.x = unit(x).astype(np.float32)
        g.near = [z["base"]]
        k = 0
        while f"n{k}" in z:
            layer = np.full((len(x), z[f"l{k}"].shape[1]), -1, np.int32)
            layer[z[f"n{k}"]] = z[f"l{k}"]
            g.near.append(layer)
            k += 1
        g.entry, g.top = map(int, z["ends"])
        g.seen, g.stamp = np.zeros(len(x), np.int32), 0
        return g, z["ids"], z["first"], x


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component near 1: cosines stay as they are, squares in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(df: DataFrame, every: int, k: int, ef: int = 160, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest cosines found for each row whose id is divisible by ``every``."""
    rows = vectors.written(vectors.usable(df).where(F.exists("v", lambda x: x != 0)), "vectors")
    members, index, shards = vectors.classes(rows, k + 1, shard_rows)
    graphs = vectors.build(index, shards, lambda ids, first, x: Graph(unit(x)).dump(ids, first, scaled(x)))

    def search(raw: bytes, queries: dict[int, tuple]) -> pd.DataFrame:
        g, reps, first, x = Graph.load(raw)
        out = []
        if x.shape[1] in queries:
            numbers, ids, q = queries[x.shape[1]]
            lengths = np.sqrt((x * x).sum(axis=1))
            for n, i, v, u in zip(numbers.tolist(), ids.tolist(), scaled(q) if len(q) else q, unit(q).astype(np.float32) if len(q) else q, strict=True):
                at = g.search(u, k + 1, ef)
                cos = (x[at] * v).sum(axis=1) / (lengths[at] * np.sqrt((v * v).sum()))
                out += [(n, i, int(reps[j]), int(first[j]), float(c)) for j, c in zip(at, cos, strict=True)]
        return pd.DataFrame(out, columns=["query", "query_id", "rep", "first", "score"])

    found = vectors.search_shards(graphs, shards, rows, every, search, "query long, query_id long, rep long, first long, score double")
    vectors.dropped(rows)
    return vectors.merge_classes(found, members, k, ["score"])
