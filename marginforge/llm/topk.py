"""Exact top-k inner products by a pivot-distance index.

Vectors x of a shard get one more component sqrt(M^2 - |x|^2), M their largest
length, and queries a 0, so that distance^2 = |q|^2 + M^2 - 2 q.x falls as the
inner product grows. Every vector is keyed by its nearest pivot and its distance
from it and stored in that order. A query first scans the annulus around its own
distance in the partitions of its nearest pivots, which bounds the k-th distance;
then annuli are expanded in every partition up to that bound: by the triangle
inequality nothing outside can be nearer. Rings are opened from the nearest
partition on, the bound falling as better vectors are found.

Pivots come from a bounded sample of the shard (``pivots`` of at most ``sample``
rows, farthest first). Where products could leave the range that floats add up
exactly, bounds and cuts carry the rounding error, and what is left is scored in
integers of any size; vectors of such components lie in shards by magnitude, so
their error stays their own. A score beyond a long is ranked as it is and returned
as the nearest long.

Null vectors and those with null or non-finite components (times ``scale``, too)
take no part, nor do rows without id or of another length than the query. Rows that
share an id are rows of their own: each is a query, and a candidate of the other.
Equal vectors form one class; ties go to the smaller id; other columns are ignored;
empty tables give no rows.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

#: Components below it need no care: products of shorter vectors add up exactly.
LIMIT = 1 << 24
_EPS = float(np.finfo(np.float64).eps)
SHARD_ROWS = 8192


class PivotIndex:
    def __init__(self, x: np.ndarray, pivots: int = 48, sample: int = 2048):
        """Index over integer rows ``x`` (float64, as they are)."""
        self.shift = -max(0, int(np.frexp(np.abs(x).max(initial=0))[1]) - 24)
        whole, x = x, np.ldexp(x, self.shift)  # powers of two: nothing is rounded but what falls out of range
        norm2 = (x * x).sum(axis=1)
        self.top = float(norm2.max())
        y = np.column_stack([x, np.sqrt(np.maximum(self.top - norm2, 0))])
        rng = np.random.default_rng(0)
        pool = y[np.sort(rng.choice(len(y), min(sample, len(y)), replace=False))]
        chosen = [pool[0]]
        gap = ((pool - chosen[0]) ** 2).sum(axis=1)
        while len(chosen) < min(pivots, len(pool)) and gap.max() > 0:
            chosen.append(pool[int(gap.argmax())])
            gap = np.minimum(gap, ((pool - chosen[-1]) ** 2).sum(axis=1))
        self.pivots = np.array(chosen)
        d2 = (y * y).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * y @ self.pivots.T
        near = d2.argmin(axis=1)
        dist = np.sqrt(((y - self.pivots[near]) ** 2).sum(axis=1))
        self.order = np.lexsort((dist, near))
        self.dist = dist[self.order]
        self.start = np.searchsorted(near[self.order], np.arange(len(self.pivots) + 1))
        self.x, self.whole = x[self.order], whole[self.order]
        self.most = float(np.abs(x).max(initial=0))

    def search(self, q: np.ndarray, k: int) -> np.ndarray:
        """Positions (in the order of ``whole``) of all of the k best, ties of the last and what rounding cannot tell from them."""
        q = np.ldexp(q, self.shift)
        most = float(np.abs(q).max(initial=0))
        if most and not 2.0**-200 < most < 2.0**200:  # a query may be scaled by itself: its order of scores stays
            q = np.ldexp(q, -int(np.frexp(most)[1]))
        q2, d = float(q @ q), len(q)
        sure = self.shift == 0 and self.most * most * d < 2**52 and 1 <= most < 2.0**200 or not most
        err = 0.0 if sure else 4 * d * _EPS * (self.top * q2) ** 0.5
        dq = np.sqrt(((np.append(q, 0.0) - self.pivots) ** 2).sum(axis=1))
        slack, rounding = 1e-9 * (q2 + self.top + 1.0) ** 0.5 + 1e-9, 8 * d * _EPS * (q2 + self.top)
        lo, hi = self.start[:-1], self.start[1:]
        done_lo = np.zeros(len(lo), np.int64)  # scanned so far in each partition
        done_hi = np.zeros(len(lo), np.int64)
        at = np.array([lo[p] + np.searchsorted(self.dist[lo[p] : hi[p]], dq[p]) for p in range(len(lo))])
        done_lo[:], done_hi[:] = at, at
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        bound = np.inf

        def scan(spans: list[tuple[int, int]]) -> None:
            nonlocal ids, scores, bound
            new = np.concatenate([np.arange(a, b) for a, b in spans if b > a] or [np.zeros(0, np.int64)])
            if not len(new):
                return
            ids, scores = np.append(ids, new), np.append(scores, self.x[new] @ q)
            if len(ids) >= k:
                last = np.partition(scores, len(scores) - k)[len(scores) - k]
                fine = scores >= last - 2 * err
                ids, scores = ids[fine], scores[fine]
                bound = np.sqrt(max(q2 + self.top - 2 * (last - err) + rounding, 0.0)) + slack

        # The ring next to the query in its nearest partitions gives a first bound.
        for p in np.argsort(dq)[:4].tolist():
            a, b = max(lo[p], at[p] - 2 * k), min(hi[p], at[p] + 2 * k)
            scan([(a, b)])
            done_lo[p], done_hi[p] = a, b
        # Then annuli of every partition, nearest first, in two steps so that the bound can fall in between.
        for part in np.array_split(np.argsort(dq, kind="stable"), 2):
            spans = []
            for p in part.tolist():
                if np.isinf(bound):
                    a, b = lo[p], hi[p]
                else:
                    own = self.dist[lo[p] : hi[p]]
                    a, b = lo[p] + np.searchsorted(own, dq[p] - bound, "left"), lo[p] + np.searchsorted(own, dq[p] + bound, "right")
                spans += [(a, min(b, done_lo[p])), (max(a, done_hi[p]), b)]
            scan(spans)
        return ids

    def dump(self, ids: np.ndarray, first: np.ndarray) -> bytes:
        """Bytes of the index with the classes' ids, both in its own order."""
        out = io.BytesIO()
        whole = self.whole.astype(np.int32) if self.shift == 0 else self.whole
        np.savez(out, ids=ids[self.order], first=first[self.order], shift=self.shift, top=self.top, pivots=self.pivots, dist=self.dist, start=self.start, whole=whole)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[PivotIndex, np.ndarray, np.ndarray]:
        z = np.load(io.BytesIO(raw))
        own = cls.__new__(cls)
        own.shift, own.top, own.pivots, own.dist, own.start, own.whole = int(z["shift"]), float(z["top"]), z["pivots"], z["dist"], z["start"], z["whole"].astype(np.float64)
        own.x = np.ldexp(own.whole, own.shift)
        own.most = float(np.abs(own.x).max(initial=0))
        return own, z["ids"], z["first"]


def exact(x: np.ndarray, q: np.ndarray) -> list[int]:
    """Integer inner products, whatever their size."""
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2**52:
        return (x @ q).astype(np.int64).tolist()
    whole = [int(v) for v in q]
    return [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x]


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def as_long(score: int) -> tuple[int, bytes]:
    """(nearest long, a key that orders scores of the same long)."""
    if _LEAST < score < _MOST:
        return score, b""
    return min(max(score, _LEAST), _MOST), (score + (1 << 2200)).to_bytes(280, "big")


def largest(df: DataFrame, every: int, k: int, scale: int = 64, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of floor(scale * x) for rows whose id is divisible by ``every``."""
    rows = vectors.usable(df).where(F.forall("v", lambda x: F.abs(x * scale) < float("inf")))
    # Spark's floor ends at the longs; beyond 2**53 every double is whole.
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale) + F.lit(0.0)
    rows = vectors.written(rows.select("row", "vec_id", F.transform("v", whole).alias("v")), "vectors")
    most = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))
    members, index, shards = vectors.classes(rows, k + 1, shard_rows, F.when(most < LIMIT, 0).otherwise(F.floor(F.log2(most) / 8)))

    indexes = vectors.build(index, shards, lambda ids, first, x: PivotIndex(x).dump(ids, first))

    def search(raw: bytes, queries: dict[int, tuple]) -> pd.DataFrame:
        own, reps, first = PivotIndex.load(raw)
        out = []
        if own.x.shape[1] in queries:
            for n, i, v in zip(*queries[own.x.shape[1]], strict=True):
                at = own.search(v, k + 1)
                found = sorted(zip(exact(own.whole[at], v), first[at].tolist(), reps[at].tolist(), strict=True), key=lambda r: (-r[0], r[1], r[2]))
                out += [(int(n), int(i), r, f, *as_long(s)) for s, f, r in found[: k + 1]]
        return pd.DataFrame(out, columns=["query", "query_id", "rep", "first", "score", "more"])

    found = vectors.search_shards(indexes, shards, rows, every, search, "query long, query_id long, rep long, first long, score long, more binary")
    vectors.dropped(rows)
    return vectors.merge_classes(found, members, k, ["score", "more"])


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
n AS (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20
"""
