"""N-gram Jaccard join by universe partitions.

A document is the set of its hashed n-word shingles; two link when
100 * intersection >= percent * union, which bounds their symmetric difference by
D(a, b) = (a + b)(100 - percent) / (100 + percent) for sizes a and b. Sizes fall
into bands so narrow that partners lie in the same or the next one. In a band with
largest size E the universe of shingles is hashed into m = D(E, E) + 1 segments:
two linked sets differ nowhere in at least one of them. Every set indexes the
subset it has in each segment; in some segments it also indexes the one-deletion
neighbourhood, so that there a difference of one shingle is found as well, and such
a segment counts twice towards the pigeonhole's sum D + 1. That, and sets smaller
than E, leave a probing set slack: it gives up the segments that would cost most
candidates (empty ones, then those of fewest shingles), and pays for more of these
with one-deletion probes. Deletions never match deletions.

Signatures are shuffled once and stream through sorted runs: the first member of a
run is paired with every other. Pairs are verified exactly on whole texts, links
joined to components. Where a first member links with only some of its run, the
others might link with the rest of the run. If they are few (at most FEW), they are
paired with the run; if they are many (a large group of texts all just under the
similarity), no pairs are made: packed into blocks with long sketches they meet the
run's blocks, and only pairs that the sketches cannot tell from linked ones come out
and are verified: first with the sketches that are known, and with longer ones of the
texts only where those leave too many. A run of two holds no other pair. So no link between different components is lost, and rows grow
with the runs, not with their squares.
Before texts are read, sizes and parity sketches rule pairs out: two sketches differ
in no more bits than the sets differ in shingles, so nothing that links is lost.

Equal sets are one class before anything else; a class in a task gives its
signatures once. Null and empty texts have empty sets and link with nothing; texts
of fewer than n words count as one shingle; very long texts are handled whole; rows
that share an id are one document; rows without id link with nothing (component
null); extra columns are ignored; an empty table gives no rows. Shingles are told
apart by 64-bit hashes, sets by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, dropped, released, written

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Ids broadcast at most (8 MB); beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Rows of 200 bytes broadcast at most.
BROADCAST_ROWS = 60_000
#: Members of a run apart from its head that are paired with the whole run.
FEW = 32
#: Bytes of sketches in a block.
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


class _Words(dict):
    """word -> 64-bit hash, filled as words turn up."""

    def __missing__(self, w: bytes) -> int:
        h = self[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return h


class Shingler:
    """Text -> sorted distinct 64-bit shingle hashes."""

    def __init__(self, n: int):
        self.n, self.cache = n, _Words()
        # Powers of one odd number, a polynomial of the words; the sum is mixed once.
        self.factors = [_U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(n)]

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, _U)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        h = np.fromiter(map(self.cache.__getitem__, words), _U, len(words))
        k = min(self.n, len(h))
        out = np.full(len(h) - k + 1, _U(k))
        for j in range(k):
            out += h[j : len(h) - k + 1 + j] * self.factors[j]
        out = _mix(out)
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


class Bands:
    """Size bands and their segments for one similarity."""

    def __init__(self, percent: int):
        self.percent = percent
        first = 1
        while self.bound(first + 1, first + 1) == 0:
            first += 1
        self.edges = [first]

    def bound(self, a: int, b: int) -> int:
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def band(self, n: int) -> int:
        """Number of the band that size ``n`` falls in: edges[band - 1] < n <= edges[band]."""
        while self.edges[-1] < n:
            self.edges.append(max(self.edges[-1] + 1, self.edges[-1] * 100 // self.percent))
        return int(np.searchsorted(self.edges, n))

    def segments(self, band: int) -> tuple[int, int]:
        """(segments, how many of them have one-deletion neighbourhoods)."""
        self.band(self.edges[-1] + 1) if band >= len(self.edges) else None
        m = self.bound(self.edges[band], self.edges[band]) + 1
        if m <= 4:
            return m, m
        empty = m * (1 - 1 / m) ** (self.edges[band - 1] + 1)
        return m, min(m, int(np.ceil(empty + 3 * empty**0.5)) + 1)

    def signatures(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, flags) of a set: flag 2 for deletions, 1 for rows that only index."""
        n, own, sigs, flags = len(h), self.band(len(h)), [], []
        for band in (own, own + 1):
            if band == 0 or (band > own and n * 100 < self.percent * (self.edges[own] + 1)):
                continue
            m, wide = self.segments(band)
            g = _mix(h + _U(band * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            seg = ((g >> _U(20)) % _U(m)).astype(np.int64)
            count = np.bincount(seg, minlength=m)
            order = np.argsort(seg, kind="stable")
            content = np.zeros(m, _U)
            full = np.flatnonzero(count)
            content[full] = np.add.reduceat(g[order], (np.cumsum(count) - count)[full])
            salt = (np.arange(m, dtype=_U) * _C) ^ _U(band * 0x51ED27)
            exact = np.ones(m, np.uint8)  # index only
            deep = np.zeros(m, bool)  # deletions probe too
            if band == own:
                slack = m - (self.bound(n, n) + 1)
                cheap = np.argsort(count, kind="stable")
                skip = max(slack, int((count == 0).sum()))
                more = skip - slack  # to be paid for by one-deletion probes
                if more > 0:
                    able = np.flatnonzero(count[:wide] >= 2)
                    able = able[np.argsort(count[able], kind="stable")][:more]
                    deep[able] = True
                    skip = slack + len(able)
                exact[cheap[skip:]] = 0
            sigs.append(_mix(content + salt))
            flags.append(exact)
            at = np.flatnonzero(seg < wide)
            sigs.append(_mix(content[seg[at]] - g[at] + salt[seg[at]]))
            flags.append(np.where(deep[seg[at]], 2, 3).astype(np.uint8))
        return (np.concatenate(sigs), np.concatenate(flags)) if sigs else (np.zeros(0, _U), np.zeros(0, np.uint8))


#: 64-bit words of the short parity sketch that pairs carry, and at most of the full one.
SKETCH, FULL = 16, 1024
_SK = [f"s{k}" for k in range(SKETCH)]


def sketch(h: np.ndarray, shingles: int = 32, most: int = FULL) -> np.ndarray:
    """Parities of the shingles in cells, 64 for at most ``shingles`` of them (``most`` words are the bound).

    Two sets' sketches differ in at most as many bits as the sets in shingles; a
    sketch folds to a shorter one by xor of its parts.
    """
    words = SKETCH
    while words < most and words * shingles < len(h):
        words *= 2
    odd = np.bincount((_mix(h) & _U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fold(a: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(a.reshape(-1, words), axis=0)


def sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, d1, d2, full, s0..): size, digest, full and short sketch of every document's set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            n, d, sk, full = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 2), np.int64), np.zeros((SKETCH, b.num_rows), np.int64), []
            for k, t in enumerate(b.column(1)):
                h = shingler(t.as_py())
                n[k] = len(h)
                d[k] = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
                own = sketch(h)
                sk[:, k] = fold(own, SKETCH)
                full.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(full, pa.binary()), *map(pa.array, sk)], ["doc_id", "n", "d1", "d2", "full", *_SK])
        released()

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n long, d1 long, d2 long, full binary, " + ", ".join(f"{c} long" for c in _SK))


def likely(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The (h, x) that sizes and full sketches do not rule out; known: (doc_id, n, full), nulls rule nothing out."""
    side = lambda k: known.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("full").alias(f"f{k}"))
    both = pairs.select("h", "x").join(side("x"), "x").join(side("h"), "h").select("h", "x", "nh", "nx", "fh", "fx")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for k, (nh, nx, fh, fx) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True)):
                if nh is not None and nx is not None:
                    u, v = np.frombuffer(fh.as_buffer(), np.int64), np.frombuffer(fx.as_buffer(), np.int64)
                    w = min(len(u), len(v))
                    apart = int(np.bitwise_count((fold(u, w) ^ fold(v, w)).view(np.uint64)).sum())
                    keep[k] = 100 * min(nh, nx) >= percent * max(nh, nx) and apart * (100 + percent) <= (nh + nx) * (100 - percent)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["h", "x"])

    return both.mapInArrow(work, "h long, x long")


def _signature_rows(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands, seen = Shingler(words), Bands(percent), set()

        def batch(parts: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
            sig = np.concatenate([p[0] for p in parts]).view(np.int64)
            ids = np.repeat(np.array([p[2] for p in parts], np.int64), [len(p[0]) for p in parts])
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.concatenate([p[1] for p in parts]).astype(np.int8)), pa.array(ids)], ["sig", "flag", "id"])

        for b in batches:
            parts, rows = [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None:
                    continue
                h = shingler(t.as_py())
                digest = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
                if not len(h) or digest in seen:
                    continue
                if len(seen) > 400_000:
                    seen.clear()
                seen.add(digest)
                s, f = bands.signatures(h)
                if len(s):
                    parts.append((s, f, i))
                    rows += len(s)
                if rows > 500_000:
                    yield batch(parts)
                    parts, rows = [], 0
            if parts:
                yield batch(parts)
        seen.clear()
        shingler.cache.clear()
        released()

    return docs.select("doc_id", "text").mapInArrow(work, "sig long, flag byte, id long")


def candidates(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(h, x, me, ma): the first member of every run of equal signatures with each other member.

    ``ma`` has a bit for each run of three or more that x shares with h (of 64, by
    signature), ``me`` for those where x is there undeleted: two members of h's runs
    can only be candidates if one's ``me`` meets the other's ``ma``.
    """
    rows = _signature_rows(docs, words, percent)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "sig").sortWithinPartitions("sig", "flag", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (sig, head) of the run that the batch before ended in
        for b in batches:
            if not b.num_rows:
                continue
            sig, flag, ids = (b.column(k).to_numpy() for k in range(3))
            new = np.append(True, sig[1:] != sig[:-1])
            if last is not None and last[0] == sig[0]:
                new[0] = False
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1  # -1: the carried run
            # A run's head is its first row if that is no deletion; runs of deletions alone, or without any probe, hold no pair.
            head, live = ids[starts], flag[starts] < 2
            if len(starts):
                probes = np.bincount(run[run >= 0], ((flag == 0) | (flag == 2))[run >= 0], len(starts)) > 0
                probes[-1] = True  # it may go on
                live &= probes
            pairs_h = np.where(run >= 0, head[np.maximum(run, 0)] if len(starts) else 0, last[1] if last and last[1] is not None else 0)
            ok = np.where(run >= 0, live[np.maximum(run, 0)] if len(starts) else False, bool(last and last[1] is not None))
            ok &= pairs_h != ids
            if len(starts):
                last = (sig[-1], head[-1] if live[-1] else None)
            if not ok.any():
                continue
            h, x, exact = pairs_h[ok], ids[ok], flag[ok] < 2
            # A run of the head and one other holds no pair but that one; runs that reach over a batch may hold more.
            lo, hi = np.full(len(starts) + 1, np.iinfo(np.int64).max), np.full(len(starts) + 1, np.iinfo(np.int64).min)
            np.minimum.at(lo, run[ok], ids[ok])  # a carried run is the last cell
            np.maximum.at(hi, run[ok], ids[ok])
            wide = lo < hi
            wide[-2:] = True
            mark = np.where(wide[run[ok]], np.left_shift(np.int64(1), sig[ok] & 63), 0)
            order = np.lexsort((x, h))
            h, x, mark, exact = h[order], x[order], mark[order], exact[order]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (x[1:] != x[:-1])))
            either = np.bitwise_or.reduceat(mark, first)
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(x[first]), pa.array(np.bitwise_or.reduceat(np.where(exact, mark, 0), first)), pa.array(either)], ["h", "x", "me", "ma"])

    return _marked(rows.mapInArrow(work, "h long, x long, me long, ma long"))


def _tile(h: int, left: dict, right: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right row, of different components, that sizes and sketches do not rule out.

    Rows that share a smaller one of these heads meet there, not here.
    """
    heads = {k: n for n, k in enumerate(sorted({k for hs in (*left["hs"], *right["hs"]) for k in hs if k < h}))}

    def incidence(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), len(heads)), np.float32)
        for k, hs in enumerate(rows):
            out[k, [heads[v] for v in hs if v < h]] = 1
        return out

    a, b, out = incidence(left["hs"]), incidence(right["hs"]), ([], [])
    bits = [np.frombuffer(x, np.int64) for x in right["bits"]]
    length = np.array([len(x) for x in bits])
    groups = {w: (np.flatnonzero(length == w), np.stack([bits[k] for k in np.flatnonzero(length == w)])) for w in np.unique(length).tolist()}
    folded: dict[tuple[int, int], np.ndarray] = {}
    for k, (x, c, n, raw) in enumerate(zip(left["x"], left["c"], left["n"], left["bits"], strict=True)):
        able = (right["c"] != c) & (b @ a[k] == 0) & (~right["away"] | (right["x"] > x))
        able &= 100 * np.minimum(right["n"], n) >= percent * np.maximum(right["n"], n)
        own = np.frombuffer(raw, np.int64)
        for w, (rows, _) in groups.items():
            at = np.flatnonzero(able[rows])
            for v in (min(SKETCH * 8, len(own), w), min(len(own), w)):  # a short look first
                if not len(at):
                    break
                if (w, v) not in folded:
                    folded[w, v] = np.bitwise_xor.reduce(groups[w][1].reshape(len(rows), -1, v), axis=1)
                apart = np.bitwise_count((folded[w, v][at] ^ fold(own, v)).view(np.uint64)).sum(axis=1, dtype=np.int64)
                at = at[apart * (100 + percent) <= (right["n"][rows[at]] + n) * (100 - percent)]
            out[0].append(np.full(len(at), x))
            out[1].append(right["x"][rows[at]])
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)
    return np.minimum(x, y), np.maximum(x, y)


def _looked(h: int, left: dict, right: dict, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """`_tile` of rows that carry the runs they share with the head; a pair of each row and as many as FEW at most, else (h, None)."""
    bits, length = [np.frombuffer(x, np.int64) for x in right["bits"]], np.array([len(x) for x in right["bits"]]) // 8
    groups = {w: np.flatnonzero(length == w) for w in np.unique(length).tolist()}
    stacked = {w: np.stack([bits[k] for k in rows]) for w, rows in groups.items()}
    folded: dict[tuple[int, int], np.ndarray] = {}
    out, made, most = ([], []), 0, FEW * (len(left["x"]) + len(right["x"]))
    for x, c, n, me, ma, raw in zip(left["x"], left["c"], left["n"], left["me"], left["ma"], left["bits"], strict=True):
        able = (right["c"] != c) & ((right["ma"] & me | right["me"] & ma) != 0) & (~right["away"] | (right["x"] > x))
        able &= 100 * np.minimum(right["n"], n) >= percent * np.maximum(right["n"], n)
        own = np.frombuffer(raw, np.int64)
        for w, rows in groups.items():
            at, v = np.flatnonzero(able[rows]), min(len(own), w)
            if not len(at):
                continue
            if (w, v) not in folded:
                folded[w, v] = np.bitwise_xor.reduce(stacked[w].reshape(len(rows), -1, v), axis=1)
            apart = np.bitwise_count((folded[w, v][at] ^ fold(own, v)).view(np.uint64)).sum(axis=1, dtype=np.int64)
            at = at[apart * (100 + percent) <= (right["n"][rows[at]] + n) * (100 - percent)]
            out[0].append(np.full(len(at), x))
            out[1].append(right["x"][rows[at]])
            made += len(at)
        if made > most:
            return np.array([h]), None
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in out)
    return np.minimum(x, y), np.maximum(x, y)


def _in_blocks(full: DataFrame, cells: list[str], tile, percent: int, block_bytes: int) -> DataFrame:
    """(h, x) that ``tile`` finds: every two rows of a head, one of them away, meet in one pair of blocks; x is null where it finds too many."""
    blocks = written(full.groupBy("h").agg(F.ceil(F.sum(F.length("bits") + 64) / block_bytes).alias("k")), "crowd")
    counts = F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks
    placed = full.join(counts, "h").withColumn("block", F.pmod(F.xxhash64("x"), "k"))
    # A row goes once to each pair of blocks that it is in, on the left, on the right or on both sides.
    at, others = F.col("block"), F.filter(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda o: o != F.col("block"))
    met = lambda bl, br, left, right: F.struct(bl.alias("bl"), br.alias("br"), left.alias("left"), right.alias("right"))
    meetings = F.concat(
        F.array(met(at, at, F.col("away"), F.lit(True))),
        F.transform(others, lambda o: met(o, at, F.lit(False), F.lit(True))),
        F.transform(F.filter(others, lambda o: F.col("away")), lambda o: met(at, o, F.lit(True), F.lit(False))),
    )
    row = F.struct(*cells, F.col("m.left").alias("left"), F.col("m.right").alias("right")).alias("row")
    pairs = placed.withColumn("m", F.explode(meetings)).select("h", "m.bl", "m.br", row)
    # Dealt by pair of blocks, never by head alone, so that a large run is many tasks' work.
    pairs = pairs.repartition(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), "h", "bl", "br").groupBy("h", "bl", "br").agg(F.collect_list("row").alias("rows")).select("h", "rows")
    kinds = {"x": np.int64, "c": np.int64, "n": np.int64, "away": bool, "me": np.int64, "ma": np.int64}

    def columns(rows: list) -> dict:
        got = {c: [r[c] for r in rows] for c in cells}
        return got | {c: np.array(got[c], kinds[c]) for c in cells if c in kinds}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                got = b.column(1)[k].as_py()
                left = [r for r in got if r["left"]]
                if not left:
                    continue
                h, x = tile(b.column(0)[k].as_py(), columns(left), columns([r for r in got if r["right"]]), percent)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.nulls(len(h), pa.int64()) if x is None else pa.array(x, pa.int64())], ["h", "x"])
        released()

    out = written(pairs.mapInArrow(meet, "h long, x long").distinct(), "crowd")
    dropped(blocks)
    return out


def crowded(run: DataFrame, heads: DataFrame, known: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(h, x): pairs within the runs of these heads that may link, from (h, x, ch, cx, me, ma), by blocks of sketches.

    Every two members of different components of a run meet in one pair of blocks,
    first with the sketches that are known. Where these leave too many pairs, the
    head's members meet again, with long sketches (at least 16 cells a shingle) of
    their texts; what leaves a task is what these do not tell apart.
    """
    rows = written(run.join(heads.select("h"), "h").select("h", "x", F.col("cx").alias("c"), (F.col("cx") != F.col("ch")).alias("away"), "me", "ma"), "crowd")
    seen = rows.join(known.select(F.col("doc_id").alias("x"), "n", F.col("full").alias("bits")), "x")
    seen = written(seen, "crowd")
    first = _in_blocks(seen.where("n is not null"), ["x", "c", "away", "me", "ma", "n", "bits"], _looked, percent, BLOCK_BYTES // 4)
    # Ids whose rows differ have no known sketch: their heads' members go by texts.
    again = written(first.where("x is null").select("h").union(seen.where("n is null").select("h")).distinct(), "crowd")
    out = first.where("x is not null")
    if not again.isEmpty():
        out = out.union(_by_texts(rows.join(again, "h", "left_semi"), docs, words, percent)).distinct()
    dropped(seen, again)
    return out


def _by_texts(rows: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(h, x): pairs of (h, x, c, away) that long sketches of their texts do not tell apart."""
    lists = rows.groupBy("x").agg(F.collect_set("h").alias("hs"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            got = [shingler(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in got], pa.int64()), pa.array([sketch(h, 4, 8 * FULL).tobytes() for h in got], pa.binary())], ["x", "n", "bits"])
        released()

    ids = written(rows.select("x").distinct(), "crowd")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    bits = docs.select(F.col("doc_id").alias("x"), "text").where("text is not null").join(some, "x", "left_semi").mapInArrow(work, "x long, n long, bits binary").where("n > 0")
    bits = bits.groupBy("x").agg(F.collect_set(F.struct("n", "bits")).alias("b")).select("x", F.explode("b").alias("b")).select("x", "b.n", "b.bits")
    full = written(rows.select("h", "x", "c", "away").join(lists, "x").join(bits, "x"), "crowd")
    out = _in_blocks(full, ["x", "c", "away", "n", "hs", "bits"], _tile, percent, BLOCK_BYTES)
    dropped(full, ids)
    return out


def _marked(pairs: DataFrame) -> DataFrame:
    """Marks of equal pairs taken together."""
    return pairs.groupBy("h", "x").agg(F.bit_or("me").alias("me"), F.bit_or("ma").alias("ma"))


def verify(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The (h, x) of ``pairs`` whose whole texts link."""
    need = pairs.select(F.col("h").alias("doc_id")).union(pairs.select("x")).distinct()
    need = written(need, "needed")
    need = F.broadcast(need) if need.count() <= BROADCAST_IDS else need
    texts = docs.select("doc_id", "text").where("text is not null").join(need, "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x")), "x")
    both = both.join(texts.select(F.col("doc_id").alias("h"), F.col("text").alias("text_h")), "h").select("h", "x", "text_h", "text_x")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, at, a = Shingler(words), None, None
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for k, (h, th, tx) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True)):
                th = th.as_py()
                if at != (h, len(th)):
                    at, a = (h, len(th)), shingler(th)
                x = shingler(tx.as_py())
                at_a = np.searchsorted(a, x)
                common = int((a[np.minimum(at_a, len(a) - 1)] == x).sum()) if len(a) else 0
                keep[k] = len(a) > 0 and 100 * common >= percent * (len(a) + len(x) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["h", "x"])
        shingler.cache.clear()
        released()

    return both.mapInArrow(work, "h long, x long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each end of the links (a, b), by alternating stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        old = edges
        # Large star: larger neighbours of u go to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        edges = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(edges, "edges")
        dropped(old)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).head()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _one_a_class(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id stands for a class of (doc_id, n, rep): every class's text is there under its representative's id."""
    ids = of.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("rep") == F.col("doc_id"), F.lit(False))).alias("first"))
    ids = written(ids, "firsts")
    some = docs.select("doc_id", "text").where("doc_id is not null")
    firsts, others = ids.where("first").select("doc_id"), ids.where("not first").select("doc_id")
    if others.count() <= BROADCAST_IDS:
        return some.join(F.broadcast(others), "doc_id", "left_anti")
    return some.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_IDS else firsts, "doc_id", "left_semi")


def join_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    whole = written(sets(docs, words), "sets")
    some = whole.where("n > 0 and doc_id is not null")
    # Written first, so that the join below stands on bare exchanges and a hot class of copies can be split.
    reps = written(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "reps")
    # What is known of each class by its id; nothing if rows of one id differ.
    one = F.count_distinct("d1", "d2") == 1
    known = some.groupBy("doc_id").agg(*[F.when(one, F.max(c)).alias(c) for c in ("n", "full", *_SK)])
    known = written(known, "known")
    of = written(whole.join(reps, ["d1", "d2"], "left").select("doc_id", "n", "rep"), "classes")
    dropped(whole, reps)
    sized = candidates(_one_a_class(docs, of), words, percent)
    about = lambda k: known.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), *[F.col(c).alias(f"{k}{c}") for c in _SK])

    def may_link(a: str, b: str):
        """Sizes and sketches allow a link (or are not known)."""
        na, nb = F.col(f"n{a}"), F.col(f"n{b}")
        apart = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in _SK), F.lit(0))
        return F.coalesce((100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (apart * (100 + percent) <= (na + nb) * (100 - percent)), F.lit(True))

    sized = sized.join(about("h"), "h").join(about("x"), "x")
    found = written(sized.select("h", "x", "me", "ma", may_link("h", "x").alias("ok"), "nx", *[f"x{c}" for c in _SK]), "pairs")
    one_way = found.where("ok").select(F.least("h", "x").alias("h"), F.greatest("h", "x").alias("x")).distinct()
    links = written(verify(written(likely(one_way, known, percent), "likely"), docs, words, percent).select(F.col("h").alias("a"), F.col("x").alias("b")), "links")
    comp = written(components(links), "components")
    # Members of a run whose head is in another component: with the run's others of other components, still unverified.
    label = lambda k: F.coalesce(F.col(k), F.col(k[1:]))
    named = lambda k: comp.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
    own = ["nx", *[f"x{c}" for c in _SK]]
    run = found.where("ma <> 0").join(named("h"), "h", "left").join(named("x"), "x", "left").select("h", "x", *own, "me", "ma", label("ch").alias("ch"), label("cx").alias("cx"))
    run = written(run, "runs")
    apart = written(run.groupBy("h").agg(F.count_if(F.col("ch") != F.col("cx")).alias("n")).where("n > 0"), "apart")
    rest = run.join(apart.where(F.col("n") <= FEW), "h", "left_semi").where("ch <> cx").select("h", "x", *own, "cx", "me", "ma")
    other = run.select("h", F.col("x").alias("y"), *[F.col(c).alias(c.replace("x", "y", 1)) for c in own], F.col("cx").alias("cy"), F.col("me").alias("oe"), F.col("ma").alias("oa"))
    meet = (F.col("me").bitwiseAND(F.col("oa")) != 0) | (F.col("ma").bitwiseAND(F.col("oe")) != 0)
    # Few in number they meet the runs where those lie, evenly dealt; else both are dealt out by head.
    if rest.count() <= BROADCAST_ROWS:
        rest, other = F.broadcast(rest), other.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    more = rest.join(other, "h").where((F.col("cx") != F.col("cy")) & meet & may_link("x", "y")).select(F.least("x", "y").alias("h"), F.greatest("x", "y").alias("x")).distinct()
    more = likely(more.join(one_way, ["h", "x"], "left_anti"), known, percent)
    crowds = apart.where(F.col("n") > FEW)
    if not crowds.isEmpty():
        more = more.unionByName(crowded(run, crowds, known, docs, words, percent).join(one_way, ["h", "x"], "left_anti")).distinct()
    more = written(more, "more")
    dropped(found, run, apart)
    if not more.isEmpty():
        late = verify(more, docs, words, percent).select(F.col("h").alias("a"), F.col("x").alias("b"))
        comp = written(components(links.union(late)), "components")
    comp = comp.select(F.col("id").alias("rep"), "component")
    return of.join(comp, "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each component (the smallest id), in the columns of ``docs``; rows without id stay."""
    found = written(join_documents(docs, **how), "joined")
    keep = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")), "keep")
    ids = keep.select("doc_id")
    ids = F.broadcast(ids) if keep.count() <= BROADCAST_IDS else ids
    kept = docs.where("doc_id is not null").join(ids, "doc_id", "left_semi").select(*map(col, docs.columns))
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
