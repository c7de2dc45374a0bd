"""All kernel evaluation is a join: A rows x B rows under a kernel.

Sparse rows (id, idx, val) join on the feature index; nothing but pairs that share
an index is shuffled before the grid fills in the rest. Dense rows are packed into
blocks, and each block of A meets each block of B once as a numpy tile, in a
Cartesian product of the two sides' partitions: each side is shuffled once, blocks
meet in memory, and no pair of blocks or rows is written on the way to the result.
No dense side is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels


def summed(value: Column, digits: int | None = None) -> Column:
    """Sum of a column; with ``digits``, of its values in whole units of 10^-digits, so that the order of rows cannot show."""
    if digits is None:
        return F.sum(value)
    return F.sum(F.floor(value * 10.0**digits + 0.5)).cast("double") / 10.0**digits


def row_sums(sparse: DataFrame, ids: DataFrame, digits: int | None = None) -> DataFrame:
    """(id, s, q, n) of every id: sum, sum of squares and count of its entries; empty rows count 0."""
    sums = sparse.groupBy("id").agg(summed(F.col("val"), digits).alias("s"), summed(F.col("val") * F.col("val"), digits).alias("q"), F.count("*").alias("n"))
    return ids.select("id").join(sums, "id", "left").na.fill(0)


def sparse_kernel(a: DataFrame, a_ids: DataFrame, b: DataFrame, b_ids: DataFrame, kind: str | list[str], digits: int | None = None) -> DataFrame:
    """(i, j, k) of every pair, or one column a kernel if several are asked for."""
    kinds = [kind] if isinstance(kind, str) else kind
    shared = a.select(F.col("id").alias("i"), "idx", F.col("val").alias("va")).join(b.select(F.col("id").alias("j"), "idx", F.col("val").alias("vb")), "idx")
    terms = [summed(kernels.SPARSE[k][0](F.col("va"), F.col("vb")), digits).alias(f"t_{k}") for k in kinds]
    sums = shared.groupBy("i", "j").agg(*terms)
    left = row_sums(a, a_ids, digits).select(F.col("id").alias("i"), F.col("s").alias("sa"), F.col("q").alias("qa"), F.col("n").alias("na"))
    right = row_sums(b, b_ids, digits).select(F.col("id").alias("j"), F.col("s").alias("sb"), F.col("q").alias("qb"), F.col("n").alias("nb"))
    grid = left.crossJoin(right).join(sums, ["i", "j"], "left")
    value = lambda k: kernels.SPARSE[k][1](F.coalesce(F.col(f"t_{k}"), F.lit(0.0)))
    return grid.select("i", "j", *[value(k).alias("k" if isinstance(kind, str) else k) for k in kinds])


def fused_sparse(modalities: list[tuple[DataFrame, DataFrame]], a_ids: DataFrame, b_ids: DataFrame, kind: str, weights: list[float] | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, k): early fusion of sparse modalities in one pass.

    The modality is part of the join key; every pair of rows is summed up once, with a
    sum a modality, and the grid is filled once.
    """
    n = len(modalities)
    weights = weights or [1.0 / n] * n
    tagged = lambda at: reduce(DataFrame.unionByName, [m[at].select("id", F.lit(k).alias("m"), "idx", "val") for k, m in enumerate(modalities)])
    a, b = tagged(0), tagged(1)
    own = lambda k, c: F.when(F.col("m") == k, c)
    shared = a.select(F.col("id").alias("i"), "m", "idx", F.col("val").alias("va")).join(b.select(F.col("id").alias("j"), "m", "idx", F.col("val").alias("vb")), ["m", "idx"])
    term = kernels.SPARSE[kind][0](F.col("va"), F.col("vb"))
    sums = shared.groupBy("i", "j").agg(*[summed(own(k, term), digits).alias(f"t{k}") for k in range(n)])

    def side(rows: DataFrame, ids: DataFrame, key: str, tag: str) -> DataFrame:
        v = F.col("val")
        parts = [(f"s{tag}{k}", summed(own(k, v), digits)) for k in range(n)] + [(f"q{tag}{k}", summed(own(k, v * v), digits)) for k in range(n)] + [(f"n{tag}{k}", F.count(own(k, v))) for k in range(n)]
        return ids.select("id").join(rows.groupBy("id").agg(*[c.alias(name) for name, c in parts]), "id", "left").na.fill(0).withColumnRenamed("id", key)

    grid = side(a, a_ids, "i", "a").crossJoin(side(b, b_ids, "j", "b")).join(sums, ["i", "j"], "left")
    total = None
    for k, w in enumerate(weights):
        names = {f"{c}{t}": F.col(f"{c}{t}{k}") for c in "sqn" for t in "ab"}
        grid = grid.withColumns(names).withColumn(f"k{k}", kernels.SPARSE[kind][1](F.coalesce(F.col(f"t{k}"), F.lit(0.0))))
        total = F.col(f"k{k}") * w if total is None else total + F.col(f"k{k}") * w
    return grid.select("i", "j", total.alias("k"))


#: Blocks in a partition of one side of a product, about.
PART_BLOCKS = 64
#: Rows of a block of either side that only sums come out of, and bytes of pairs of such blocks that a task gets, about: they
#: cross to its worker in Arrow buffers, which the JVM holds outside its heap, grows by doubling, and has one set of a task.
SUM_ROWS, PAIR_BYTES = (1024, 2048), 16 << 20
#: Bytes of whole kernel rows that a task gathers before they go out.
ROW_BYTES = 64 << 20


def blocks(dense: DataFrame, rows: int = 512, n: int | None = None, parts: int | None = None) -> DataFrame:
    """(block, ids, x): rows of (id, features) packed by hash into blocks of about ``rows``, in ``n`` blocks if that is known, in just ``parts`` partitions if given."""
    n = n or max(1, -(-dense.count() // rows))
    named = dense.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
    packed = (named.repartition(parts, "block") if parts else named).groupBy("block")
    return packed.agg(F.sort_array(F.collect_list(F.struct("id", "features"))).alias("r")).select("block", F.col("r.id").alias("ids"), F.col("r.features").alias("x"))


def _met(a: DataFrame, b: DataFrame, rows_a: int, rows_b: int, parts_b: int | None = None, once: bool = False) -> DataFrame:
    """(block, ids, x, block_b, ids_b, x_b): every block of a with every block of b; a partition of either side meets each of the other's.

    With ``once``, for a side that meets itself, each two blocks meet in one order only.
    """
    of = lambda d, rows: max(1, -(-d.count() // rows))
    na, nb = of(a, rows_a), of(b, rows_b)
    least = int(np.ceil(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    parts = lambda n: max(least, -(-n // PART_BLOCKS))
    left = blocks(a, n=na).coalesce(parts(na))
    right = blocks(b, n=nb).select(F.col("block").alias("block_b"), F.col("ids").alias("ids_b"), F.col("x").alias("x_b")).coalesce(parts_b or parts(nb))
    met = left.crossJoin(right.hint("shuffle_replicate_nl"))
    return met.where("block <= block_b") if once else met


def tiles(a: DataFrame, b: DataFrame, work: Callable[..., pd.DataFrame], schema: str, rows: int = 512, stacked: bool = True, once: bool = False) -> DataFrame:
    """Apply ``work(ids_a, A, ids_b, B)`` to every pair of blocks; B is a matrix, or the list of b's rows if not ``stacked``.

    With ``once``, for a side that meets itself, each two blocks meet in one order only, and ``work`` gets whether that stands for both.
    """
    pairs = _met(a, b, rows, rows, once=once)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                both = (r.block != r.block_b,) if once else ()
                yield work(np.asarray(r.ids), np.stack(r.x), np.asarray(r.ids_b), np.stack(r.x_b) if stacked else list(r.x_b), *both)

    return pairs.select("block", "block_b", "ids", "x", "ids_b", "x_b").mapInPandas(run, schema)


def tile_sums(a: DataFrame, b: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(id, s): sums over b's blocks of ``work(A, B)``, a row for each of A's; a task adds up all that its blocks meet before rows go out.

    About one block of a meets so many of b in a task as PAIR_BYTES hold.
    """
    (n, w), (m, v) = (d.agg(F.count("*"), F.coalesce(F.max(F.size("features")), F.lit(0))).head() for d in (a, b))
    least = int(np.ceil(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    rows = min(SUM_ROWS[0], max(1, -(-n // least)))
    na, nb = max(1, -(-n // rows)), max(1, -(-m // SUM_ROWS[1]))
    few = max(1, PAIR_BYTES // (8 * (rows * w + min(m, SUM_ROWS[1]) * v + 1)))
    right = blocks(b, n=nb, parts=-(-nb // few)).select(F.col("ids").alias("ids_b"), F.col("x").alias("x_b"))
    pairs = blocks(a, n=na, parts=na).crossJoin(right.hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                v = work(np.stack(r.x), np.stack(r.x_b))
                if r.block in sums:
                    sums[r.block][1] += v
                else:
                    sums[r.block] = [np.asarray(r.ids), v]
        for ids, v in sums.values():
            yield pd.DataFrame({"id": ids, "s": list(v)})

    return pairs.select("block", "ids", "x", "x_b").mapInPandas(run, "id long, s array<double>")


#: Pairs that go out in one order before they go out in the other, so near each other that a writer finds the values again.
STRIP = 32


def dense_kernel(a: DataFrame, b: DataFrame, kind: str, transform=None, squares: bool = False) -> DataFrame:
    """(i, j, k) of every pair of dense rows (id, features array<double>); with ``squares`` also qa, qb, the rows' squared lengths.

    Rows that meet themselves under a symmetric kernel are computed once a pair: (i, j) and (j, i) go out strip by
    strip, with the same values twice in a row, which a compressed result holds about once.
    """
    f, once = kernels.DENSE[kind], a is b and kind in kernels.SYMMETRIC

    def tile(ia: np.ndarray, x: np.ndarray, ib: np.ndarray, y: np.ndarray, both: bool = False) -> pd.DataFrame:
        k = f(x, y) + 0.0
        k = (transform(k) if transform else k).ravel()
        n, m = len(ia), len(ib)
        sides = {"i": np.repeat(ia, m), "j": np.tile(ib, n)}
        if squares:
            sides |= {"qa": np.repeat((x * x).sum(1), m), "qb": np.tile((y * y).sum(1), n)}
        if not both:
            return pd.DataFrame({"k": k} | sides)
        start = np.arange(m) // STRIP * STRIP
        first = (2 * (m * np.arange(n)[:, None] + start) + np.arange(m) - start).ravel()
        second = first + np.tile(np.minimum(STRIP, m - start), n)
        other = {"k": "k", "i": "j", "j": "i", "qa": "qb", "qb": "qa"}
        out = {c: np.empty(2 * n * m, v.dtype) for c, v in [("k", k), *sides.items()]}
        for c, v in [("k", k), *sides.items()]:
            out[c][first], out[other[c]][second] = v, v
        return pd.DataFrame(out)

    return tiles(a, b, tile, "i long, j long, k double" + (", qa double, qb double" if squares else ""), once=once)


def projected(dense: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """K[ids, ids] of dense rows: rows are left out before they meet, not pairs afterwards."""
    own = dense.join(ids.select("id").distinct(), "id", "left_semi")
    return dense_kernel(own, own, kind)


def kernel_rows(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """(i, js, ks): the whole kernel row of each id of a, with the columns in order of b's ids.

    A task takes blocks of few rows of a past all blocks of b and holds ROW_BYTES of
    kernel, so that no piece of a row is shuffled.
    """
    f, n = kernels.DENSE[kind], b.count()
    pairs = _met(a, b, min(512, max(1, ROW_BYTES // (8 * max(n, 1)))), 512, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun: dict[int, list] = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, own = np.asarray(r.ids), begun.setdefault(r.block, [])
                own.append((np.asarray(r.ids_b), f(np.stack(r.x), np.stack(r.x_b)) + 0.0))
                if sum(len(j) for j, _ in own) < n:
                    continue
                del begun[r.block]
                js = np.concatenate([j for j, _ in own])
                order = np.argsort(js, kind="stable")
                js, starts = js[order], np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
                alike, some = bool((js[1:] == js[:-1]).any()), max(1, (8 << 20) // (8 * n))
                for at in range(0, len(starts) - 1, some):
                    lo = starts[at : at + some + 1]
                    k = np.concatenate([v[lo[0] : lo[-1]] for _, v in own], axis=1)[:, order]
                    each = [(js, v) for v in k]
                    if alike or len(k) > len(lo) - 1:  # rows that share an id are one row; columns that share one go by value
                        both = [(np.tile(js, e - s), k[s - lo[0] : e - lo[0]].ravel()) for s, e in zip(lo[:-1], lo[1:])]
                        each = [(j[o], v[o]) for j, v in both for o in [np.lexsort((v, j))]]
                    yield pd.DataFrame({"i": ids[lo[:-1]], "js": [j for j, _ in each], "ks": [v for _, v in each]})

    return pairs.select("block", "ids", "x", "ids_b", "x_b").mapInPandas(run, "i long, js array<long>, ks array<double>")


def fused(kernels_of: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Early fusion: the (weighted) mean of the modalities' kernels on the same pairs."""
    weights = weights or [1.0 / len(kernels_of)] * len(kernels_of)
    parts = [k.select("i", "j", (F.col("k") * w).alias("k")) for k, w in zip(kernels_of, weights, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("i", "j").agg(F.sum("k").alias("k"))


def project(kernel: DataFrame, ids: DataFrame) -> DataFrame:
    """K[ids, ids] of a long kernel."""
    rows = ids.select(F.col("id").alias("i")).distinct()
    return kernel.join(rows, "i", "left_semi").join(rows.withColumnRenamed("i", "j"), "j", "left_semi").select("i", "j", "k")


def rows_of(kernel: DataFrame) -> DataFrame:
    """Column-bind: (i, js, ks) with the columns in order."""
    packed = kernel.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "k"))).alias("r"))
    return packed.select("i", F.col("r.j").alias("js"), F.col("r.k").alias("ks"))
