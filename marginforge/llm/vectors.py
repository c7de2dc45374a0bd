"""What the two vector searches share: usable vectors, classes of equal vectors, shards, queries, merging.

A row is known by a number of its own, so rows that share an id are candidates of
each other like any others, and each of them is a query if the id says so. Equal
vectors form one class, of which only the rows of smallest ids can be among the
nearest; rows are cut down to those before and after the shuffle, so one vector
that a third of all rows hold is a few rows. Classes are dealt by hash into shards
of bounded size, shards one by one over tasks; a shard's index is built in one task
and written. Queries go to the shards: they are broadcast in chunks of at most
QUERY_BYTES, and each chunk's job scans the written indexes where they lie, so an
index is read once a chunk and never shuffled (but for a table with fewer shards
than cores, whose few indexes are dealt out in copies). Each shard's best are
merged by rank. Vectors of another length than the query's are no candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, released, written

#: Bytes of query vectors broadcast at once.
QUERY_BYTES = 16 << 20
#: Partitions that shards are dealt over at most; a partition then builds several, one after the other.
MOST_PARTS = 4096


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """(row, vec_id, v array<double>) of rows with an id and only finite components (at least one); written."""
    v = F.transform(column, lambda x: x.cast("double"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.where(F.col("vec_id").isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.forall("v", fine))


def classes(rows: DataFrame, keep: int, class_rows: int, band: Column | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(members, index rows, shards); the first two from a written table.

    members: (rep, row, vec_id), the ``keep`` rows of smallest ids of each class of
    equal ``v``; index rows: (rep, first, v, shard), ``first`` the class's smallest
    id, with about ``class_rows`` a shard and shards of one ``band`` only.
    """
    ranked = Window.partitionBy("v").orderBy("vec_id", "row")
    best = rows.withColumn("k", F.row_number().over(ranked)).where(F.col("k") <= keep)
    best = best.select("row", "vec_id", "v", F.first("row").over(ranked).alias("rep"), (band if band is not None else F.lit(0)).cast("int").alias("band"))
    best = written(best, "classes")
    index = best.where("row = rep")
    shard, at = F.lit(0), 0
    for r in index.groupBy("band").count().orderBy("band").collect():  # bands: a few, by magnitude
        n = -(-r["count"] // class_rows)
        shard = F.when(F.col("band") == r.band, F.pmod(F.xxhash64("rep"), F.lit(n)) + at).otherwise(shard)
        at += n
    return best.select("rep", "row", "vec_id"), index.select("rep", F.col("vec_id").alias("first"), "v", shard.cast("int").alias("shard")), max(at, 1)


def _dealt(index: DataFrame, shards: int) -> DataFrame:
    """Rows with a ``key`` for each shard, partitioned by it so that every partition gets equally many shards."""
    spark, parts = index.sparkSession, min(shards, MOST_PARTS)
    # Numbers are sorted by the partition that a hash of them falls in; a shard takes one of its partition's.
    keys = spark.range(0, 8 * shards + 64 * parts).select(F.col("id").alias("key"), F.pmod(F.hash("id"), F.lit(parts)).alias("p"))
    nth = F.row_number().over(Window.partitionBy("p").orderBy("key")) - 1
    keys = keys.select("key", (nth * parts + F.col("p")).alias("shard")).where(F.col("shard") < shards)
    rows = index.join(keys, "shard", "left").withColumn("key", F.coalesce("key", F.col("shard").cast("long")))
    return rows.repartition(parts, "key")


def build(index: DataFrame, shards: int, make: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """(shard, index binary) of ``make(rep, first, matrix)`` for every shard and vector length in it; written."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, pdf = int(pdf["shard"].iloc[0]), pdf.sort_values("rep", kind="stable")
        length = pdf["v"].map(len)
        out = []
        for n in sorted(length.unique()):
            own = pdf[length == n]
            out.append((shard, make(own["rep"].to_numpy(np.int64), own["first"].to_numpy(np.int64), np.stack(own["v"].to_numpy()))))
        released()
        return pd.DataFrame(out, columns=["shard", "index"])

    return written(_dealt(index, shards).groupBy("key").applyInPandas(work, "shard int, index binary"), "index")


def search_shards(index: DataFrame, shards: int, rows: DataFrame, every: int, search: Callable, result: str) -> DataFrame:
    """Found rows of every query (id divisible by ``every``) in every shard.

    ``search(index, width -> (rows, ids, matrix)) -> pd.DataFrame`` with the columns of ``result``.
    """
    spark = index.sparkSession
    queries = written(rows.where(F.col("vec_id") % every == 0), "queries")
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("v").cast("long") * 8 + 16).alias("b")).head()
    chunks = max(1, -(-(size.b or 0) // QUERY_BYTES))
    copies = max(1, spark.sparkContext.defaultParallelism // shards)
    at = index.select("index", F.lit(0).alias("copy"))
    if copies > 1:
        at = index.select("index", "shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy")).repartition(shards * copies, "shard", "copy").select("index", "copy")
    out = None
    for c in range(chunks):
        held = queries.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(chunks)) == c).orderBy("row").toPandas()
        width = held["v"].map(len)
        parts = {int(d): (own["row"].to_numpy(np.int64), own["vec_id"].to_numpy(np.int64), np.stack(own["v"].to_numpy())) for d, own in held.groupby(width)}
        shared = spark.sparkContext.broadcast(parts)

        def work(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    yield search(r.index, {d: tuple(a[r.copy :: copies] for a in part) for d, part in shared.value.items()})
            released()

        found = at.mapInPandas(work, result)
        if chunks > 1:
            found = written(found, "found")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    dropped(queries)
    return out


def merge_classes(found: DataFrame, members: DataFrame, k: int, order: list[str]) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` candidates of each query, from classes (query, query_id, rep, first, score, ...).

    ``order``: columns that fall from better to worse. ``k`` + 1 classes suffice:
    each but the query's own has a candidate, and the class with the smaller first
    id goes first among equals.
    """
    falling = [F.col(c).desc() for c in order]
    top = Window.partitionBy("query").orderBy(*falling, "first", "rep")
    best = found.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    each = best.join(members, "rep").where("row <> query")
    each = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*falling, "vec_id", "row"))).where(F.col("rank") <= k)
    return each.select("query_id", "rank", "vec_id", "score")
