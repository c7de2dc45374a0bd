"""Splits, folds, chunks and id-set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import numbered

#: Multiplier and modulus of the portable id hash, which other engines can repeat.
MULTIPLIER, MODULUS = 2654435761, 4294967296


def portable_hash(id: Column, seed: int = 0) -> Column:
    return F.pmod((id + seed) * MULTIPLIER, F.lit(MODULUS))


def random_subsets(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Independent uniform subset of every id (sizes vary, may be empty)."""
    return ids.withColumn("subset", (portable_hash(F.col("id"), seed) % n).cast("int"))


def equal_subsets(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Equal slices of a shuffled order, the remainder in the last."""
    rows = numbered(ids.withColumn("_h", portable_hash(F.col("id"), seed)), ["_h", "id"], "_n", total="_all")
    slice_rows = F.greatest(F.floor(F.col("_all") / n), F.lit(1))
    return rows.withColumn("subset", F.least(F.floor((F.col("_n") - 1) / slice_rows), F.lit(n - 1)).cast("int")).drop("_h", "_n", "_all")


def unbalanced_subsets(df: DataFrame, n: int, label: str, share: float = 0.9, seed: int = 0) -> DataFrame:
    """First half of the subsets mostly positive, the second mostly negative."""
    rows = numbered(df.withColumn("_h", portable_hash(F.col("id"), seed)), ["_h", "id"], "_n", by=label, total="_all")
    u = (F.col("_n") - 1) / F.col("_all")
    half = n // 2
    first = F.floor(u / share * half)
    second = F.lit(half) + F.floor((u - share) / (1 - share) * (n - half))
    pos = F.when(u < share, F.least(first, F.lit(half - 1))).otherwise(F.least(second, F.lit(n - 1)))
    neg = F.when(u < share, F.lit(half) + F.least(F.floor(u / share * (n - half)), F.lit(n - half - 1))).otherwise(F.least(F.floor((u - share) / (1 - share) * half), F.lit(half - 1)))
    return rows.withColumn("subset", F.when(F.col(label) > 0, pos).otherwise(neg).cast("int")).drop("_h", "_n", "_all")


def chunks(df: DataFrame, order: str, rows: int) -> DataFrame:
    """chunk_id = floor((n - 1) / rows) by running number."""
    return numbered(df, order).withColumn("chunk_id", F.floor((F.col("rn") - 1) / rows).cast("int"))


def folds(df: DataFrame, k: int, stratify: str | None = None, seed: int = 0) -> DataFrame:
    """fold 0..k-1 by integer division over a shuffled order, within each class if stratified."""
    rows = numbered(df.withColumn("_h", portable_hash(F.col("id"), seed)), ["_h", "id"], "_n", by=stratify, total="_all")
    return rows.withColumn("fold", F.floor((F.col("_n") - 1) * k / F.col("_all")).cast("int")).drop("_h", "_n", "_all")


def gaps(parts: DataFrame, key: str) -> DataFrame:
    """Numbers missing from 0..max: a manifest must have none."""
    top = parts.agg(F.max(key)).head()[0]
    return parts.sparkSession.range(0, (top if top is not None else -1) + 1).withColumnRenamed("id", key).join(parts.select(key), key, "left_anti")


def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def except_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").subtract(b.select("id"))


def feed_back(leaves: DataFrame, sv: DataFrame, n: int) -> DataFrame:
    """Every leaf (node, id) joined by the last support vectors."""
    nodes = sv.sparkSession.range(0, n).select(F.col("id").cast("int").alias("node"))
    return leaves.select("node", "id").union(sv.select("id").join(F.broadcast(nodes), F.lit(True)).select("node", "id")).distinct()


def merge_pairs(members: DataFrame) -> DataFrame:
    """Up the tree: nodes 2k and 2k + 1 become k."""
    return members.select(F.floor(F.col("node") / 2).cast("int").alias("node"), "id").distinct()
