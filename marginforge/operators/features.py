"""Feature frames: dense vectors, sparse histograms, labels, chunk numbers, transposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def dense(df: DataFrame, id: str, vector: str, label: str | None = None) -> DataFrame:
    """(id, features array<double>[, label]) of rows with an id and a vector."""
    out = [F.col(id).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("features")]
    return df.where(F.col(id).isNotNull() & F.col(vector).isNotNull()).select(*out, *([F.col(label).alias("label")] if label else []))


def _histogram(tokens: DataFrame) -> DataFrame:
    """(id, idx, val): L1-normalised counts of (id, idx) rows; texts are cut once, totals come from the counts."""
    counts = tokens.groupBy("id", "idx").agg(F.count("*").alias("n"))
    return counts.select("id", "idx", (F.col("n") / F.sum("n").over(Window.partitionBy("id"))).alias("val"))


def token_histogram(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, idx, val): L1-normalised counts of ASCII lower-case runs; the token itself is the index."""
    return _histogram(df.select(F.col(id).alias("id"), F.explode(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))).alias("idx")))


def bigram_histogram(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, idx, val): L1-normalised counts of letter pairs inside ASCII lower-case runs."""
    runs = df.select(F.col(id).alias("id"), F.explode(F.regexp_extract_all(text, F.lit("[a-z][a-z]+"), F.lit(0))).alias("w"))
    return _histogram(runs.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda p: F.substr("w", p, F.lit(2)))).alias("idx")))


def one_vs_rest(df: DataFrame, label: str, classes: DataFrame) -> DataFrame:
    """Every row once a class, ``label`` 1 for its own and -1 for others; the few classes are broadcast."""
    return df.join(F.broadcast(classes.select(F.col(label).alias("class"))), F.lit(True)).withColumn("y", F.when(F.col(label) == F.col("class"), 1).otherwise(-1))


def with_bias(features: Column, bias: float) -> Column:
    """Append the constant feature if ``bias`` is not negative."""
    return F.array_append(features, F.lit(float(bias))) if bias >= 0 else features


def transpose(sparse: DataFrame) -> DataFrame:
    """Rows to columns: (idx, entries array<struct<id, val>>) in order of id."""
    return sparse.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("id", "val"))).alias("entries"))


def occupancy(sparse: DataFrame) -> DataFrame:
    """Entries of every feature."""
    return sparse.groupBy("idx").agg(F.count("*").alias("nnz"))


def numbered(df: DataFrame, order: str | list, out: str = "rn", by: str | list[str] | None = None, total: str | None = None, sums: dict[str, str] | None = None) -> DataFrame:
    """Running number from 1 in order of the (together unique) columns ``order``, within each value of ``by``.

    ``total`` gets the rows counted, ``sums`` maps new names to columns that are
    summed up to each row. Rows are range-partitioned and numbered inside their
    partition; what a partition starts from comes from the counts and sums of those
    before it, a few rows each, so no task holds all rows, nor all of one value. The
    partitioned rows are written once, and read for the counts and for the numbers.
    """
    order = [order] if isinstance(order, (str, Column)) else list(order)
    keys, sums = [by] if isinstance(by, str) else list(by or []), sums or {}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *keys, *order).withColumn("_p", F.spark_partition_id())
    part = written(part, "numbered")
    counts = part.groupBy("_p", *keys).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_v_{k}") for k, c in sums.items()])
    same = Window.partitionBy(*keys)
    before = same.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = counts.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k_{k}") for k in keys], upto("_n").alias("_s"), F.sum("_n").over(same).alias("_t"), *[upto(f"_v_{k}").alias(f"_u_{k}") for k in sums])
    on = F.col("_p") == F.col("_q")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy("_p", *keys).orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = part.select("*", F.row_number().over(inside).alias("_r"), *[F.sum(c).over(running).alias(f"_w_{k}") for k, c in sums.items()]).join(starts, on)
    added = [(F.col("_r") + F.col("_s")).alias(out), *[(F.col(f"_w_{k}") + F.col(f"_u_{k}")).alias(k) for k in sums]]
    return rows.select(*df.columns, *added, *([F.col("_t").alias(total)] if total else []))


def class_order(df: DataFrame, label: str, position: str) -> DataFrame:
    """(label, n, first): classes by first appearance."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.min(position).alias("first"))


def labelled(ids: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Labels of the listed ids; ids without a label are left out (never a class of their own)."""
    return ids.join(labels.where(F.col(label).isNotNull()).select("id", label), "id")


def left_lookup(ids: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """Features of the listed keys, null where missing."""
    return ids.join(features, key, "left")
