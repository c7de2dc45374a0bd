"""Shared helpers: table reading, column names, dealing rows out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import dropped, folder, released, written  # noqa: F401

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """One input table, narrowed to ``columns`` so that the scan is pruned."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def col(name: str) -> Column:
    """A column by its whole name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as keep it apart from every column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def mapped(df: DataFrame, work, added: Iterable[T.StructField]) -> DataFrame:
    """``mapInArrow`` whose batches keep all columns of ``df`` and append some; columns may have any names."""
    added = list(added)
    plain = [f"c{k}" for k in range(len(df.columns))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(plain, df.schema.fields, strict=True)]
    out = df.toDF(*plain).mapInArrow(work, T.StructType(fields + [T.StructField(f"n{k}", f.dataType) for k, f in enumerate(added)]))
    return out.toDF(*df.columns, *[f.name for f in added])


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows evenly over as many tasks as a shuffle has."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def crc_mod(doc_id, n: int):
    """crc32 of the id written as text (null: empty), modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
