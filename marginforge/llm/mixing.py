"""Mixing sources to target weights, by DataFrame functions only.

Words are counted per source (partial sums before the shuffle, so a source with
a third of all rows costs no more than another). Only the table of sources, one
row each, is ranked; targets come from a closed form of the reshared shares: with
caps c_i = cap * size_i, the sources of smallest c_i / weight_i stop at their
caps and the rest divide what remains by weight. Each document's copies are
floor(rate) plus one if a hash of seed and id falls below the fraction.

Nulls: a null text has no words; the null source is a source of its own, last;
a null id draws as empty text. Repeated ids draw alike. Sources without words
get target 0 and rate 0. Empty tables give no rows. Columns of ``df`` are never
changed: what `plan_copies` appends has the names given by ``names``, and a clash
is an error; `emit` works under names that ``df`` does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, col, fresh

ADDED = ("size", "source_size", "target", "copies", "taken")


def count_words(text):
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size) rows."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * cap).alias("c"))
    # Fill in the order of c / w: once a source is not capped, no later one is.
    order = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    per = per.select(
        "*",
        F.sum("source_size").over(everyone).alias("all"),
        F.sum("w").over(everyone).alias("all_w"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"),
    )
    # Capped: its share of what is left to it and those after it reaches the cap.
    capped = (F.col("all") - F.col("c_before")) * F.col("w") >= F.col("c") * (F.col("all_w") - F.col("w_before"))
    per = per.select("*", capped.alias("capped"))
    total = lambda x: F.coalesce(F.sum(F.when(F.col("capped"), F.col(x))).over(everyone), F.lit(0))
    left, left_w = F.col("all") - total("c"), F.col("all_w") - total("w")
    share = left.cast("double") * F.col("w").cast("double") / left_w.cast("double")
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("c").cast("double")).otherwise(share).alias("target"))


def plan_copies(df: DataFrame, seed: str = "mix-1", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, names: tuple[str, ...] = ADDED) -> DataFrame:
    """Append size, source_size, target, copies and taken (called ``names``) to every document."""
    if {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError("an appended column has the name of one that is there; give other names")
    size, source_size, target, copies, taken = names
    of, own_size, own_target = fresh(df, "_of", "_source_size", "_target")
    sized = df.select("*", count_words(F.col("text")).alias(size))
    t = source_targets(sized.select("source", col(size).alias("size")), weights, cap)
    t = t.select(F.col("source").alias(of), F.col("source_size").alias(own_size), F.col("target").alias(own_target))
    # One row a source: Spark broadcasts it below its threshold, else it deals both sides out and splits hot ones.
    joined = sized.join(t, F.col("source").eqNullSafe(F.col(of)), "left")
    rate = F.when(F.col(own_size) > 0, F.col(own_target) / F.col(own_size)).otherwise(F.lit(0.0))
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    n = (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    planned = joined.select(*map(col, df.columns), size, F.col(own_size).alias(source_size), F.col(own_target).alias(target), n.alias(copies))
    return planned.select("*", (col(copies) * col(size)).alias(taken))


def emit(df: DataFrame, **how) -> DataFrame:
    """The mix itself: every document of ``df`` as often as planned, same columns."""
    names = fresh(df, *ADDED, "_copy")
    planned = plan_copies(df, names=tuple(names[:-1]), **how)
    copies = col(names[ADDED.index("copies")])
    return planned.where(copies > 0).select(*map(col, df.columns), F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias(names[-1])).drop(names[-1])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
ranked AS (
  SELECT *, sum(s) OVER () AS t, sum(w) OVER () AS tw,
    coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
    coalesce(sum(w) OVER (ORDER BY 3 * s / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM per),
capped AS (SELECT *, (t - cb) * w >= 3 * s * (tw - wb) AS cap FROM ranked),
targets AS (
  SELECT source, s, CASE WHEN cap THEN (3 * s)::DOUBLE ELSE (t - coalesce(sum(3 * s) FILTER (cap) OVER (), 0))::DOUBLE * w::DOUBLE
    / (tw - coalesce(sum(w) FILTER (cap) OVER (), 0))::DOUBLE END AS target FROM capped),
rated AS (
  SELECT d.doc_id, d.size, x.s AS source_size, x.target, CASE WHEN x.s > 0 THEN x.target / x.s ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u
  FROM sized d JOIN targets x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
