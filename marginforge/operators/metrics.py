"""Metrics: dual value, ranking and regression measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import numbered


def dual_value(kernel: DataFrame, coef: DataFrame) -> DataFrame:
    """(ld): sum |coef| - 1/2 coef' K coef over a long kernel of training values (i, j, k)."""
    a = coef.select(F.col("id").alias("i"), F.col("coef").alias("ci"))
    b = coef.select(F.col("id").alias("j"), F.col("coef").alias("cj"))
    quad = kernel.join(a, "i").join(b, "j").agg(F.coalesce(F.sum(F.col("ci") * F.col("cj") * F.col("k")), F.lit(0.0)).alias("quad"))
    lin = coef.agg(F.coalesce(F.sum(F.abs("coef")), F.lit(0.0)).alias("lin"))
    return lin.crossJoin(quad).select((F.col("lin") - F.col("quad") / 2).alias("ld"))


def pass_value(nodes: DataFrame) -> DataFrame:
    """(pass, ld): the largest dual value of all nodes of a pass, at least 0."""
    return nodes.groupBy("pass").agg(F.greatest(F.lit(0.0), F.max("ld")).alias("ld"))


def average_precision(scored: DataFrame, by: list[str], score: str = "prob", label: str = "label", id: str = "id") -> DataFrame:
    """(by..., ap): mean precision at the ranks of the positives, by falling score, ties by id."""
    rows = scored.select(*by, id, score, (F.col(label) > 0).cast("int").alias("hit"))
    ranked = numbered(rows, [F.col(score).desc(), F.col(id)], "rank", by=by, sums={"tp": "hit"})
    return ranked.groupBy(*by).agg((F.sum(F.when(F.col("hit") == 1, F.col("tp") / F.col("rank"))) / F.sum("hit")).alias("ap"))


def mean_average_precision(scored: DataFrame, fold: str = "fold", **how) -> DataFrame:
    return average_precision(scored, [fold], **how).agg(F.avg("ap").alias("map"))


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def regression(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """(mse, r2): mean squared error and squared correlation."""
    d = F.col(prediction) - F.col(label)
    return df.agg(F.avg(d * d).alias("mse"), F.pow(F.corr(prediction, label), 2).alias("r2"))


def laplace_scale(residuals: DataFrame, column: str = "residual") -> DataFrame:
    """(sigma): mean absolute residual without those beyond five standard deviations."""
    mae = residuals.agg(F.avg(F.abs(column)).alias("mae"))
    inside = residuals.crossJoin(F.broadcast(mae)).where(F.abs(column) <= 5 * F.sqrt(2 * F.col("mae") * F.col("mae")))
    return inside.agg(F.avg(F.abs(column)).alias("sigma"))


def missing(ids: DataFrame, features: DataFrame, key: str) -> DataFrame:
    """(missing): listed keys without features."""
    return ids.join(features.select(key), key, "left_anti").agg(F.count("*").alias("missing"))
