"""Tables of models, ids and predictions: the native storage, and the text forms beside it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import parse_machine_model

MODEL = "model_id string, concept string, layer int, gamma double, rho double, prob_a double, prob_b double, label0 int, label1 int"
SV = "model_id string, sv_id long, coef double"


def write_ids(ids: DataFrame, path: str, text: bool = False) -> None:
    """Ids in order, as Parquet or one a line."""
    if text:
        ids.orderBy("id").select(F.col("id").cast("string").alias("value")).write.text(path)
    else:
        ids.write.parquet(path)


def write_machines(models: DataFrame, sv: DataFrame, path: str) -> None:
    """An ensemble: the model table and its support vectors, laid out by concept."""
    models.write.partitionBy("concept").parquet(f"{path}/models")
    sv.write.parquet(f"{path}/sv")


def read_machines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(MODEL).parquet(f"{path}/models"), spark.read.schema(SV).parquet(f"{path}/sv")


def read_ensemble(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(models, sv) of a folder of model texts named CONCEPT.LAYER; performance and output files are skipped."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                base = name.rsplit("/", 1)[1]
                if base.endswith(("performance", "output")) or "." not in base:
                    continue
                m = parse_machine_model(raw.decode().splitlines())
                concept, layer = base.rsplit(".", 1)
                n = len(m["sv"])
                yield pd.DataFrame({
                    "model_id": [base] * n, "concept": concept, "layer": int(layer), "gamma": m.get("gamma"), "rho": m["rho"][0], "prob_a": m.get("probA", [None])[0], "prob_b": m.get("probB", [None])[0],
                    "label0": m["label"][0], "label1": m["label"][1], "sv_id": [int(c[0]) for _, c in m["sv"]], "coef": [k[0] for k, _ in m["sv"]],
                })

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, MODEL + ", sv_id long, coef double").persist()
    names = [c.split()[0] for c in MODEL.split(", ")]
    return rows.select(*names).distinct(), rows.select("model_id", "sv_id", "coef")


def write_by_concept(unpivoted: DataFrame, path: str) -> None:
    """One text folder a concept: "label p1 p0" lines in order of id under the header "label 1 0" (as column names)."""
    out = unpivoted.select("concept", "id", "label", F.col("p1").alias("1"), F.col("p0").alias("0"))
    out.repartition("concept").sortWithinPartitions("concept", "id").drop("id").write.partitionBy("concept").option("sep", " ").option("header", True).csv(path)


def write_predictions(wide: DataFrame, path: str) -> None:
    """"id p1 .. pk" lines in order of id."""
    wide.orderBy("id").write.option("sep", " ").csv(path)


def first_rows(df: DataFrame, order: str, n: int = 10, skip: int = 0) -> DataFrame:
    """The first ``n`` rows in order, after ``skip`` (n < 0: all of them)."""
    out = df.orderBy(order).offset(skip)
    return out if n < 0 else out.limit(n)
