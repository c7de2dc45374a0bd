"""The continuous scorer: new files of dense rows are scored as they arrive.

A file-source stream with a checkpoint replaces polling a buffer directory: each
file is scored exactly once, and `cleanSource` may remove it afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import clamp_probability, sigmoid
from ..operators import scoring


def score_batch(rows: DataFrame, sv: DataFrame, rho: float, gamma: float, prob_a: float = -1.0, prob_b: float = 0.0) -> DataFrame:
    """(id, prob) of one batch."""
    decided = scoring.dense_decisions(rows, sv, rho, gamma)
    return decided.select("id", clamp_probability(sigmoid(F.col("decision"), prob_a, prob_b)).alias("prob"))


def start(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, sv: DataFrame, rho: float, gamma: float, max_files: int = 16, clean: str = "off", available_now: bool = True, **calibration):
    """Start scoring Parquet files of ``source`` into ``out``; returns the query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("cleanSource", clean).parquet(source)

    def each(batch: DataFrame, number: int) -> None:
        # A repeated batch overwrites its own folder: exactly once.
        score_batch(batch, sv, rho, gamma, **calibration).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def score_ensemble(rows: DataFrame, vectors: DataFrame, sv: DataFrame, models: DataFrame) -> DataFrame:
    """(id, concept, prob) of one batch: every machine's calibrated probability, averaged over the layers of its concept."""
    decided = scoring.tile_decisions(rows, vectors, sv, models)
    return scoring.ensemble_mean(scoring.probabilities(decided, models), models)


def start_ensemble(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, vectors: DataFrame, sv: DataFrame, models: DataFrame, max_files: int = 16, clean: str = "off", available_now: bool = True):
    """Start scoring Parquet files of ``source`` under a whole ensemble into ``out``; returns the query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("cleanSource", clean).parquet(source)

    def each(batch: DataFrame, number: int) -> None:
        score_ensemble(batch, vectors, sv, models).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
