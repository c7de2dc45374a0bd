"""Quality classifier: hashed word n-gram logistic regression by FTRL.

Weights are trained by the follow-the-regularised-leader update (per-coordinate
rates, L1 and L2) on a bounded sample of labelled documents, streamed through one
task; scoring is a sparse dot product of a whole text's features with the
broadcast weights (2**bits floats: the size bound).

The sample: the ``sample`` labelled training documents of smallest id hash, one row
an id (of rows that share an id, the smallest text). Their features are taken where
the texts lie; what one task receives is at most ``sample`` rows of 2**bits cells.
Null, empty and very long texts are scored whole like others (no features: the
bias); repeated rows score alike; ids labelled twice count as the larger label;
without any labelled row all weights are 0 and every score is 0.5. Other columns
pass through unchanged; the two that are appended may be named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, fresh, mapped, released
from .features import Hasher


class Ftrl:
    """Logistic regression under the FTRL-proximal update, one sparse row at a time."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx=slice(None)) -> np.ndarray:
        z, n = self.z[idx], self.n[idx]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, idx: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(idx)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[idx]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[idx] += g - sigma * w
        self.n[idx] = n + g * g


def one_text(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, text, ...) of the ``picked`` ids (bounded in number, distinct), one row each."""
    extra = [c for c in picked.columns if c != "doc_id"]
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", *extra).agg(F.min("text").alias("text"))


def hashed(rows: DataFrame, hasher: dict) -> DataFrame:
    """The features of ``text`` as idx and x in its place."""
    keep = [c for c in rows.columns if c != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(**hasher)
        for b in batches:
            got = [h(t.as_py()) for t in b.column(b.schema.get_field_index("text"))]
            idx, x = pa.array([i.astype(np.int32) for i, _ in got], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in got], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], idx, x], [*keep, "idx", "x"])

    return rows.mapInArrow(work, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep) + ", idx array<int>, x array<float>")


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int) -> DataFrame:
    """(doc_id, y, h, text) of the labelled, allowed documents of smallest id hash; ``sample`` bounds its rows."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    picked = known.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(sample)
    return one_text(docs, picked)


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, sample: int = 8192, bits: int = 18, updates: int = 20_000) -> np.ndarray:
    """Weights, the last one the bias. ``allowed`` says of a labels row whether it may be learned from.

    The sample is gone through 3 to 20 times, for about ``updates`` updates.
    """

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        size = 1 << bits
        pdf = pdf.sort_values(["h", "doc_id"], kind="stable")
        rows = [(np.append(i, size).astype(np.int32), np.append(x, 0.3).astype(np.float32)) for i, x in zip(pdf["idx"], pdf["x"], strict=True)]
        model, y = Ftrl(size + 1), pdf["y"].to_numpy()
        del pdf
        for epoch in range(max(3, min(20, updates // max(len(rows), 1)))):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                model.update(rows[k][0], rows[k][1].astype(np.float64), y[k])
        out = pd.DataFrame({"w": [model.weights().astype(np.float32).tobytes()]})
        del rows, model
        released()
        return out

    rows = hashed(training_sample(docs, labels, label, allowed, sample), {"bits": bits})
    got = rows.groupBy(F.lit(0).alias("one")).applyInPandas(train, "w binary").collect()
    return np.frombuffer(got[0][0], np.float32).astype(np.float64) if got else np.zeros((1 << bits) + 1)


def linear_scores(df: DataFrame, weights: np.ndarray, hasher: dict, bias_x: float = 0.3, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Append score = sigmoid(w . x) of the whole text and predicted = score >= threshold, called ``names``."""
    if {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError("an appended column has the name of one that is there; give other names")
    at = df.columns.index("text")
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, w = Hasher(**hasher), shared.value
        for b in batches:
            f = np.empty(b.num_rows)
            for k, t in enumerate(b.column(at)):
                idx, x = h(t.as_py())
                f[k] = w[idx] @ x + w[-1] * bias_x
            p = 1.0 / (1.0 + np.exp(-np.clip(f, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*b.schema.names, "n0", "n1"])
        del h
        released()

    return mapped(df, work, [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])


def score(df: DataFrame, weights: np.ndarray, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    return linear_scores(df, weights, {"bits": int(np.log2(len(weights) - 1))}, threshold=threshold, names=names)


def kept(docs: DataFrame, scores, keep) -> DataFrame:
    """The rows of ``docs`` whose score ``keep`` accepts, columns as they were; ``scores(df, names)`` appends it."""
    names = fresh(docs, "score", "predicted")
    return scores(docs, tuple(names)).where(keep(col(names[0]))).select(*map(col, docs.columns))
