"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic documents (P) and a sample of texts whose labels are
not looked at (U). With class prior pi and logistic loss l the risk is
    pi E_P[l(+)] + max(-beta, E_U[l(-)] - pi E_P[l(-)]):
the negatives' risk is what U shows less the share of its positives, and a step
is taken against it when that estimate falls below zero. The classifier is linear
over hashed words and beginnings of words that occur at all, found by numpy steps. The
prior is the share of toxic rows among the labelled ones that may be learned from.

Both samples are bounded (``positives``, ``unlabelled``: ids of smallest hash, one
row an id, the smallest text of rows that share one). Features are taken where the
texts lie; one task receives those rows. Null and empty texts get the bias; very
long texts are scored whole; repeated rows score alike; without positives every
score is the prior. Other columns pass through unchanged; the two that are appended
may be named.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released
from .quality import hashed, linear_scores, one_text

HASHER = {"bits": 18, "pairs": False, "prefixes": (4, 5, 6, 7, 8), "binary": True}


def _csr(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(r) for r in rows], np.int64)
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), np.append(0, np.cumsum(n))


def nnpu(pos: list[np.ndarray], unl: list[np.ndarray], size: int, prior: float, rounds: int = 400, kappa: float = 1.0, shrink: float = 0.1, overlap: float = 6.0, beta: float = 0.0) -> np.ndarray:
    """Weights of a linear classifier over binary features (rows: index arrays), the last one the bias.

    Proximal gradient steps on the risk plus a weighted L1 norm: a feature's
    penalty is ``kappa`` standard errors of its gradient under chance, so what
    differs between the samples only by chance stays at 0. Features that cannot
    enter at the start are left out. Steps are scaled by the features' curvature;
    ``overlap`` is how many active ones a text may have before steps shrink.
    """
    # Some rows at a time: the whole samples' indexes would be held several times over.
    seen = lambda rows: sum((np.bincount(_csr(rows[k : k + 256])[0], minlength=size) for k in range(0, len(rows), 256)), np.zeros(size, np.int64))
    df_p, df_u = seen(pos) / max(len(pos), 1), seen(unl) / max(len(unl), 1)
    base = np.maximum((df_p * len(pos) + df_u * len(unl)) / (len(pos) + len(unl)), 1.0 / (len(pos) + len(unl)))
    penalty = kappa * prior * np.sqrt(base / max(len(pos), 1))
    used = np.flatnonzero((prior * np.abs(df_p - df_u) > penalty) & (df_p * len(pos) >= 2))
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    small = lambda rows: _csr([at[at >= 0] for at in (place[r] for r in rows)])
    (pi, pp), (ui, up) = small(pos), small(unl)
    n_p, n_u = np.diff(pp), np.diff(up)
    lam, step = penalty[used] * shrink, 1.0 / (overlap * 0.25 * np.maximum(df_u[used], 1e-4))
    w, bias = np.zeros(len(used)), np.log(prior / (1 - prior))
    row_p, row_u = np.repeat(np.arange(len(pos)), n_p), np.repeat(np.arange(len(unl)), n_u)
    mean, mean_bias, taken = np.zeros(len(used)), 0.0, 0
    for k in range(rounds):
        fp = np.bincount(row_p, w[pi], len(pos)) + bias
        fu = np.bincount(row_u, w[ui], len(unl)) + bias
        sp, su = 1 / (1 + np.exp(-np.clip(fp, -35, 35))), 1 / (1 + np.exp(-np.clip(fu, -35, 35)))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if negative >= -beta:  # gradients of the whole risk at each score
            gp, gu = np.full(len(pos), -prior / len(pos)), su / len(unl)
        else:  # the estimate says less than none: back up that part
            gp, gu = prior * sp / len(pos), -su / len(unl)
        g = np.bincount(pi, gp[row_p], len(used)) + np.bincount(ui, gu[row_u], len(used))
        w = w - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * lam, 0)
        w = np.clip(w, -20, 20)
        bias -= 2.0 * (gp.sum() + gu.sum())
        if 2 * k >= rounds:  # steps back make the last point jumpy: the second half's mean is kept
            mean, mean_bias, taken = mean + w, mean_bias + bias, taken + 1
    out = np.zeros(size + 1)
    out[used], out[-1] = mean / taken, mean_bias / taken
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, positives: int = 4096, unlabelled: int = 8192) -> np.ndarray:
    """Weights from positives and unlabelled texts; ``allowed`` is asked of rows of either table (column doc_id)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.max(label).alias("y"))
    counts = known.agg(F.avg(F.col("y").cast("double")).alias("prior")).head()
    size = 1 << HASHER["bits"]
    prior = min(max(counts.prior or 0.0, 1e-3), 0.9)
    if not counts.prior:
        return np.append(np.zeros(size), np.log(prior / (1 - prior)))
    ranked = lambda df, n: df.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(n)
    p = ranked(known.where("y = 1"), positives).withColumn("p", F.lit(1))
    u = ranked(docs.where(F.col("doc_id").isNotNull() & allowed).select("doc_id").distinct(), unlabelled).withColumn("p", F.lit(0))
    # An id may be in both samples; each text is read once.
    picked = p.unionByName(u).groupBy("doc_id", "h").agg(F.max("p").alias("p"), (F.min("p") == 0).alias("u"))
    sample = hashed(one_text(docs, picked).withColumn("t", F.xxhash64("text", F.lit(1))), HASHER).drop("x")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"], kind="stable")
        side = lambda flag: list(pdf[flag].drop_duplicates("t")["idx"])  # noqa: E731  # copies say nothing new
        w = nnpu(side(pdf["p"] == 1), side(pdf["u"]), size, prior)
        out = pd.DataFrame({"w": [w.astype(np.float32).tobytes()]})
        del pdf
        released()
        return out

    got = sample.groupBy(F.lit(0).alias("one")).applyInPandas(train, "w binary").collect()
    return np.frombuffer(got[0][0], np.float32).astype(np.float64) if got else np.append(np.zeros(size), np.log(prior / (1 - prior)))


def score(df: DataFrame, weights: np.ndarray, threshold: float = 0.7, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Append score and predicted, called ``names``."""
    return linear_scores(df, weights, HASHER, bias_x=1.0, threshold=threshold, names=names)
