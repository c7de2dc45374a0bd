"""Linear classifiers and regressors over DataFrames.

Rows are dense (features array<double>) or sparse (idx array<int> from 1, val
array<double>). Smooth losses (logistic, squared hinge, squared tube) with the L2
penalty are fitted by Newton steps: dense rows of few features sum loss, gradient
and Hessian over partitions (d + d^2 numbers a partition); sparse rows, and dense
ones of more than DENSE_FEATURES features, take truncated Newton steps by conjugate
gradients, whose passes sum d numbers. Those sums are added up block by block of the
weight vector in Spark, so only weights reach the driver. The dual forms of smooth
losses have the same minimum and are found the same way where rows are sparse or
many. The L1 penalty on sparse rows is fitted by proximal gradient steps with
momentum. Losses without a smooth primal (hinge, tube, joint multi-class) run their
dual on the rows of one group in one worker, up to GROUP_ROWS rows; more are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import linear as L
from ..sources.scratch import written

#: id -> (loss, penalty, dual); duals run in a worker.
SOLVERS = {
    0: ("logistic", "l2", False), 1: ("squared_hinge", "l2", True), 2: ("squared_hinge", "l2", False), 3: ("hinge", "l2", True), 4: ("joint", "l2", True),
    5: ("squared_hinge", "l1", False), 6: ("logistic", "l1", False), 7: ("logistic", "l2", False), 11: ("squared_tube", "l2", False), 12: ("squared_tube", "l2", True), 13: ("tube", "l2", True),
}


#: Dense rows of more features take Hessian-vector products; numbers that a weight matrix may have; rows of a dual in one worker.
DENSE_FEATURES, WEIGHTS, GROUP_ROWS = 512, (1 << 31) - 1, 200_000
#: Weights summed up in one group.
BLOCK = 1 << 14
#: Duals with a smooth primal -> the solver of that.
PRIMAL = {1: 2, 7: 0, 12: 11}


@dataclass
class Parameter:
    solver: int = 1
    C: float = 1.0
    eps: float | None = None
    p: float = 0.1
    weights: dict | None = None

    def __post_init__(self) -> None:
        if self.solver not in SOLVERS:
            raise ValueError(f"no such solver: {self.solver}")
        if self.C <= 0:
            raise ValueError("C must not be <= 0")
        self.eps = L.default_eps(self.solver) if self.eps is None else self.eps
        if self.eps <= 0:
            raise ValueError("eps must not be <= 0")
        if self.p < 0:
            raise ValueError("p must not be < 0")
        self.weights = dict(self.weights or {})


@dataclass
class Model:
    """One weight row a class (one for two classes and for regression); ``labels`` in class order."""

    w: np.ndarray
    labels: list | None
    solver: int
    bias: float = -1.0


@dataclass
class Task:
    """One weight row to fit: ``cls`` against the rest with costs ``own`` and ``other``, or a regression (cls None)."""

    cls: int | None
    own: float
    other: float


def _sums(df: DataFrame, tasks: list[Task], W: np.ndarray, loss: str, p: float) -> np.ndarray:
    """(task, 1 + d + d^2): loss, gradient and Hessian of every task in one pass over (features, y)."""
    k, d = W.shape
    shared = df.sparkSession.sparkContext.broadcast(W)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, 1 + d + d * d))
        for pdf in batches:
            if not len(pdf):
                continue
            X, y = np.stack(pdf["features"]), pdf["y"].to_numpy(np.float64)
            Z = X @ shared.value.T
            for n, t in enumerate(tasks):
                target = y if t.cls is None else np.where(y == t.cls, 1.0, -1.0)
                c = np.where(target > 0, t.own, t.other) if t.cls is not None else np.full(len(y), t.own)
                f, g, h = L.loss_parts(loss, Z[:, n], target, p)
                total[n, 0] += (c * f).sum()
                total[n, 1 : 1 + d] += X.T @ (c * g)
                total[n, 1 + d :] += ((X * (c * h)[:, None]).T @ X).ravel()
        yield pd.DataFrame({"part": [total.ravel()]})

    parts = df.select("features", "y").mapInPandas(work, "part array<double>")
    got = parts.select(F.posexplode("part").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(k * (1 + d + d * d))
    for r in got:
        out[r.k] = r.v
    return out.reshape(k, -1)


def newton(df: DataFrame, dim: int, loss: str, penalty: str, tasks: list[Task], p: float = 0.1, tol: float = 1e-8, rounds: int = 100) -> np.ndarray:
    """Minimisers of penalty(w) + sum c * loss(w . x, y) for all tasks; one pass over (features, y) a round.

    Every task takes Newton steps (for the L1 penalty, of its quadratic model) with
    its own step length; those that are done leave the pass.
    """
    d, live = dim, list(range(len(tasks)))
    W, move, step = np.zeros((len(tasks), d)), np.zeros((len(tasks), d)), np.zeros(len(tasks))
    now, slope, first = np.full(len(tasks), np.inf), np.zeros(len(tasks)), np.zeros(len(tasks))
    penalised = lambda v: v @ v / 2 if penalty == "l2" else np.abs(v).sum()
    for _ in range(rounds):
        trial = W[live] + step[live, None] * move[live]
        sums, left = _sums(df, [tasks[n] for n in live], trial, loss, p), []
        for n, w, row in zip(live, trial, sums, strict=True):
            cost = row[0] + penalised(w)
            if step[n] and cost > now[n] + 1e-4 * step[n] * slope[n]:
                step[n] /= 2
                if step[n] > 1e-8:
                    left.append(n)
                continue
            W[n], now[n] = w, cost
            g, H = row[1 : 1 + d], row[1 + d :].reshape(d, d)
            if penalty == "l2":
                grad = g + w
                move[n] = -np.linalg.solve(H + np.eye(d), grad)
                slope[n], size = grad @ move[n], np.abs(grad).max()
            else:
                move[n] = L.soft_newton(H + 1e-10 * np.eye(d), g, w, 1.0) - w
                slope[n] = g @ move[n] + np.abs(w + move[n]).sum() - np.abs(w).sum()
                size = np.abs(move[n]).max()
            first[n] = first[n] or size
            step[n] = 1.0
            if size > tol * first[n] and slope[n] < -1e-15 * max(abs(now[n]), 1):
                left.append(n)
        live = left
        if not live:
            break
    return W


def _passes(df: DataFrame, tasks: list[Task], W: np.ndarray, loss: str, p: float, V: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(losses, gradients) of all tasks in one pass over (idx from 0, val, y), or with ``V`` (zeros, Hessian times V)."""
    k, d = W.shape
    shared = df.sparkSession.sparkContext.broadcast((W, V))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, v = shared.value
        loss_sum, total = np.zeros(k), np.zeros((k, d))
        for b in batches:
            if not b.num_rows:
                continue
            idx, val = b.column(0), b.column(1)
            at, x = idx.flatten().to_numpy(), val.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(idx.offsets.to_numpy()))
            y = b.column(2).to_numpy().astype(np.float64)
            dot = lambda u: np.bincount(row, x * u[at], b.num_rows)  # noqa: B023, E731
            for n, t in enumerate(tasks):
                target = y if t.cls is None else np.where(y == t.cls, 1.0, -1.0)
                c = np.where(target > 0, t.own, t.other) if t.cls is not None else np.full(len(y), t.own)
                f, g, h = L.loss_parts(loss, dot(w[n]), target, p)
                loss_sum[n] += (c * f).sum() if v is None else 0.0
                part = c * g if v is None else c * h * dot(v[n])
                total[n] += np.bincount(at, x * part[row], d)
        flat = np.append(loss_sum, total.ravel())
        cut = range(0, len(flat), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([a // BLOCK for a in cut], pa.int32()), pa.array([flat[a : a + BLOCK] for a in cut], pa.list_(pa.float64()))], ["block", "part"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [np.sum(np.stack(pdf["part"].to_numpy()), axis=0)]})

    parts = df.select("idx", "val", "y").mapInArrow(work, "block int, part array<double>")
    got = sorted(parts.groupBy("block").applyInPandas(add, "block int, part array<double>").collect())
    shared.destroy()
    flat = np.concatenate([np.asarray(r.part) for r in got]) if got else np.zeros(k + k * d)
    return flat[:k], flat[k:].reshape(k, d)


def truncated_newton(df: DataFrame, dim: int, loss: str, tasks: list[Task], p: float = 0.1, tol: float = 1e-8, rounds: int = 60, inner: int = 40) -> np.ndarray:
    """Minimisers of w'w / 2 + sum c * loss(w . x, y): Newton steps by conjugate gradients, all tasks in step with each other."""
    W = np.zeros((len(tasks), dim))
    f, g = _passes(df, tasks, W, loss, p)
    first, live = np.linalg.norm(g, axis=1), np.arange(len(tasks))
    for _ in range(rounds):
        live = live[np.linalg.norm(g[live], axis=1) > tol * np.maximum(first[live], 1e-300)]
        if not len(live):
            break
        own = [tasks[n] for n in live]
        S, R = np.zeros((len(live), dim)), -g[live]
        D, rr = R.copy(), (R * R).sum(1)
        # Solved more closely the nearer the gradient is to 0.
        goal = rr * np.minimum(0.1, np.sqrt(rr) / first[live]) ** 2
        for _ in range(inner):
            H = D + _passes(df, own, W[live], loss, p, D)[1]
            a = np.where(rr > goal, rr / np.maximum((D * H).sum(1), 1e-300), 0.0)[:, None]
            S, R = S + a * D, R - a * H
            new = (R * R).sum(1)
            D, rr = R + (new / np.maximum(rr, 1e-300))[:, None] * D, new
            if (rr <= goal).all():
                break
        step, slope, open_ = np.ones(len(live)), (g[live] * S).sum(1), np.arange(len(live))
        now = f[live] + (W[live] ** 2).sum(1) / 2
        while len(open_):  # each halves its step until the cost falls enough
            trial = W[live[open_]] + step[open_, None] * S[open_]
            cost, grad = _passes(df, [own[n] for n in open_], trial, loss, p)
            fine = cost + (trial**2).sum(1) / 2 <= now[open_] + 1e-4 * step[open_] * slope[open_] + 1e-14 * np.abs(now[open_])
            at = live[open_[fine]]
            W[at], f[at], g[at] = trial[fine], cost[fine], grad[fine] + trial[fine]
            step[open_] /= 2
            open_ = open_[~fine & (step[open_] > 1e-10)]
        if (step < 1e-10).all():
            break
    return W


def proximal(df: DataFrame, dim: int, loss: str, tasks: list[Task], p: float = 0.1, tol: float = 1e-6, rounds: int = 500) -> np.ndarray:
    """Minimisers of |w|_1 + sum c * loss(w . x, y): proximal gradient steps with momentum and restarts, step sizes found by doubling."""
    k = len(tasks)
    W = Z = np.zeros((k, dim))
    rate, t, size0 = np.ones(k), np.ones(k), None
    for _ in range(rounds):
        f, g = _passes(df, tasks, Z, loss, p)
        while True:
            raw = Z - g / rate[:, None]
            new = np.sign(raw) * np.maximum(np.abs(raw) - 1.0 / rate[:, None], 0)
            move = new - Z
            up = _passes(df, tasks, new, loss, p)[0] > f + (g * move).sum(1) + rate / 2 * (move * move).sum(1) + 1e-12 * np.abs(f)
            if not up.any():
                break
            rate = np.where(up, 2 * rate, rate)
        size = (rate * np.abs(move).max(axis=1)).max()
        size0 = size0 or size
        again = ((Z - new) * (new - W)).sum(1) > 0
        t = np.where(again, 1.0, t)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        Z, W, t = new + (((t - 1) / after) * ~again)[:, None] * (new - W), new, after
        if size <= tol * size0:
            break
        rate = rate * 0.9
    return W


def _sized(classes: int, features: int) -> None:
    if classes * features > WEIGHTS:
        raise ValueError(f"number of classes ({classes}) times number of features ({features}) is too large")


def as_sparse(df: DataFrame) -> DataFrame:
    """Dense rows as (idx from 1, val) of their entries other than 0."""
    pairs = F.filter(F.arrays_zip(F.sequence(F.lit(1), F.size("features")).alias("i"), F.col("features").alias("v")), lambda z: z["v"] != 0)
    return df.withColumn("_z", F.when(F.size("features") > 0, pairs)).withColumn("idx", F.coalesce(F.col("_z.i"), F.array().cast("array<int>"))).withColumn("val", F.coalesce(F.col("_z.v"), F.array().cast("array<double>"))).drop("_z", "features")


def train_sparse(df: DataFrame, parameter: Parameter, features: int, bias: float = -1.0, tol: float | None = None) -> Model:
    """A model of sparse rows (id, label, idx, val) with ``features`` features; as `train`, for smooth losses."""
    solver = PRIMAL.get(parameter.solver, parameter.solver)
    loss, penalty, dual = SOLVERS[solver]
    if dual:
        raise ValueError("this solver has no smooth form; densify the rows and use train")
    df = df.where(F.col("label").isNotNull() & F.col("idx").isNotNull())
    dim = features + (bias >= 0)
    zero_based = F.transform("idx", lambda i: (i - 1).cast("int"))
    at, val = (F.array_append(zero_based, F.lit(features)), F.array_append("val", F.lit(float(bias)))) if bias >= 0 else (zero_based, F.col("val"))
    C, weight, tol = parameter.C, parameter.weights, tol or min(1e-6, parameter.eps)
    if "tube" in loss:
        labels, tasks, y = None, [Task(None, C, C)], F.col("label").cast("double")
    else:
        labels = [r.label for r in df.groupBy("label").agg(F.min("id").alias("first")).orderBy("first", "label").collect()]
        _sized(len(labels), dim)
        other = weight.get(labels[1], 1.0) if len(labels) == 2 else 1.0
        tasks = [Task(k, C * weight.get(cls, 1.0), C * other) for k, cls in enumerate(labels[:1] if len(labels) == 2 else labels)]
        y = (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("double")
    rows = df.select(at.alias("idx"), val.alias("val"), y.alias("y")).persist()
    if penalty == "l2":
        w = truncated_newton(rows, dim, loss, tasks, parameter.p, tol)
    else:
        w = proximal(rows, dim, loss, tasks, parameter.p, tol)
    rows.unpersist()
    return Model(w, labels, parameter.solver, bias)


def _worker(df: DataFrame, key: Column, fit, dim: int) -> dict:
    """Run ``fit(pdf) -> weights`` on the rows of each group."""
    out = df.withColumn("key", key).groupBy("key").applyInPandas(lambda pdf: pd.DataFrame({"key": [int(pdf["key"].iloc[0])], "w": [fit(pdf.sort_values("id")).ravel()]}), "key int, w array<double>")
    return {r.key: np.array(r.w) for r in out.collect()}


def train(df: DataFrame, parameter: Parameter, bias: float = -1.0, tol: float | None = None) -> Model:
    """A model of (id, label, features); two classes give one weight row, more give one-vs-rest.

    Classes go by their first id. Negatives of one-vs-rest keep the unweighted C.
    """
    loss, penalty, dual = SOLVERS[parameter.solver]
    df = df.where(F.col("label").isNotNull() & F.col("features").isNotNull())
    if bias >= 0:
        df = df.withColumn("features", F.array_append("features", F.lit(float(bias))))
    size = df.agg(F.max(F.size("features")).alias("d"), F.count("*").alias("n"), F.count_distinct("label").alias("k")).head()
    dim = size.d or 0
    if parameter.solver < 11:
        _sized(size.k, dim)
    if (not dual and penalty == "l2" and dim > DENSE_FEATURES) or (parameter.solver in PRIMAL and size.n > GROUP_ROWS):
        return replace(train_sparse(as_sparse(df), parameter, dim, tol=tol), bias=bias)
    if dual and size.n > GROUP_ROWS:
        raise ValueError(f"{size.n} rows: a dual without smooth form runs on at most {GROUP_ROWS} rows in one worker; use the multi-level trainer")
    C, p, eps = parameter.C, parameter.p, parameter.eps
    tol = tol or min(1e-8, eps)
    if "tube" in loss:
        rows = df.select("id", "features", F.col("label").cast("double").alias("y"))
        if not dual:
            rows = rows.persist()
            w = newton(rows, dim, loss, penalty, [Task(None, C, C)], p, tol)
            rows.unpersist()
            return Model(w, None, parameter.solver, bias)
        fit = lambda pdf: L.tube_dual(np.stack(pdf["features"]), pdf["y"].to_numpy(), C, p, loss == "squared_tube", eps)[0]
        return Model(_worker(rows, F.lit(0), fit, dim)[0][None], None, parameter.solver, bias)
    order = df.groupBy("label").agg(F.min("id").alias("first")).orderBy("first", "label").collect()
    labels = [r.label for r in order]
    weight = parameter.weights
    if loss == "joint":
        at = {k: n for n, k in enumerate(labels)}

        def joint(pdf: pd.DataFrame) -> np.ndarray:
            k = pdf["label"].map(at).to_numpy()
            c = np.array([C * weight.get(labels[j], 1.0) for j in k])
            return L.crammer_singer(np.stack(pdf["features"]), k, len(labels), c, eps)

        return Model(_worker(df, F.lit(0), joint, dim)[0].reshape(len(labels), -1), labels, parameter.solver, bias)
    tasks = [labels[0]] if len(labels) == 2 else labels
    other = weight.get(labels[1], 1.0) if len(labels) == 2 else 1.0
    if not dual:
        place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
        rows = df.select("features", place.cast("double").alias("y")).persist()
        w = newton(rows, dim, loss, penalty, [Task(k, C * weight.get(cls, 1.0), C * other) for k, cls in enumerate(tasks)], p, tol)
        rows.unpersist()
        return Model(w, labels, parameter.solver, bias)
    # Every class is a group of its own: one job for all.
    names = df.sparkSession.createDataFrame([(k, cls) for k, cls in enumerate(tasks)], f"task int, cls {df.schema['label'].dataType.simpleString()}")
    own = F.col("label") == F.col("cls")
    rows = df.join(F.broadcast(names), F.lit(True)).select("id", "features", "task", F.when(own, 1.0).otherwise(-1.0).alias("y"), own.alias("own"))
    cost = [C * weight.get(cls, 1.0) for cls in tasks]

    def fit(pdf: pd.DataFrame) -> np.ndarray:
        c = np.where(pdf["own"].to_numpy(), cost[int(pdf["task"].iloc[0])], C * other)
        return L.hinge_dual(np.stack(pdf["features"]), pdf["y"].to_numpy(), c, loss == "squared_hinge", eps)[0]

    got = _worker(rows, F.col("task"), fit, dim)
    return Model(np.array([got[k] for k in range(len(tasks))]), labels, parameter.solver, bias)


def predict(df: DataFrame, model: Model, probability: bool = False) -> DataFrame:
    """Append prediction (and the classes' probabilities for logistic solvers): sums of products, JVM-side.

    Rows are dense (features) or sparse (idx from 1, val). Weights come from a table of
    one row. Features beyond the model are ignored. Among equals the first class wins.
    """
    n = model.w.shape[1] - (model.bias >= 0)
    table = df.sparkSession.createDataFrame([(model.w[:, :n].tolist(), (model.w[:, n] * model.bias).tolist() if model.bias >= 0 else [0.0] * len(model.w))], "_w array<array<double>>, _b array<double>")
    if "idx" in df.columns:
        cells = F.filter(F.arrays_zip("idx", "val"), lambda c: c["idx"] <= n)
        dot = lambda w: F.aggregate(cells, F.lit(0.0), lambda s, c: s + F.element_at(w, c["idx"]) * c["val"])
    else:
        dot = lambda w: F.aggregate(F.zip_with("features", w, lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)
    out = df.crossJoin(F.broadcast(table)).withColumn("_z", F.zip_with(F.transform("_w", dot), F.col("_b"), lambda a, b: a + b)).drop("_w", "_b")
    z = F.col("_z")
    if model.labels is None:
        return out.withColumn("prediction", z[0]).drop("_z")
    names = F.array(*map(F.lit, model.labels))
    pick = F.when(z[0] > 0, names[0]).otherwise(names[1]) if len(model.w) == 1 else F.element_at(names, F.array_position(z, F.array_max(z)).cast("int"))
    out = out.withColumn("prediction", pick)
    if probability:
        if SOLVERS[model.solver][0] != "logistic":
            raise ValueError("probability output is only supported for logistic regression")
        s = F.transform(z, lambda v: 1 / (1 + F.exp(-v)))
        p = F.array(s[0], 1 - s[0]) if len(model.w) == 1 else F.transform(s, lambda v: v / F.aggregate(s, F.lit(0.0), lambda a, b: a + b))
        out = out.withColumn("probabilities", p)
    return out.drop("_z")


def cross_validate(df: DataFrame, parameter: Parameter, k: int, bias: float = -1.0) -> DataFrame:
    """Rows of (id, label, features, fold) with the prediction of the model that did not see them."""
    from .partition import folds

    split = written(folds(df, k), "folds")
    out = None
    for fold in range(k):
        part = predict(split.where(F.col("fold") == fold), train(split.where(F.col("fold") != fold), parameter, bias))
        out = part if out is None else out.unionByName(part)
    return out
