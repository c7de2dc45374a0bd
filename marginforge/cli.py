"""Command line: linear and multi-level training, kernels, fusion, scoring.

    python -m marginforge.cli linear-train [-s 1] [-c 1] [-p 0.1] [-e eps] [-B -1] [-wi weight] [-v folds] FILE [MODEL]
    python -m marginforge.cli linear-predict [-b 0] FILE MODEL OUT
    python -m marginforge.cli cascade-train [-n 8] [-c 1] [-g 0.001] [-e 0.001] [-i 5] [-b 0] FEATURES LABELS OUT
    python -m marginforge.cli kernel [-t rbf] A B OUT
    python -m marginforge.cli fuse OUT KERNEL KERNEL ...
    python -m marginforge.cli score FEATURES VECTORS MACHINES OUT
    python -m marginforge.cli stream SOURCE VECTORS MACHINES OUT CHECKPOINT

FEATURES, A, B and VECTORS are Parquet (id, features); LABELS is "id label" text; FILE
holds svmlight rows; KERNEL is Parquet (i, j, k); MACHINES is an ensemble's folder.
Sparse files of many features are trained without densifying them.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cascade, features, kernel_join, linear, metrics
from .sources import formats, tables
from .streaming import scorer


class ParameterFormatError(ValueError):
    """An option that is not known or lacks its value."""


def options(args: list[str], known: dict[str, type]) -> tuple[dict, list[str]]:
    """({option: value}, positional); -w takes a label right behind it."""
    got: dict = {}
    k = 0
    while k < len(args) and args[k].startswith("-") and len(args[k]) > 1:
        name = args[k][1:]
        if name == "q":
            k += 1
            continue
        if k + 1 >= len(args):
            raise ParameterFormatError(f"[Error] no value for {args[k]}")
        try:
            if name[0] == "w" and "w" in known:
                got.setdefault("w", {})[int(name[1:])] = float(args[k + 1])
            elif name in known:
                got[name] = known[name](args[k + 1])
            else:
                raise ParameterFormatError(f"[Error] unknown option {args[k]}")
        except ValueError as e:
            raise ParameterFormatError(str(e)) from e
        k += 2
    return got, args[k:]


def linear_train(spark: SparkSession, args: list[str]) -> None:
    o, rest = options(args, {"s": int, "c": float, "p": float, "e": float, "B": float, "v": int, "w": float})
    if not rest:
        raise ParameterFormatError("[Error] no training file")
    p = linear.Parameter(o.get("s", 1), o.get("c", 1.0), o.get("e"), o.get("p", 0.1), o.get("w"))
    rows, n = formats.read_svmlight(spark, rest[0])
    rows = rows.withColumn("label", F.col("label") if p.solver >= 11 else F.col("label").cast("int"))
    if n > linear.DENSE_FEATURES and "v" not in o and not linear.SOLVERS[linear.PRIMAL.get(p.solver, p.solver)][2]:
        model = linear.train_sparse(rows, p, n, o.get("B", -1.0))
        formats.write_lines(spark, formats.format_linear_model(model), rest[1] if len(rest) > 1 else rest[0] + ".model")
        return
    df = formats.densify(rows, n).persist()
    if "v" in o:
        out = linear.cross_validate(df, p, o["v"], o.get("B", -1.0))
        (metrics.regression if p.solver >= 11 else metrics.accuracy)(out).show()
        return
    model = linear.train(df, p, o.get("B", -1.0))
    formats.write_lines(spark, formats.format_linear_model(model), rest[1] if len(rest) > 1 else rest[0] + ".model")


def linear_predict(spark: SparkSession, args: list[str]) -> None:
    o, (test, path, out) = options(args, {"b": int})
    model = formats.read_linear_model(spark, path)
    rows, _ = formats.read_svmlight(spark, test)
    got = linear.predict(rows, model, bool(o.get("b", 0))).persist()
    line = F.concat_ws(" ", F.col("prediction").cast("string"), *([F.array_join(F.transform("probabilities", lambda x: x.cast("string")), " ")] if o.get("b") else []))
    got.orderBy("id").select(line.alias("value")).write.text(out)
    (metrics.accuracy if model.labels else metrics.regression)(got).show()


def cascade_train(spark: SparkSession, args: list[str]) -> None:
    o, rest = options(args, {"n": int, "c": float, "g": float, "e": float, "i": int, "b": int})
    if len(rest) != 3:
        raise ParameterFormatError("[Error] features, labels and output are needed")
    p = cascade.CascadeParameter(o.get("n", 8), o.get("c", 1.0), o.get("g", 1e-3), o.get("e", 1e-3), o.get("i", 5), probability=bool(o.get("b", 0)))
    rows = features.labelled(spark.read.parquet(rest[0]), formats.read_labels(spark, rest[1]), "label")
    model = cascade.fit(rows, p)
    tables.write_machines(*model.tables("cascade", "cascade"), rest[2] + "/machines")
    model.support.withColumn("rho", F.lit(model.rho)).withColumn("gamma", F.lit(model.gamma)).write.parquet(rest[2] + "/support")
    spark.createDataFrame([tuple(n[k] for k in ("pass", "layer", "node", "n_rows", "n_sv", "ld")) for n in model.nodes], "pass int, layer int, node int, n_rows long, n_sv long, ld double").write.parquet(rest[2] + "/nodes")


def kernel(spark: SparkSession, args: list[str]) -> None:
    o, rest = options(args, {"t": str})
    if len(rest) != 3:
        raise ParameterFormatError("[Error] A, B and the output are needed")
    kernel_join.dense_kernel(spark.read.parquet(rest[0]), spark.read.parquet(rest[1]), o.get("t", "rbf")).write.parquet(rest[2])


def fuse(spark: SparkSession, args: list[str]) -> None:
    if len(args) < 2:
        raise ParameterFormatError("[Error] the output and kernels are needed")
    kernel_join.fused([spark.read.parquet(k) for k in args[1:]]).write.parquet(args[0])


def score(spark: SparkSession, args: list[str]) -> None:
    if len(args) != 4:
        raise ParameterFormatError("[Error] features, vectors, machines and output are needed")
    models, sv = tables.read_machines(spark, args[2])
    scorer.score_ensemble(spark.read.parquet(args[0]), spark.read.parquet(args[1]), sv, models).write.parquet(args[3])


def stream(spark: SparkSession, args: list[str]) -> None:
    if len(args) != 5:
        raise ParameterFormatError("[Error] source, vectors, machines, output and checkpoint are needed")
    models, sv = tables.read_machines(spark, args[2])
    scorer.start_ensemble(spark, args[0], "id long, features array<double>", args[3], args[4], spark.read.parquet(args[1]), sv, models).awaitTermination()


COMMANDS = {"kernel": kernel, "fuse": fuse, "score": score, "stream": stream, "linear-train": linear_train, "linear-predict": linear_predict, "cascade-train": cascade_train}


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS:
        print(__doc__)
        return 2
    COMMANDS[args[0]](SparkSession.builder.getOrCreate(), args[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
