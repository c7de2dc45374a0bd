"""Readers and writers of the exchange formats, as DataFrames.

Text formats are parsed with column expressions; binary chunks are decoded file by
file in the workers. A malformed line is an error that names it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class InvalidInput(ValueError):
    """A line that cannot be parsed."""


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id): one integer a line, surrounding space ignored."""
    return spark.read.text(path).select(F.trim("value").cast("long").alias("id")).where("id is not null")


def read_id_sequence(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of a sequence file of integer pairs."""
    return spark.createDataFrame(spark.sparkContext.sequenceFile(path), "pos int, id int")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label): "id label" lines; of repeated ids the last line wins."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.where("trim(value) <> ''").select(parts[0].cast("long").alias("id"), parts[1].cast("double").alias("label"), "n")
    return rows.groupBy("id").agg(F.max_by("label", "n").alias("label"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name): first token of each line."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("pos"), F.split(F.trim("value"), r"\s+")[0].alias("name"))
    return rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, grp): file name of each line, running number, pooling group (what stands before a slash)."""
    from ..operators.features import numbered

    names = read_names(spark, path)
    rows = numbered(names, "pos", "id").select("id", "name")
    return rows.withColumn("grp", F.when(F.col("name").contains("/"), F.substring_index("name", "/", 1)).otherwise(F.lit("")))


def read_svmlight(spark: SparkSession, path: str, bias: float = -1.0) -> tuple[DataFrame, int]:
    """((id, label, idx array<int>, val array<double>), features) of "label i:v i:v" lines.

    Indexes are 1-based and must ascend; a label alone is an empty row; an empty
    line, a bad token or an index below 1 is an error. With bias >= 0 a last
    constant feature is appended.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    t = F.split(F.trim("line"), r"[\s]+")
    pairs = F.transform(F.slice(t, 2, 1 << 30), lambda x: F.split(x, ":"))
    idx = F.transform(pairs, lambda p: F.try_element_at(p, F.lit(1)).try_cast("int"))
    val = F.transform(pairs, lambda p: F.try_element_at(p, F.lit(2)).try_cast("double"))
    rows = lines.select("id", "line", t[0].try_cast("double").alias("label"), idx.alias("idx"), val.alias("val"), F.forall(pairs, lambda p: F.size(p) == 2).alias("fine"))
    ascending = F.forall(F.sequence(F.lit(1), F.size("idx")), lambda k: (k <= 1) | (F.try_element_at("idx", k) > F.try_element_at("idx", k - 1)))
    ok = F.col("label").isNotNull() & F.col("fine") & F.forall("idx", lambda x: x.isNotNull() & (x >= 1)) & F.forall("val", lambda x: x.isNotNull()) & ((F.size("idx") < 2) | ascending)
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    bad = rows.where("not ok").select("line").head()
    if bad is not None:
        raise InvalidInput(f"{path}: {bad.line!r}")
    n = rows.agg(F.coalesce(F.max(F.when(F.size("idx") > 0, F.array_max("idx"))), F.lit(0))).head()[0]
    out = rows.select("id", "label", "idx", "val")
    if bias >= 0:
        n += 1
        out = out.select("id", "label", F.array_append("idx", F.lit(n)).alias("idx"), F.array_append("val", F.lit(float(bias))).alias("val"))
    return out, n


def densify(rows: DataFrame, n: int) -> DataFrame:
    """(id, label, features) of sparse rows with 1-based indexes; those beyond n are ignored."""
    at = F.map_from_arrays("idx", "val")
    features = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.coalesce(F.try_element_at(at, k), F.lit(0.0)))
    return rows.select("id", "label", features.alias("features"))


def long_form(rows: DataFrame, base: int = 1) -> DataFrame:
    """(id, idx, val) with 0-based indexes."""
    z = F.explode(F.arrays_zip("idx", "val")).alias("z")
    return rows.select("id", z).select("id", (F.col("z.idx") - base).alias("idx"), F.col("z.val").alias("val"))


def write_svmlight(rows: DataFrame, path: str) -> None:
    """"label i:v ..." lines in order of id."""
    pairs = F.zip_with("idx", "val", lambda i, v: F.concat(i.cast("string"), F.lit(":"), v.cast("string")))
    rows.orderBy("id").select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(pairs, " ")).alias("value")).write.text(path)


def read_arff(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """((id, features, label), classes) of a dense file whose last attribute is the nominal class."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.trim("value").alias("line"))
    head = lines.where(F.lower("line").startswith("@attribute") & F.col("line").contains("{")).orderBy(F.col("id").desc()).head()
    classes = [c.strip() for c in head.line[head.line.index("{") + 1 : head.line.rindex("}")].split(",")] if head else []
    start = lines.where(F.lower("line") == "@data").agg(F.min("id")).head()[0]
    rows = lines.where((F.col("id") > F.lit(start)) & (F.col("line") != "") & ~F.col("line").startswith("%"))
    cells = F.transform(F.split("line", ","), F.trim)
    return rows.select("id", F.transform(F.slice(cells, 1, F.size(cells) - 1), lambda x: x.cast("double")).alias("features"), F.element_at(cells, -1).alias("label")), classes


def _binary(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                yield decode(name, raw)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, schema)


def read_feature_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(id, idx array<int>, val array<float>) of big-endian chunks: int row, int size, then (short, float) pairs.

    Shorts are read unsigned, so wide indexes survive.
    """

    def decode(name: str, raw: bytes) -> pd.DataFrame:
        ids, idx, val, at = [], [], [], 0
        cell = np.dtype([("i", ">u2"), ("v", ">f4")])
        while at < len(raw):
            row, n = struct.unpack_from(">ii", raw, at)
            part = np.frombuffer(raw, cell, n, at + 8)
            at += 8 + n * cell.itemsize
            ids.append(row)
            idx.append(part["i"].astype(np.int32))
            val.append(part["v"].astype(np.float32))
        return pd.DataFrame({"id": ids, "idx": idx, "val": val})

    return _binary(spark, path, decode, "id long, idx array<int>, val array<float>")


def encode_feature_chunk(rows: list[tuple[int, list[int], list[float]]]) -> bytes:
    """Bytes of one chunk."""
    cell = np.dtype([("i", ">u2"), ("v", ">f4")])
    out = []
    for row, idx, val in rows:
        part = np.empty(len(idx), cell)
        part["i"], part["v"] = idx, val
        out.append(struct.pack(">ii", row, len(idx)) + part.tobytes())
    return b"".join(out)


def read_kernel_chunks(spark: SparkSession, path: str, columns: int, endian: str = ">") -> DataFrame:
    """(block, r, ks array<float>) of dense float32 rows; the block number stands in the name after "-c"."""

    def decode(name: str, raw: bytes) -> pd.DataFrame:
        import re

        block = int(re.search(r"-c(\d+)", name)[1])
        k = np.frombuffer(raw, f"{endian}f4").reshape(-1, columns).astype(np.float32)
        return pd.DataFrame({"block": [block] * len(k), "r": np.arange(len(k)), "ks": list(k)})

    return _binary(spark, path, decode, "block int, r long, ks array<float>")


def read_prediction_chunks(spark: SparkSession, path: str, concepts: int) -> DataFrame:
    """(id, probs array<double>) of big-endian double rows [id, p1..pk]."""

    def decode(name: str, raw: bytes) -> pd.DataFrame:
        x = np.frombuffer(raw, ">f8").reshape(-1, concepts + 1).astype(np.float64)
        return pd.DataFrame({"id": x[:, 0].astype(np.int64), "probs": list(x[:, 1:])})

    return _binary(spark, path, decode, "id long, probs array<double>")


def kernel_lines(kernel_rows: DataFrame, order: list[str], sign: int = 1) -> DataFrame:
    """(value): "0:n 1:v 2:v ..." with a global running n from 1, values times ``sign``."""
    from ..operators.features import numbered

    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    rows = numbered(kernel_rows.withColumn("_o", key), "_o", "n")
    cells = F.transform(F.sequence(F.lit(1), F.size("ks")), lambda k: F.concat(k.cast("string"), F.lit(":"), (F.element_at("ks", k) * sign).cast("string")))
    return rows.select("n", F.concat_ws(" ", F.concat(F.lit("0:"), F.col("n").cast("string")), F.array_join(cells, " ")).alias("value"))


def read_dense_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(r, c, v) of a space-separated matrix."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("r"), F.split(F.trim("value"), r"\s+").alias("x"))
    return rows.select("r", F.posexplode("x").alias("c", "t")).select("r", "c", F.col("t").cast("double").alias("v"))


def read_kernel_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, ks array<double>) of "0:n 1:v 2:v ..." lines, with or without a label in front; the columns must be 1, 2, ..."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    t = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x.contains(":"))
    cells = F.transform(t, lambda x: F.struct(F.substring_index(x, ":", 1).try_cast("int").alias("c"), F.substring_index(x, ":", -1).try_cast("double").alias("v")))
    rows = lines.select("value", F.try_element_at(F.filter(cells, lambda z: z["c"] == 0), F.lit(1))["v"].cast("long").alias("n"), F.filter(cells, lambda z: z["c"] != 0).alias("z"))
    ok = F.col("n").isNotNull() & F.forall(F.zip_with("z", F.sequence(F.lit(1), F.greatest(F.size("z"), F.lit(1))), lambda z, k: (z["c"] == k) | ((k == 1) & z.isNull())), lambda x: F.coalesce(x, F.lit(False))) & F.forall("z", lambda z: z["v"].isNotNull())
    bad = rows.where(~F.coalesce(ok, F.lit(False))).select("value").head()
    if bad is not None:
        raise InvalidInput(f"{path}: {bad.value!r}")
    return rows.select("n", F.col("z.v").alias("ks"))


def chunk_files(spark: SparkSession, path: str, pattern: str) -> list[tuple[int, str]]:
    """(number, path) of the files whose name matches ``pattern`` (one group: the number), in order; numbers must be 0..m-1."""
    files = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract(F.substring_index("path", "/", -1), pattern, 1).alias("k")).where("k <> ''")
    found = sorted((int(r.k), r.path) for r in files.collect())
    if [k for k, _ in found] != list(range(len(found))):
        raise InvalidInput(f"{path}: chunks are not consecutive: {[k for k, _ in found]}")
    return found


def check_kernel_chunks(spark: SparkSession, path: str, columns: int) -> int:
    """Number of kernel chunks; an error if their numbers have gaps or one but the last has another size."""
    found = chunk_files(spark, path, r"-c(\d+)")
    sizes = {r.path: r.length for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()}
    rows = [sizes[p] for _, p in found]
    if any(n % (4 * columns) for n in rows) or len(set(rows[:-1])) > 1 or (len(rows) > 1 and rows[-1] > rows[0]):
        raise InvalidInput(f"{path}: chunks of unequal size: {rows}")
    return len(found)


def kernel_chunk_bytes(kernel_rows: DataFrame, endian: str = ">") -> DataFrame:
    """(block, content binary): dense float32 rows (block, r, ks) of each block, in order of r, as one chunk."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("r")
        return pd.DataFrame({"block": own["block"].iloc[:1].astype("int32"), "content": [np.stack(own["ks"].to_numpy()).astype(f"{endian}f4").tobytes()]})

    return kernel_rows.select("block", "r", "ks").groupBy("block").applyInPandas(encode, "block int, content binary")


def feature_chunk_bytes(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """(chunk, content binary): sparse rows (id, idx, val) in order of id, ``chunk_rows`` a chunk, in the binary form of `read_feature_chunks`.

    Rows are numbered from 0 in the chunks.
    """
    from ..operators.features import numbered

    placed = numbered(rows.select("id", "idx", "val"), "id").withColumn("chunk", F.floor((F.col("rn") - 1) / chunk_rows).cast("int"))

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("rn")
        return pd.DataFrame({"chunk": own["chunk"].iloc[:1], "content": [encode_feature_chunk(list(zip((own["rn"] - 1).tolist(), own["idx"], own["val"], strict=True)))]})

    return placed.groupBy("chunk").applyInPandas(encode, "chunk int, content binary")


def write_kernel_table(kernel_rows: DataFrame, path: str) -> None:
    """(block, r, ks) as Parquet laid out by block."""
    kernel_rows.select("block", "r", "ks").repartition("block").sortWithinPartitions("block", "r").write.partitionBy("block").parquet(path)


def modality_blocks(modalities: list[DataFrame], rows: int) -> DataFrame:
    """(block, m, r, idx, val) of several modalities (id, idx, val) of the same ids: blocks of ids, in each all rows of the first modality, then of the second, ..."""
    from ..operators.features import numbered

    ids = numbered(modalities[0].select("id").distinct(), "id")
    place = ids.select("id", F.floor((F.col("rn") - 1) / rows).cast("int").alias("block"), ((F.col("rn") - 1) % rows).alias("_r"))
    out = None
    for k, df in enumerate(modalities):
        part = df.join(place, "id").select("block", F.lit(k).alias("m"), (F.lit(k) * rows + F.col("_r")).alias("r"), "id", "idx", "val")
        out = part if out is None else out.unionByName(part)
    return out


def label_features(features: DataFrame, ids: DataFrame) -> DataFrame:
    """(rn, label, idx, val): features (n, idx, val) and ids (n, id) bound by running number; label 1 where the id is 1, else -1. Unequal lengths are an error."""
    both = features.join(ids, "n", "full")
    if both.where(F.col("id").isNull() | F.col("idx").isNull()).limit(1).count():
        raise InvalidInput("features and ids have different rows")
    return both.select(F.col("n").alias("rn"), F.when(F.col("id") == 1, 1).otherwise(-1).alias("label"), "idx", "val")


def concatenated(ids: DataFrame, features: DataFrame, key: str) -> tuple[DataFrame, int]:
    """((n, key, idx, val), missing): features of the listed keys (pos, key) in order, numbered from 1; keys without features are left out and counted."""
    from ..operators.features import numbered

    joined = ids.join(features, key, "left")
    missing = joined.where("idx is null").count()
    return numbered(joined.where("idx is not null"), "pos", "n").select("n", key, "idx", "val"), missing


def check_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, line, ok): whether each line is "label i:v ..." with ascending indexes from 1."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    t = F.split(F.trim("line"), r"\s+")
    pairs = F.transform(F.slice(t, 2, 1 << 30), lambda x: F.split(x, ":"))
    idx = F.transform(pairs, lambda p: F.try_element_at(p, F.lit(1)).try_cast("int"))
    fine = F.forall(pairs, lambda p: (F.size(p) == 2) & F.coalesce(F.try_element_at(p, F.lit(1)).try_cast("int") >= 1, F.lit(False)) & F.try_element_at(p, F.lit(2)).try_cast("double").isNotNull())
    ascending = F.array_sort(F.array_distinct(idx)) == idx
    return rows.select("id", "line", F.coalesce(t[0].try_cast("double").isNotNull() & fine & ascending, F.lit(False)).alias("ok"))


# -- model texts: small files, read and written by the driver through Spark's readers ----------------


def _text(spark: SparkSession, path: str) -> list[str]:
    return [r.value for r in spark.read.text(path, wholetext=False).coalesce(1).collect()]


def parse_machine_model(lines: list[str]) -> dict:
    """A kernel machine's text: header keys, then SV lines of coefficients and cells."""
    ints, floats = {"nr_class", "total_sv", "degree"}, {"gamma", "coef0", "threshold_recall", "threshold_precision"}
    out: dict = {"sv": []}
    for n, line in enumerate(lines):
        key, *rest = line.split()
        if key == "SV":
            k = out["nr_class"] - 1
            for row in lines[n + 1 :]:
                cells = row.split()
                out["sv"].append(([float(x) for x in cells[:k]], {int(a): float(b) for a, b in (c.split(":") for c in cells[k:])}))
            return out
        if key in ints:
            out[key] = int(rest[0])
        elif key in floats:
            out[key] = float(rest[0])
        elif key in {"rho", "probA", "probB"}:
            out[key] = [float(x) for x in rest]
        elif key in {"label", "nr_sv"}:
            out[key] = [int(x) for x in rest]
        elif key in {"svm_type", "kernel_type"}:
            out[key] = rest[0]
        else:
            raise InvalidInput(f"unknown text in model file: {line!r}")
    raise InvalidInput("a model file without SV lines")


def format_machine_model(model: dict) -> list[str]:
    out = [f"svm_type {model.get('svm_type', 'c_svc')}", f"kernel_type {model.get('kernel_type', 'precomputed')}"]
    out += [f"{k} {model[k]:g}" if isinstance(model[k], float) else f"{k} {model[k]}" for k in ("degree", "gamma", "coef0") if k in model]
    out += [f"nr_class {model['nr_class']}", f"total_sv {len(model['sv'])}", "rho " + " ".join(f"{x:.17g}" for x in model["rho"])]
    for k in ("label", "probA", "probB", "nr_sv"):
        if k in model:
            out.append(f"{k} " + " ".join(f"{x:.17g}" if isinstance(x, float) else str(x) for x in model[k]))
    return [*out, "SV", *(" ".join([*(f"{c:.17g}" for c in coef), *(f"{i}:{v:.8g}" for i, v in cells.items())]) for coef, cells in model["sv"])]


#: Names of the linear solver ids.
LINEAR_SOLVERS = {0: "L2R_LR", 1: "L2R_L2LOSS_SVC_DUAL", 2: "L2R_L2LOSS_SVC", 3: "L2R_L1LOSS_SVC_DUAL", 4: "MCSVM_CS", 5: "L1R_L2LOSS_SVC", 6: "L1R_LR", 7: "L2R_LR_DUAL", 11: "L2R_L2LOSS_SVR", 12: "L2R_L2LOSS_SVR_DUAL", 13: "L2R_L1LOSS_SVR_DUAL"}


def parse_linear_model(lines: list[str]):
    """A linear model's text as operators.linear.Model."""
    from ..operators.linear import Model

    ids, head = {v: k for k, v in LINEAR_SOLVERS.items()}, {}
    for n, line in enumerate(lines):
        key, *rest = line.split()
        if key == "w":
            break
        if key not in {"solver_type", "nr_class", "label", "nr_feature", "bias"}:
            raise InvalidInput(f"unknown text in model file: {line!r}")
        head[key] = rest
    else:
        raise InvalidInput("a model file without weights")
    solver, k, bias = ids[head["solver_type"][0]], int(head["nr_class"][0]), float(head["bias"][0])
    d = int(head["nr_feature"][0]) + (bias >= 0)
    columns = 1 if k == 2 and solver != 4 or solver >= 11 else k
    rows = [[float(x) for x in line.split()] for line in lines[n + 1 :] if line.strip()]
    if len(rows) != d or any(len(r) != columns for r in rows):
        raise InvalidInput("weights end too early")
    return Model(np.array(rows).T.copy(), [int(x) for x in head["label"]] if "label" in head else None, solver, bias)


def parse_binary_linear_model(lines: list[str]) -> dict:
    """A two-class linear machine's text: header keys, b, dim, then w and one weight a line; the decision is w . x + b."""
    out: dict = {}
    for n, line in enumerate(lines):
        key, *rest = line.split() or [""]
        if key == "w":
            weights = [*rest, *(x.strip() for x in lines[n + 1 :] if x.strip())]
            out["w"] = np.array([float(x) for x in weights])
            if len(out["w"]) != out.get("dim", len(out["w"])):
                raise InvalidInput(f"{len(out['w'])} weights where dim is {out['dim']}")
            return out
        if key in {"svm_type", "kernel_type"}:
            out[key] = rest[0]
        elif key in {"nr_class", "total_sv", "dim"}:
            out[key] = int(rest[0])
        elif key in {"b", "threshold_recall", "threshold_precision"}:
            out[key] = float(rest[0])
        elif key in {"rho", "probA", "probB"}:
            out[key] = [float(x) for x in rest]
        elif key in {"label", "nr_sv"}:
            out[key] = [int(x) for x in rest]
        else:
            raise InvalidInput(f"unknown text in model file: {line!r}")
    raise InvalidInput("a model file without weights")


def format_binary_linear_model(model: dict) -> list[str]:
    out = [f"svm_type {model.get('svm_type', 'c_svc')}", "kernel_type linear", "nr_class 2", f"dim {len(model['w'])}", f"b {model['b']:.17g}"]
    out += [f"{k} " + " ".join(f"{x:.17g}" if isinstance(x, float) else str(x) for x in model[k]) for k in ("label", "probA", "probB") if k in model]
    return [*out, "w", *(f"{x:.17g}" for x in model["w"])]


def linear_machine_table(spark: SparkSession, model: dict, model_id: str) -> DataFrame:
    """(model_id, w, b, prob_a, prob_b, label0, label1) of one two-class linear machine."""
    a, b = model.get("probA", [None])[0], model.get("probB", [None])[0]
    row = (model_id, [float(x) for x in model["w"]], float(model.get("b", 0.0)), a, b, *model.get("label", [1, -1])[:2])
    return spark.createDataFrame([row], "model_id string, w array<double>, b double, prob_a double, prob_b double, label0 int, label1 int")


def format_linear_model(model) -> list[str]:
    d = model.w.shape[1] - (model.bias >= 0)
    k = len(model.labels) if model.labels else 2
    number = lambda x: "0" if x == 0 else f"{x:.16g}"
    out = [f"solver_type {LINEAR_SOLVERS[model.solver]}", f"nr_class {k}"]
    if model.labels:
        out.append("label " + " ".join(map(str, model.labels)))
    return [*out, f"nr_feature {d}", f"bias {number(model.bias)}", "w", *(" ".join(map(number, col)) + " " for col in model.w.T)]


def read_linear_model(spark: SparkSession, path: str):
    return parse_linear_model(_text(spark, path))


def read_machine_model(spark: SparkSession, path: str) -> dict:
    return parse_machine_model(_text(spark, path))


def write_lines(spark: SparkSession, lines: list[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)


def machine_tables(spark: SparkSession, model: dict, model_id: str, concept: str, layer: int) -> tuple[DataFrame, DataFrame]:
    """(model, sv) tables of a two-class machine over precomputed kernels; the serial number is the row id."""
    a, b = model.get("probA", [None])[0], model.get("probB", [None])[0]
    row = (model_id, concept, layer, model.get("gamma"), model["rho"][0], a, b, *model["label"][:2])
    m = spark.createDataFrame([row], "model_id string, concept string, layer int, gamma double, rho double, prob_a double, prob_b double, label0 int, label1 int")
    sv = spark.createDataFrame([(model_id, int(cells[0]), coef[0]) for coef, cells in model["sv"]], "model_id string, sv_id long, coef double")
    return m, sv
