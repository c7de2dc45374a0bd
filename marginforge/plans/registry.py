"""Registered queries of the engine and their SQL oracles.

Names carry the ids of the survey's inventory. Every query runs over its whole
tables; trained results have no SQL form and are held to optimality in the tests.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import cascade, features, kernel_join, linear, machines, metrics, partition, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.dense(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", "embedding", "label")


def _round(c, n: int = 6):
    return F.round(c, n) + 0.0


#: Digits that sums of histogram terms keep: whole units add up alike in any order and in any engine.
DIGITS = 15


# -- SQL pieces ---------------------------------------------------------------------------------------
E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS x, label FROM embeddings)"
RBF = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * -0.5"
DOT = "list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))"


def _whole(c: str) -> str:
    return f"(sum(floor({c} * 1e15 + 0.5)::BIGINT)::BIGINT::DOUBLE / 1e15)"


def _hist(name: str, table: str, id: str) -> str:
    return f"""{name}_t AS (SELECT {id} AS id, unnest(regexp_extract_all(text, '[a-z]+')) AS tok FROM {table}),
{name}_n AS (SELECT id, tok, count(*) AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT id, tok, n / sum(n) OVER (PARTITION BY id) AS val FROM {name}_n),
{name}_s AS (SELECT d.id, coalesce({_whole("val")}, 0) AS s, coalesce({_whole("val * val")}, 0) AS q, count(val) AS n FROM (SELECT {id} AS id FROM {table}) d LEFT JOIN {name} h ON d.id = h.id GROUP BY d.id)"""


# -- kernels ------------------------------------------------------------------------------------------
@query(f"WITH {E} SELECT a.id AS i, b.id AS j, round({RBF}, 6) + 0.0 AS k FROM e a, e b")
def f3_rbf_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of embeddings: -|x - y|^2 / 2."""
    d = _dense(spark, sf_dir)
    return kernel_join.dense_kernel(d, d, "rbf", kernels.rounded)


@query(f"WITH {E} SELECT a.id AS i, b.id AS j, round({DOT}, 6) + 0.0 AS k FROM e a, e b")
def f1_linear_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of embeddings: x . y."""
    d = _dense(spark, sf_dir)
    return kernel_join.dense_kernel(d, d, "linear").select("i", "j", _round("k").alias("k"))


@query(f"""WITH {E}, k AS (SELECT a.id AS i, b.id AS j, {DOT} AS dot, list_sum(list_transform(a.x, lambda v: v * v)) AS qa, list_sum(list_transform(b.x, lambda v: v * v)) AS qb FROM e a, e b)
SELECT i, j, round(dot, 6) + 0.0 AS linear, round(pow(0.5 * dot + 1, 3), 6) + 0.0 AS poly, round(exp(-0.5 * (qa + qb - 2 * dot)), 6) + 0.0 AS rbf, round(tanh(0.5 * dot + 1), 6) + 0.0 AS sigmoid FROM k""")
def f8_standard_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solver library's kernels of all pairs of embeddings."""
    d = _dense(spark, sf_dir)
    k = kernel_join.dense_kernel(d, d, "linear", squares=True)
    value = lambda n: kernels.standard_expr(n, F.col("k"), F.col("qa"), F.col("qb"), 0.5, 1.0, 3)
    return k.select("i", "j", *[_round(value(n)).alias(n) for n in ("linear", "poly", "rbf", "sigmoid")])


@query(f"""WITH {_hist("a", "documents", "doc_id")}, {_hist("b", "benchmark", "item_id")},
t AS (SELECT a.id AS i, b.id AS j, {_whole("a.val * b.val")} AS dot, {_whole("least(a.val, b.val)")} AS mn, {_whole("CASE WHEN a.val + b.val = 0 THEN 0 ELSE a.val * b.val / (a.val + b.val) END")} AS ch FROM a JOIN b ON a.tok = b.tok GROUP BY ALL)
SELECT x.id AS i, y.id AS j, round(coalesce(dot, 0), 6) + 0.0 AS linear, round(coalesce(mn, 0) / 2, 6) + 0.0 AS intersection, round(-(x.q + y.q - 2 * coalesce(dot, 0)) / 2 + 0.0, 6) + 0.0 AS rbf,
  round(CASE WHEN x.n = 0 OR y.n = 0 THEN -1.0 ELSE -(x.s + y.s - 4 * coalesce(ch, 0)) / 2 + 0.0 END, 6) + 0.0 AS chi2,
  round(CASE WHEN (x.n = 0) <> (y.n = 0) THEN -1.0 ELSE -(x.s + y.s - 4 * coalesce(ch, 0)) / 2 + 0.0 END, 6) + 0.0 AS chi2_zeros,
  round(-(x.s + y.s - 4 * coalesce(ch, 0)) / 2 + 0.0, 6) + 0.0 AS chi2_plain
FROM a_s x CROSS JOIN b_s y LEFT JOIN t ON t.i = x.id AND t.j = y.id""")
def j1_sparse_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents x benchmark: six kernels of token histograms by one equi-join on the token."""
    a, b = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    ha, hb = features.token_histogram(a, "doc_id", "text"), features.token_histogram(b, "item_id", "text")
    kinds = ["linear", "intersection", "rbf", "chi2", "chi2_zeros", "chi2_plain"]
    out = kernel_join.sparse_kernel(ha, a.select(F.col("doc_id").alias("id")), hb, b.select(F.col("item_id").alias("id")), kinds, DIGITS)
    return out.select("i", "j", *[_round(k).alias(k) for k in kinds])


_BIGRAM = """{n}_r AS (SELECT {id} AS id, unnest(regexp_extract_all(text, '[a-z][a-z]+')) AS w FROM {t}),
{n}_t AS (SELECT id, unnest(list_transform(range(1, length(w)), lambda p: substr(w, p, 2))) AS tok FROM {n}_r),
{n}_c AS (SELECT id, tok, count(*) AS n FROM {n}_t GROUP BY ALL),
{n} AS (SELECT id, tok, n / sum(n) OVER (PARTITION BY id) AS val FROM {n}_c),
{n}_s AS (SELECT d.id, coalesce({s}, 0) AS s, count(val) AS n FROM (SELECT {id} AS id FROM {t}) d LEFT JOIN {n} h ON d.id = h.id GROUP BY d.id)"""


@query(f"""WITH {_hist("a", "documents", "doc_id")}, {_hist("b", "benchmark", "item_id")}, {_BIGRAM.format(n="c", id="doc_id", t="documents", s=_whole("val"))}, {_BIGRAM.format(n="d", id="item_id", t="benchmark", s=_whole("val"))},
t1 AS (SELECT a.id AS i, b.id AS j, {_whole('a.val * b.val / (a.val + b.val)')} AS ch FROM a JOIN b ON a.tok = b.tok GROUP BY ALL),
t2 AS (SELECT c.id AS i, d.id AS j, {_whole('c.val * d.val / (c.val + d.val)')} AS ch FROM c JOIN d ON c.tok = d.tok GROUP BY ALL),
k1 AS (SELECT x.id AS i, y.id AS j, CASE WHEN x.n = 0 OR y.n = 0 THEN -1.0 ELSE -(x.s + y.s - 4 * coalesce(ch, 0)) / 2 + 0.0 END AS k FROM a_s x CROSS JOIN b_s y LEFT JOIN t1 ON t1.i = x.id AND t1.j = y.id),
k2 AS (SELECT x.id AS i, y.id AS j, CASE WHEN x.n = 0 OR y.n = 0 THEN -1.0 ELSE -(x.s + y.s - 4 * coalesce(ch, 0)) / 2 + 0.0 END AS k FROM c_s x CROSS JOIN d_s y LEFT JOIN t2 ON t2.i = x.id AND t2.j = y.id)
SELECT i, j, round(k1.k * 0.5 + k2.k * 0.5, 6) + 0.0 AS k FROM k1 JOIN k2 USING (i, j)""")
def j4_early_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the chi2 kernels of two modalities, tokens and letter pairs."""
    a, b = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text")
    ia, ib = a.select(F.col("doc_id").alias("id")), b.select(F.col("item_id").alias("id"))
    parts = [(h(a, "doc_id", "text"), h(b, "item_id", "text")) for h in (features.token_histogram, features.bigram_histogram)]
    return kernel_join.fused_sparse(parts, ia, ib, "chi2", digits=DIGITS).select("i", "j", _round("k").alias("k"))


@query(f"WITH {E} SELECT a.id AS i, list(round({RBF}, 6) + 0.0 ORDER BY b.id) AS ks FROM e a, e b GROUP BY a.id")
def j10_kernel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column-bound kernel rows of the embeddings."""
    d = _dense(spark, sf_dir)
    return kernel_join.kernel_rows(d, d, "rbf").select("i", F.transform("ks", lambda k: _round(k)).alias("ks"))


@query(f"""WITH {E}, ids AS (SELECT vec_id AS id FROM embeddings JOIN labels ON vec_id = doc_id)
SELECT a.id AS i, b.id AS j, round(exp(0.5 * ({RBF})), 6) AS k FROM e a, e b WHERE a.id IN (FROM ids) AND b.id IN (FROM ids)""")
def p1_kernel_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K[ids, ids] for the labelled ids, exponentiated."""
    d = _dense(spark, sf_dir)
    ids = d.select("id").join(_table(spark, sf_dir, "labels", "doc_id"), F.col("id") == F.col("doc_id"), "left_semi")
    k = kernel_join.projected(d, ids, "rbf")
    return k.select("i", "j", F.round(kernels.training_value(F.col("k"), 0.5), 6).alias("k"))


# -- features and reshaping ---------------------------------------------------------------------------
@query(f"WITH {_hist('a', 'documents', 'doc_id')} SELECT id, tok AS idx, round(val, 6) AS val FROM a")
def d1_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = features.token_histogram(_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return h.select("id", "idx", F.round("val", 6).alias("val"))


@query("SELECT vec_id AS id, c.label AS class, CASE WHEN e.label = c.label THEN 1 ELSE -1 END AS y FROM embeddings e, (SELECT DISTINCT label FROM embeddings) c")
def p5_one_vs_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir)
    return features.one_vs_rest(d, "label", d.select("label").distinct()).select("id", "class", "y")


@query(f"WITH {_hist('a', 'documents', 'doc_id')} SELECT tok AS idx, count(*) AS nnz, list(id ORDER BY id) AS ids FROM a GROUP BY tok")
def p14_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to columns of the token histograms, with the occupancy of each."""
    h = features.token_histogram(_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return features.transpose(h).select("idx", F.size("entries").cast("long").alias("nnz"), F.col("entries.id").alias("ids"))


@query("SELECT d.doc_id AS id, l.quality AS label FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL")
def s4_labelled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "id")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return features.labelled(ids, labels, "label")


@query("SELECT d.doc_id AS id, l.quality AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def p6_left_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "id")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    return features.left_lookup(ids, labels, "id")


@query("SELECT count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def a13_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.missing(_table(spark, sf_dir, "documents", "doc_id"), _table(spark, sf_dir, "labels", "doc_id"), "doc_id")


@query("SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY label")
def a7_class_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.class_order(_table(spark, sf_dir, "embeddings", "vec_id", "label"), "label", "vec_id")


# -- splits and sets ----------------------------------------------------------------------------------
H = "((doc_id + {s}) * 2654435761 % 4294967296)"


@query("SELECT doc_id AS id, ((row_number() OVER (ORDER BY doc_id) - 1) // 300)::INTEGER AS chunk_id FROM documents")
def k13_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 300 rows by running number."""
    return partition.chunks(_table(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "id"), "id", 300).select("id", "chunk_id")


@query(f"SELECT doc_id AS id, ({H.format(s=0)} % 8)::INTEGER AS subset FROM documents")
def r1_random_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.random_subsets(_table(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "id"), 8)


@query(f"SELECT vec_id AS id, least((row_number() OVER (ORDER BY {H.format(s=3).replace('doc_id', 'vec_id')}, vec_id) - 1) // greatest((SELECT count(*) FROM embeddings) // 7, 1), 6)::INTEGER AS subset FROM embeddings")
def r2_equal_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.equal_subsets(_table(spark, sf_dir, "embeddings", "vec_id").withColumnRenamed("vec_id", "id"), 7, seed=3)


@query(f"SELECT vec_id AS id, label, ((row_number() OVER (PARTITION BY label ORDER BY {H.format(s=0).replace('doc_id', 'vec_id')}, vec_id) - 1) * 5 // count(*) OVER (PARTITION BY label))::INTEGER AS fold FROM embeddings")
def r5_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "id")
    return partition.folds(d, 5, "label").select("id", "label", "fold")


@query(f"SELECT vec_id AS id, ((row_number() OVER (ORDER BY {H.format(s=0).replace('doc_id', 'vec_id')}, vec_id) - 1) * 10 // count(*) OVER ())::INTEGER AS fold FROM embeddings")
def r6_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.folds(_table(spark, sf_dir, "embeddings", "vec_id").withColumnRenamed("vec_id", "id"), 10).select("id", "fold")


@query("SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings")
def u1_id_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.union_ids(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))


@query("SELECT doc_id AS id FROM documents EXCEPT SELECT doc_id FROM labels")
def u2_id_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.except_ids(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query(f"""WITH leaf AS (SELECT ({H.format(s=0)} % 4)::INTEGER AS node, doc_id AS id FROM documents)
SELECT node, id FROM leaf UNION SELECT n::INTEGER, doc_id FROM labels, range(4) t(n) WHERE toxic = 1""")
def u3_feed_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    leaves = partition.random_subsets(ids, 4).withColumnRenamed("subset", "node")
    return partition.feed_back(leaves, _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")), 4)


@query(f"SELECT DISTINCT (({H.format(s=0)} % 8) // 2)::INTEGER AS node, doc_id AS id FROM documents")
def u4_merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return partition.merge_pairs(partition.random_subsets(ids, 8).withColumnRenamed("subset", "node"))


@query("""WITH h AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y, (vec_id + 0) * 2654435761 % 4294967296 AS h FROM embeddings),
u AS (SELECT id, y, (row_number() OVER w - 1)::DOUBLE / count(*) OVER (PARTITION BY y) AS u FROM h WINDOW w AS (PARTITION BY y ORDER BY h, id))
SELECT id, y, (CASE WHEN y > 0 AND u < 0.9 THEN least(floor(u / 0.9 * 3), 2) WHEN y > 0 THEN least(3 + floor((u - 0.9) / (1 - 0.9) * 3), 5)
  WHEN u < 0.9 THEN 3 + least(floor(u / 0.9 * 3), 2) ELSE least(floor((u - 0.9) / (1 - 0.9) * 3), 2) END)::INTEGER AS subset FROM u""")
def r3_unbalanced_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"))
    return partition.unbalanced_subsets(d, 6, "y").select("id", "y", "subset")


@query("SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-40 * (l_discount - 0.05) + 0.5)), 9) AS p FROM lineitem")
def f9_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    return li.select("l_orderkey", "l_linenumber", F.round(kernels.sigmoid(F.col("l_discount") - 0.05, -40.0, 0.5), 9).alias("p"))


@query("SELECT vec_id AS id, list_reverse(list_sort(list_transform(embedding, lambda x: x::DOUBLE))) AS sorted FROM embeddings")
def o2_sorted_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("id", F.sort_array("features", asc=False).alias("sorted"))


@query("SELECT o_orderkey AS id, o_totalprice AS v FROM orders ORDER BY o_orderkey LIMIT 10")
def l1_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows in order of the key."""
    from ..sources.tables import first_rows

    return first_rows(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")), "id")


# -- scoring with machines given in closed form: support vectors are all rows, coefficients +-1 / n -------
MODELS = """m AS (SELECT * FROM (VALUES ('c0.0', 'c0', 1.0, 0.0, -2.0, 0.1), ('c0.1', 'c0', 0.125, 0.05, -1.0, 0.0), ('c3.0', 'c3', 1.0, -0.02, -3.0, 0.2)) t(model_id, concept, gamma, rho, prob_a, prob_b)),
c AS (SELECT m.model_id, e.id AS sv_id, (CASE WHEN e.label = substr(m.concept, 2)::INTEGER THEN 1.0 ELSE -1.0 END) / (SELECT count(*) FROM e) AS coef FROM m, e),
dec AS (SELECT k.i AS id, m.model_id, concept, prob_a, prob_b, sum(coef * exp(gamma * k.k)) - any_value(rho) AS f FROM k JOIN c ON k.j = c.sv_id JOIN m USING (model_id) GROUP BY ALL),
prob AS (SELECT *, least(greatest(1 / (1 + exp(prob_a * f + prob_b)), 1e-7), 1 - 1e-7) AS p FROM dec)"""
KERNEL = f"{E}, k AS (SELECT a.id AS i, b.id AS j, {RBF} AS k FROM e a, e b), {MODELS}"


def _machines(spark: SparkSession, d: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = spark.sql("SELECT model_id, concept, CAST(gamma AS DOUBLE) gamma, CAST(rho AS DOUBLE) rho, CAST(prob_a AS DOUBLE) prob_a, CAST(prob_b AS DOUBLE) prob_b, 1 AS label0 FROM VALUES ('c0.0', 'c0', 1.0, 0.0, -2.0, 0.1), ('c0.1', 'c0', 0.125, 0.05, -1.0, 0.0), ('c3.0', 'c3', 1.0, -0.02, -3.0, 0.2) AS t(model_id, concept, gamma, rho, prob_a, prob_b)")
    n = d.agg(F.count("*").alias("n"))
    own = F.when(F.col("label") == F.substring("concept", 2, 9).cast("int"), 1.0).otherwise(-1.0)
    sv = d.join(F.broadcast(m.select("model_id", "concept")), F.lit(True)).crossJoin(F.broadcast(n)).select("model_id", F.col("id").alias("sv_id"), (own / F.col("n")).alias("coef"))
    return m, sv


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = _dense(spark, sf_dir)
    m, sv = _machines(spark, d)
    decided = scoring.tile_decisions(d, d, sv, m)
    return m, decided, scoring.probabilities(decided, m)


@query(f"WITH {KERNEL} SELECT id, model_id, round(f, 6) + 0.0 AS decision FROM dec")
def x1_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1].select("id", "model_id", _round("decision").alias("decision"))


@query(f"WITH {KERNEL} SELECT id, model_id, round(p, 6) AS prob FROM prob")
def x3_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[2].select("id", "model_id", F.round("prob", 6).alias("prob"))


@query(f"WITH {KERNEL} SELECT id, concept, round(avg(p), 6) AS prob FROM prob GROUP BY ALL")
def x7_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, p = _scored(spark, sf_dir)
    return scoring.ensemble_mean(p, m).select("id", "concept", F.round("prob", 6).alias("prob"))


@query(f"WITH {KERNEL}, en AS (SELECT id, concept, avg(p) AS p FROM prob GROUP BY ALL) SELECT label AS grp, concept, round(avg(p), 6) AS prob FROM en JOIN e USING (id) GROUP BY ALL")
def a6_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, p = _scored(spark, sf_dir)
    groups = _dense(spark, sf_dir).select("id", F.col("label").alias("grp"))
    return scoring.mean_pool(scoring.ensemble_mean(p, m), groups).select("grp", "concept", F.round("prob", 6).alias("prob"))


@query(f"WITH {KERNEL}, en AS (SELECT id, concept, round(avg(p), 6) AS p FROM prob GROUP BY ALL) SELECT id, concept, CASE WHEN p > 1 - p THEN 1 ELSE 0 END AS label, round(p, 6) AS p1, round(1 - p, 6) AS p0 FROM en")
def p9_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _, p = _scored(spark, sf_dir)
    en = scoring.ensemble_mean(p, m).withColumn("prob", F.round("prob", 6))
    return scoring.unpivot(en).select("id", "concept", "label", F.round("p1", 6).alias("p1"), F.round("p0", 6).alias("p0"))


@query(f"WITH {KERNEL} SELECT id, CASE WHEN sum((f > 0)::INTEGER) >= 2 THEN 0 ELSE 1 END AS winner FROM dec GROUP BY id")
def x2_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of the machines between classes 0 and 1; with three machines no ties."""
    m, decided, _ = _scored(spark, sf_dir)
    return scoring.votes(decided, m.select("model_id", F.lit(0).alias("first"), F.lit(1).alias("second")))


@query("""WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity / 50 AS a, l_extendedprice / 100000 AS b, l_discount AS c, l_tax AS d FROM lineitem)
SELECT id, model_id, round(CASE model_id WHEN 'u' THEN 0.5 * a - 0.25 * b + 2 * c - d + 0.1 ELSE -a + b + c + d - 0.2 END, 9) + 0.0 AS decision FROM r, (VALUES ('u'), ('v')) t(model_id)""")
def x5_linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two linear models over all order lines."""
    li = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, "l_discount", "l_tax").alias("features"))
    models = spark.sql("SELECT * FROM VALUES ('u', array(0.5D, -0.25D, 2D, -1D), 0.1D), ('v', array(-1D, 1D, 1D, 1D), -0.2D) AS t(model_id, w, b)")
    return scoring.linear_scores(rows, models).select("id", "model_id", _round("decision", 9).alias("decision"))


# -- metrics ------------------------------------------------------------------------------------------
@query(f"WITH {KERNEL}, s AS (SELECT c.sv_id AS id, c.coef FROM c WHERE model_id = 'c0.0') SELECT round((SELECT sum(abs(coef)) FROM s) - 0.5 * sum(a.coef * b.coef * exp(k.k)), 6) AS ld FROM k JOIN s a ON a.id = k.i JOIN s b ON b.id = k.j")
def a1_dual_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir)
    _, sv = _machines(spark, d)
    coef = sv.where("model_id = 'c0.0'").select(F.col("sv_id").alias("id"), "coef")
    k = kernel_join.dense_kernel(d, d, "rbf").select("i", "j", F.exp("k").alias("k"))
    return metrics.dual_value(k, coef).select(F.round("ld", 6).alias("ld"))


@query(f"""WITH {KERNEL}, s AS (SELECT id, round(p, 6) AS p, (label = 0)::INTEGER AS y, ((row_number() OVER (ORDER BY {H.format(s=0).replace('doc_id', 'id')}, id) - 1) * 5 // count(*) OVER ())::INTEGER AS fold FROM prob JOIN e USING (id) WHERE model_id = 'c0.0'),
r AS (SELECT fold, y, sum(y) OVER w AS tp, row_number() OVER w AS rank FROM s WINDOW w AS (PARTITION BY fold ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING))
SELECT fold, round(sum(CASE WHEN y = 1 THEN tp / rank END) / sum(y), 6) AS ap FROM r GROUP BY fold""")
def a10_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, p = _scored(spark, sf_dir)
    d = _dense(spark, sf_dir)
    rows = p.where("model_id = 'c0.0'").select("id", F.round("prob", 6).alias("prob")).join(d.select("id", (F.col("label") == 0).cast("int").alias("label")), "id")
    return metrics.average_precision(partition.folds(rows, 5), ["fold"]).select("fold", F.round("ap", 6).alias("ap"))


@query("SELECT round(avg((l_extendedprice - 1500 * l_quantity) * (l_extendedprice - 1500 * l_quantity)), 2) AS mse, round(pow(corr(1500 * l_quantity, l_extendedprice), 2), 6) AS r2 FROM lineitem")
def a11_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice").select((1500 * F.col("l_quantity")).alias("prediction"), F.col("l_extendedprice").alias("label"))
    return metrics.regression(li).select(F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2"))


@query("""WITH r AS (SELECT l_extendedprice - 1500 * l_quantity AS r FROM lineitem), m AS (SELECT avg(abs(r)) AS mae FROM r)
SELECT round(avg(abs(r)), 4) AS sigma FROM r, m WHERE abs(r) <= 5 * sqrt(2 * mae * mae)""")
def a12_laplace_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice")
    return metrics.laplace_scale(li.select((F.col("l_extendedprice") - 1500 * F.col("l_quantity")).alias("residual"))).select(F.round("sigma", 4).alias("sigma"))


# -- training: no SQL form; the rows carry what optimality can be checked by --------------------------
@query()
def c1_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of multi-level training, class 0 against the rest: (pass, layer, node, n_rows, n_sv, ld, gap)."""
    rows = _dense(spark, sf_dir).withColumn("label", F.when(F.col("label") == 0, 1).otherwise(-1))
    model = cascade.fit(rows, cascade.CascadeParameter(subsets=4, gamma=1.0, passes=3))
    return spark.createDataFrame([tuple(n[k] for k in ("pass", "layer", "node", "n_rows", "n_sv", "ld", "gap")) for n in model.nodes], "pass int, layer int, node int, n_rows long, n_sv long, ld double, gap double")


@query()
def t13_multi_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-one machines of all labels, predictions on the training rows."""
    d = _dense(spark, sf_dir)
    return d.select("id", "label").join(machines.predict(d, machines.one_vs_one(d), d), "id")


@query("""WITH c AS (SELECT DISTINCT label FROM embeddings WHERE label < 3)
SELECT vec_id AS id, (SELECT count(*) FROM c) AS classes, 1.0 AS total FROM embeddings WHERE label < 3""")
def t15_class_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupled probabilities of three classes, which add up to 1 in every row."""
    d = _dense(spark, sf_dir).where("label < 3")
    got = machines.probabilities(d, machines.one_vs_one(d, probability=True), d)
    return got.select("id", F.size("probs").cast("long").alias("classes"), F.round(F.aggregate("probs", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id AS id, true AS feasible FROM embeddings")
def t10_one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each row keeps its side of a one-class machine: multipliers in the box, on the box only outside, 0 only inside, and of the right sum."""
    d = _dense(spark, sf_dir)
    m = machines.one_class(d, 0.2)
    n = d.agg(F.count("*").alias("n"))
    total = m.support.agg(F.sum("coef").alias("total"))
    at = machines.decide(d, m, d).join(m.support.select("id", "coef"), "id", "left").na.fill(0.0, ["coef"]).crossJoin(n).crossJoin(total)
    f, a = F.col("decision"), F.col("coef")
    fine = (a >= 0) & (a <= 1) & ((a > 0) | (f > -2e-3)) & ((a < 1) | (f < 2e-3)) & (F.abs(F.col("total") - 0.2 * F.col("n")) < 1e-6)
    return at.select("id", fine.alias("feasible"))


@query("SELECT vec_id AS id, true AS feasible FROM embeddings")
def t11_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each row meets the conditions of a tube regression of its label: 0 inside the tube, at the box beyond it."""
    d = _dense(spark, sf_dir)
    m = machines.regression(d)
    at = machines.decide(d, m, d).join(m.support.select("id", "coef"), "id", "left").na.fill(0.0, ["coef"]).join(d.select("id", "label"), "id")
    off, a = F.col("label") - F.col("decision"), F.col("coef")
    fine = (F.abs(a) <= 1) & ((a != 0) | (F.abs(off) <= 0.1 + 2e-3)) & ((F.abs(a) < 1) | (off * F.signum(a) >= 0.1 - 2e-3)) & ((a == 0) | (F.abs(a) == 1) | (F.abs(F.abs(off) - 0.1) <= 2e-3))
    return at.select("id", fine.alias("feasible"))


def _optimal(solver: int):
    """Whether the conditions of a minimum hold at each weight row that a smooth solver finds.

    Losses' slopes and their sums over the rows are recomputed from weights and
    features by plain column expressions, apart from the solver's code.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _dense(spark, sf_dir)
        parameter = linear.Parameter(solver)
        if solver in linear.PRIMAL:
            model = linear.train_sparse(linear.as_sparse(d), parameter, 64, bias=1.0, tol=1e-8)
        else:
            model = linear.train(d, parameter, bias=1.0, tol=1e-9)
        loss, penalty, _ = linear.SOLVERS[solver]
        names = model.labels or [0]
        w = spark.createDataFrame([(c, row.tolist()) for c, row in zip(names, model.w, strict=True)], "class int, w array<double>")
        rows = d.select("label", F.array_append("features", F.lit(1.0)).alias("x")).join(F.broadcast(w), F.lit(True))
        z = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        y = F.when(F.col("label") == F.col("class"), 1.0).otherwise(-1.0)
        if loss == "logistic":
            slope = -y / (1 + F.exp(y * z))
        elif loss == "squared_hinge":
            slope = -2 * y * F.greatest(1 - y * z, F.lit(0.0))
        else:
            off = z - F.col("label")
            slope = 2 * F.signum(off) * F.greatest(F.abs(off) - parameter.p, F.lit(0.0))
        sums = rows.select("class", F.posexplode(F.transform("x", lambda v: v * slope)).alias("k", "g")).groupBy("class", "k").agg(F.sum("g").alias("g"))
        at = sums.join(w.select("class", F.posexplode("w").alias("k", "w")), ["class", "k"])
        if penalty == "l2":
            off = F.abs(F.col("w") + F.col("g"))
        else:
            off = F.when(F.col("w") != 0, F.abs(F.col("g") + F.signum("w"))).otherwise(F.greatest(F.abs("g") - 1, F.lit(0.0)))
        return at.groupBy("class").agg(F.count("*").alias("weights"), (F.max(off) < 1e-3).alias("optimal"))

    run.__name__ = f"y{solver}_linear"
    run.__doc__ = f"The conditions of a minimum at the weights of linear solver {solver}, one row a class."
    return run


def _linear(solver: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = _dense(spark, sf_dir)
        if solver >= 11:
            d = d.withColumn("label", F.col("label").cast("double"))
        model = linear.train(d, linear.Parameter(solver), bias=1.0)
        return linear.predict(d, model).select("id", "label", "prediction")

    run.__name__ = f"y{solver}_linear"
    run.__doc__ = f"Predictions of linear solver {solver} on its training rows."
    return run


for _k in (0, 1, 2, 5, 6, 7):
    query("SELECT DISTINCT label AS class, 65::BIGINT AS weights, true AS optimal FROM embeddings")(_optimal(_k))
for _k in (11, 12):
    query("SELECT 0 AS class, 65::BIGINT AS weights, true AS optimal")(_optimal(_k))
for _k in (3, 4, 13):
    query()(_linear(_k))


@query()
def y23_cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of 5-fold cross validation of logistic regression."""
    out = linear.cross_validate(_dense(spark, sf_dir), linear.Parameter(0), 5, 1.0)
    return metrics.accuracy(out)


@query("""WITH n AS (SELECT o_orderkey % 7 AS pass, o_totalprice / 1000 - 200 AS ld FROM orders)
SELECT pass::INTEGER AS pass, round(greatest(0.0, max(ld)), 6) AS ld FROM n GROUP BY pass""")
def a3_pass_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest dual value of a pass, at least 0, of values read off the orders."""
    nodes = _table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select((F.col("o_orderkey") % 7).cast("int").alias("pass"), (F.col("o_totalprice") / 1000 - 200).alias("ld"))
    return metrics.pass_value(nodes).select("pass", F.round("ld", 6).alias("ld"))


@query(f"WITH {_hist('a', 'documents', 'doc_id')} SELECT tok AS idx, count(*) AS nnz FROM a GROUP BY tok")
def a8_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = features.token_histogram(_table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return features.occupancy(h)


_AP = f"""s AS (SELECT id, round(p, 6) AS p, (label = 0)::INTEGER AS y, ((row_number() OVER (ORDER BY {H.format(s=0).replace('doc_id', 'id')}, id) - 1) * 5 // count(*) OVER ())::INTEGER AS fold FROM prob JOIN e USING (id) WHERE model_id = 'c0.0'),
r AS (SELECT fold, y, sum(y) OVER w AS tp, row_number() OVER w AS rank FROM s WINDOW w AS (PARTITION BY fold ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT fold, sum(CASE WHEN y = 1 THEN tp / rank END) / sum(y) AS ap FROM r GROUP BY fold)"""


@query(f"WITH {KERNEL}, {_AP} SELECT round(avg(ap), 6) AS map FROM ap")
def a9_mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, p = _scored(spark, sf_dir)
    rows = p.where("model_id = 'c0.0'").select("id", F.round("prob", 6).alias("prob")).join(_dense(spark, sf_dir).select("id", (F.col("label") == 0).cast("int").alias("label")), "id")
    return metrics.mean_average_precision(partition.folds(rows, 5)).select(F.round("map", 6).alias("map"))


_ITEMS = """r AS (SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity / 50 AS a, l_extendedprice / 100000 AS b, l_discount AS c, l_tax AS d FROM lineitem),
z AS (SELECT id, 0.5 * a - 0.25 * b + 2 * c - d + 0.1 * 2.0 AS z0, -a + b + c + d - 0.2 * 2.0 AS z1, 0.3 * a + 0.1 * c + 0.05 * 2.0 AS z2 FROM r)"""


def _item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.array(F.col("l_quantity") / 50, F.col("l_extendedprice") / 100000, "l_discount", "l_tax").alias("features"))


def _item_model(solver: int) -> linear.Model:
    return linear.Model(np.array([[0.5, -0.25, 2.0, -1.0, 0.1], [-1.0, 1.0, 1.0, 1.0, -0.2], [0.3, 0.0, 0.1, 0.0, 0.05]]), [7, 3, 5], solver, 2.0)


@query(f"WITH {_ITEMS} SELECT id, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 7 WHEN z1 >= z2 THEN 3 ELSE 5 END AS prediction FROM z")
def y21_linear_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all order lines under a given linear model of three classes with a bias feature of 2."""
    return linear.predict(_item_rows(spark, sf_dir), _item_model(2)).select("id", "prediction")


@query(f"""WITH {_ITEMS}, s AS (SELECT id, 1 / (1 + exp(-z0)) AS a, 1 / (1 + exp(-z1)) AS b, 1 / (1 + exp(-z2)) AS c FROM z)
SELECT id, round(a / (a + b + c), 9) AS p0, round(b / (a + b + c), 9) AS p1, round(c / (a + b + c), 9) AS p2 FROM s""")
def f11_linear_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised sigmoids of the same model read as a logistic one."""
    out = linear.predict(_item_rows(spark, sf_dir), _item_model(0), True)
    return out.select("id", *[F.round(F.col("probabilities")[k], 9).alias(f"p{k}") for k in range(3)])


@query("SELECT o_orderkey AS id, ((o_orderkey % 5)::INTEGER) AS block, row_number() OVER (ORDER BY o_orderkey % 5, o_orderkey) - 1 AS position FROM orders")
def o4_row_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bound in order of (block, row), without a gap in the block numbers."""
    parts = _table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5).cast("int").alias("block"))
    return scoring.row_bind(parts, "block", "id").select("id", "block", F.col("position").cast("long").alias("position"))


@query("""SELECT vec_id AS id, 1 AS concepts, true AS calibrated FROM embeddings""")
def c9_cascade_to_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From multi-level training to probabilities: class 0 against the rest, calibrated, every embedding scored by the trained tables."""
    d = _dense(spark, sf_dir).withColumn("label", F.when(F.col("label") == 0, 1).otherwise(-1))
    model = cascade.fit(d, cascade.CascadeParameter(subsets=4, gamma=1.0, passes=2, probability=True))
    models, sv = model.tables("c0.0", "c0")
    prob = scoring.ensemble_mean(scoring.probabilities(scoring.tile_decisions(d, d, sv, models), models), models)
    return prob.groupBy("id").agg(F.count("*").cast("int").alias("concepts"), F.min((F.col("prob") > 0) & (F.col("prob") < 1)).alias("calibrated"))


@query(f"WITH {KERNEL} SELECT id, round(p, 6) AS prob FROM prob WHERE model_id = 'c0.0'")
def x9_stream_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine c0.0 over the embeddings by the streaming scorer, all files at once."""
    from ..sources.scratch import fresh_path
    from ..streaming import scorer

    d = _dense(spark, sf_dir)
    _, sv = _machines(spark, d)
    sv = sv.where("model_id = 'c0.0'").join(d.select(F.col("id").alias("sv_id"), "features"), "sv_id").select(F.col("sv_id").alias("id"), "features", "coef")
    where = fresh_path(spark, "stream")
    d.select("id", "features").write.parquet(f"{where}/in")
    q = scorer.start(spark, f"{where}/in", "id long, features array<double>", f"{where}/out", f"{where}/checkpoint", sv, 0.0, 1.0, prob_a=-2.0, prob_b=0.1)
    q.awaitTermination()
    return spark.read.parquet(f"{where}/out").select("id", F.round("prob", 6).alias("prob"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-1 probability of every embedding under an ensemble of kernel machines."""
    return x7_ensemble(spark, sf_dir)
