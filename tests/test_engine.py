"""The engine's operators: SQL oracles, optimality of solvers, format round trips."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marginforge.functions import kernels, linear as L, smo
from marginforge import cli
from marginforge.operators import cascade, features, kernel_join, linear, machines, metrics, partition, scoring
from marginforge.plans import registry
from marginforge.sources import formats, tables
from marginforge.streaming import scorer


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, same, sf, name):
    same(registry.QUERIES[name](spark, sf), registry.ORACLES[name])


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(registry.QUERIES)


# -- kernels ----------------------------------------------------------------------------------------
def sparse(spark, rows):
    return spark.createDataFrame([(i, k, float(v)) for i, r in rows.items() for k, v in r.items()], "id long, idx int, val double"), spark.createDataFrame([(i,) for i in rows], "id long")


def test_sparse_kernel_values(spark):
    a, ia = sparse(spark, {1: {0: 1, 2: 2}, 2: {}})
    b, ib = sparse(spark, {5: {0: 3, 1: 1}, 6: {}})
    kinds = ["linear", "intersection", "rbf", "chi2", "chi2_zeros"]
    got = {(r.i, r.j): tuple(r[k] for k in kinds) for r in kernel_join.sparse_kernel(a, ia, b, ib, kinds).collect()}
    assert got[1, 5] == (3, 0.5, -4.5, -2, -2)
    assert got[2, 5][3:] == (-1, -1) and got[2, 6][3:] == (-1, 0) and got[2, 6][0] == 0


def test_dense_equals_direct(spark):
    x = np.random.default_rng(0).random((40, 5))
    x[7] = x[3]
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    got = {(r.i, r.j): r.k for r in kernel_join.dense_kernel(d, d, "rbf").collect()}
    assert len(got) == 1600 and got[3, 7] == 0
    for i in range(40):
        for j in range(40):
            assert abs(got[i, j] + ((x[i] - x[j]) ** 2).sum() / 2) < 1e-12
    chi = kernels.DENSE["chi2"](x, x)
    assert abs(chi[0, 1] + ((x[0] - x[1]) ** 2 / (x[0] + x[1])).sum() / 2) < 1e-12


def test_user_kernel(spark):
    kernels.dense_kernel("cosine_test", lambda a, b: a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1))
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0])], "id long, features array<double>")
    got = {(r.i, r.j): r.k for r in kernel_join.dense_kernel(d, d, "cosine_test").collect()}
    assert abs(got[1, 2] - 0.96) < 1e-12


def test_dense_pairs_are_never_shuffled(spark):
    x = np.random.default_rng(0).random((90, 5))
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    ids = d.where("id % 3 = 0").select("id")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for df in (kernel_join.dense_kernel(d, d, "linear", squares=True), kernel_join.kernel_rows(d, d, "rbf"), kernel_join.projected(d, ids, "rbf")):
        top, met, _ = plan(df).partition("Join Cross")
        assert met and "MapInPandas" in top and not any(w in top for w in ("Repartition", "Aggregate", "Join"))
    got = kernel_join.dense_kernel(d, d, "linear", squares=True).where("i = 4 and j = 9").head()
    assert (got.k, got.qa, got.qb) == pytest.approx((x[4] @ x[9], x[4] @ x[4], x[9] @ x[9]))
    assert {(r.i, r.j) for r in kernel_join.projected(d, ids, "rbf").collect()} == {(i, j) for i in range(0, 90, 3) for j in range(0, 90, 3)}


def test_pairs_of_rows_with_themselves_are_computed_once_and_written_in_half(spark, tmp_path):
    x = np.random.default_rng(2).normal(size=(2_600, 6)) / 2.5
    names = [min(i, 2_597) for i in range(2_600)]  # three rows share the last id
    d = spark.createDataFrame([(i, r.tolist()) for i, r in zip(names, x)], "id long, features array<double>")
    kernel_join.dense_kernel(d, d, "rbf", kernels.rounded).write.parquet(str(tmp_path / "k"))
    assert sum(p.stat().st_size for p in (tmp_path / "k").glob("*.parquet")) < 6.5 * 2_600**2
    got, whole = np.zeros((2_598, 2_598)), kernels.rounded(kernels.DENSE["rbf"](x, x))
    pairs = pd.read_parquet(tmp_path / "k")
    assert len(pairs) == 2_600**2 and len(pairs.drop_duplicates(["i", "j"])) == 2_598**2
    got[pairs["i"], pairs["j"]] = pairs["k"]
    assert np.abs(got - whole[:2_598, :2_598])[:2_597, :2_597].max() < 2e-6 and len(pairs[pairs["i"] == 2_597]) == 3 * 2_600
    both = kernel_join.dense_kernel(d, d, "linear", squares=True).where("i < 2597 and j < 2597 and (i % 97 = 0 or j % 89 = 0)").toPandas()
    i, j, q = both["i"], both["j"], (x * x).sum(1)
    assert np.abs(both["k"] - (x[i] * x[j]).sum(1)).max() < 1e-12 and np.abs(both["qa"] - q[i]).max() < 1e-12 and np.abs(both["qb"] - q[j]).max() < 1e-12


def test_kernels_that_are_not_symmetric_meet_in_both_orders(spark):
    kernels.dense_kernel("first_test", lambda a, b: a[:, :1] + 2 * b[:, 0])
    d = spark.createDataFrame([(i, [float(i)]) for i in range(1_100)], "id long, features array<double>")
    k = kernel_join.dense_kernel(d, d, "first_test")
    assert k.count() == 1_100**2 and k.where("k <> i + 2 * j").isEmpty()


def test_sums_of_tiles_give_a_task_few_pairs_of_blocks(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(6_000, 64)) / 8
    d = spark.createDataFrame(pd.DataFrame({"id": np.arange(6_000), "features": list(x.tolist())}), "id long, features array<double>").persist()
    monkeypatch.setattr(kernel_join, "PAIR_BYTES", 4 << 20, raising=False)
    sums = kernel_join.tile_sums(d, d, lambda a, b: a @ b.sum(0)[:, None])
    assert sums.rdd.getNumPartitions() >= 12  # 4 before: each sent a quarter of all pairs of blocks through one worker's buffers
    got = sums.select("id", F.col("s")[0].alias("s")).groupBy("id").agg(F.sum("s").alias("s")).orderBy("id").toPandas()
    assert len(got) == 6_000 and np.abs(got["s"] - x @ x.sum(0)).max() < 1e-9
    none = kernel_join.tile_sums(d, d.where("id < 0"), lambda a, b: a @ b.T)
    assert none.isEmpty()
    d.unpersist()


def test_rounding_of_tiles():
    k = np.array([0.5e-6, -0.5e-6, 1.4999e-6, -2e-7, -1.0, 3.25, 1e300, 5e303, np.nan, np.inf])
    got = kernels.rounded(k)
    assert got[:-2].tolist() == [1e-6, -1e-6, 1e-6, 0.0, -1.0, 3.25, 1e300, 5e303] and np.isnan(got[-2]) and got[-1] == np.inf
    assert np.signbit(got[3]) == False and kernels.rounded(np.array([2.0**52 + 1]), 0)[0] == 2.0**52 + 1  # noqa: E712


def test_kernel_rows_of_many_blocks_and_shared_ids(spark, monkeypatch):
    x = np.random.default_rng(1).random((1100, 3))
    names = [min(i, 1097) for i in range(1100)]  # three rows share the last id
    d = spark.createDataFrame([(i, r.tolist()) for i, r in zip(names, x)], "id long, features array<double>")
    monkeypatch.setattr(kernel_join, "ROW_BYTES", 1 << 20)
    monkeypatch.setattr(kernel_join, "PART_BLOCKS", 1)
    new = {r.i: (r.js, r.ks) for r in kernel_join.kernel_rows(d, d, "linear").collect()}
    old = {r.i: (r.js, r.ks) for r in kernel_join.rows_of(kernel_join.dense_kernel(d, d, "linear")).collect()}
    assert len(new) == 1098 and len(new[1097][0]) == 3300
    for i in (0, 500, 1096, 1097):
        assert new[i][0] == old[i][0] and new[i][1] == pytest.approx(old[i][1])


def test_sigmoid_extremes(spark):
    r = spark.range(1).select(kernels.sigmoid(F.lit(1000.0), 1.0, 0.0).alias("a"), kernels.sigmoid(F.lit(-1000.0), 1.0, 0.0).alias("b")).head()
    assert r.a == 0 and r.b == 1


def test_transpose_fixture(spark):
    rows = {1: {2: 1, 4: 1}, 2: {1: 1}, 3: {3: 1}, 4: {2: 2, 3: 1, 4: 1}}
    got = {r.idx: [(e.id, e.val) for e in r.entries] for r in features.transpose(sparse(spark, rows)[0]).collect()}
    assert got == {1: [(2, 1)], 2: [(1, 1), (4, 2)], 3: [(3, 1), (4, 1)], 4: [(1, 1), (4, 1)]}


# -- kernel machines --------------------------------------------------------------------------------
def gauss(n=120, seed=3):
    rng = np.random.default_rng(seed)
    a = rng.multivariate_normal([2, 3], [[2, 1.5], [1.5, 3]], n)
    b = rng.multivariate_normal([1, 7], [[2, 1.5], [1.5, 4]], n)
    return np.vstack([a, b]), np.concatenate([np.ones(n), -np.ones(n)])


def violation(K, y, s, C, p):
    """Largest violated pair at s.alpha."""
    v = -y * (p + y * (K @ (s.alpha * y)))
    up = np.where(y > 0, s.alpha < C, s.alpha > 0)
    down = np.where(y > 0, s.alpha > 0, s.alpha < C)
    return v[up].max() - v[down].min()


@pytest.mark.parametrize("kind", ["linear", "rbf"])
def test_c_svc_is_optimal(kind):
    x, y = gauss()
    K = kernels.standard(kind, 0.5)(x, x)
    s = smo.c_svc(K, y, 1.0, 1e-5)
    assert abs(s.alpha @ y) < 1e-9 and (s.alpha >= 0).all() and (s.alpha <= 1).all()
    assert violation(K, y, s, 1.0, -np.ones(len(y))) < 1e-5
    f = K @ (s.alpha * y) - s.rho
    primal = 0.5 * (s.alpha * y) @ K @ (s.alpha * y) + np.maximum(0, 1 - y * f).sum()
    assert abs(primal - smo.dual_value(K, s.alpha * y)) < 1e-2 * primal


def test_class_weights_and_nu():
    x, y = gauss()
    K = kernels.standard("rbf", 0.5)(x, x)
    c = np.where(y > 0, 2.0, 0.5)
    s = smo.c_svc(K, y, c, 1e-5)
    assert (s.alpha <= c + 1e-12).all()
    n = smo.nu_svc(K, y, 0.3, 1e-6)
    f = K @ (n.alpha * y) - n.rho
    assert (np.sign(f) == y).mean() > 0.8
    again = smo.c_svc(K, y, 1 / n.r, 1e-6)  # the two forms meet at C = 1 / r
    assert np.abs(K @ (again.alpha * y) - again.rho - f).max() < 1e-2
    with pytest.raises(ValueError):
        smo.nu_svc(K, np.append(np.ones(230), -np.ones(10)), 0.9)


def test_one_class_and_regression():
    x, _ = gauss()
    K = kernels.standard("rbf", 0.2)(x, x)
    s = smo.one_class(K, 0.2, 1e-6)
    assert abs(s.alpha.sum() - 0.2 * len(x)) < 1e-9
    assert abs((K @ s.alpha - s.rho < -1e-6).mean() - 0.2) < 0.05
    t = np.linspace(0, 6, 80)
    z = np.sin(t)
    K = kernels.standard("rbf", 1.0)(t[:, None], t[:, None])
    e = smo.epsilon_svr(K, z, 10.0, 0.05, 1e-6)
    assert abs(e.alpha.sum()) < 1e-9 and np.abs(K @ e.alpha - e.rho - z).max() < 0.06
    n = smo.nu_svr(K, z, 10.0, 0.3, 1e-6)
    assert abs(n.alpha.sum()) < 1e-9 and np.abs(K @ n.alpha - n.rho - z).max() < 0.1


def test_working_sets_reach_the_same_minimum(monkeypatch):
    x, y = gauss()
    z = np.sin(x[:, 0])
    monkeypatch.setattr(smo, "FULL", 100)
    monkeypatch.setattr(smo, "WORKING", 32)
    monkeypatch.setattr(smo, "BLOCK", 500)
    f = kernels.standard("rbf", 0.3)
    held, lazy = f(x, x), smo.gram(f, x)
    assert isinstance(lazy, smo.Gram) and len(lazy) == 240 and isinstance(smo.gram(f, x[:100]), np.ndarray)
    c = np.where(y > 0, 2.0, 0.5)
    for how in (lambda K: smo.c_svc(K, y, c, 1e-6), lambda K: smo.nu_svc(K, y, 0.3, 1e-6), lambda K: smo.one_class(K, 0.2, 1e-6), lambda K: smo.epsilon_svr(K, z, 3.0, 0.05, 1e-6)):
        one, two = how(held), how(lazy)
        assert two.gap < 1e-6 and two.objective == pytest.approx(one.objective, abs=1e-4, rel=1e-6) and two.rho == pytest.approx(one.rho, abs=1e-4)
    assert np.abs(smo.cross_decisions(held, y, 1.0, 5, 1e-6) - smo.cross_decisions(lazy, y, 1.0, 5, 1e-6)).max() < 1e-3


@pytest.fixture(scope="module")
def many(spark):
    """21,000 rows, more than a kernel matrix in one worker was allowed, in two clouds."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(21_000, 2)) + np.repeat([[0.0, 0.0], [12.0, 0.0]], 10_500, axis=0)
    rows = spark.createDataFrame(pd.DataFrame({"id": np.arange(21_000), "features": list(x.tolist()), "label": np.repeat([1, -1], 10_500)}), "id long, features array<double>, label int")
    return rows.repartition(4).persist()


def test_machines_of_many_rows(spark, many):
    m = machines.one_class(many, 0.002, ("rbf", 0.01))
    total, least, most = m.support.agg(F.sum("coef"), F.min("coef"), F.max("coef")).head()
    assert total == pytest.approx(42) and 0 <= least and most <= 1
    assert abs(machines.decide(many, m, many).where("decision < -1e-3").count() - 42) < 15
    pair = machines.one_vs_one(many, kernel=("linear",), probability=True)
    got = machines.predict(many, pair, many).join(many, "id")
    assert got.count() == 21_000 and got.where("prediction <> label").isEmpty()
    p = machines.probabilities(many, pair, many).select(F.col("probs")[0].alias("p")).agg(F.min("p"), F.max("p")).head()
    assert p[0] < 0.1 and p[1] > 0.9
    m = machines.regression(many, p=0.5, kernel=("linear",))
    off = machines.decide(many, m, many).join(many, "id").join(m.support.select("id", "coef"), "id", "left").where("abs(label - decision) > 0.502 and coalesce(abs(coef), 0) < 1")
    assert off.isEmpty()


def test_lazy_rbf_values_are_one_product_and_one_exp():
    x, _ = gauss()
    f = kernels.standard("rbf", 0.3)
    lazy, rows = smo.Gram(f, x), np.arange(5, 50)
    assert lazy.sides is not None and np.abs(lazy.values(rows, rows) - f(x[rows], x[rows])).max() < 1e-12
    assert np.abs(f.quick(x, x[:7]) - f(x, x[:7])).max() < 1e-12
    far = np.concatenate([x * 1e6, x * 1e6 + 1e-3])  # products of these lose what tells them apart
    assert smo.Gram(f, far).sides is None and (f.quick(far, far) == f(far, far)).all()


def test_folds_of_a_large_problem_are_tasks_of_their_own(spark, monkeypatch):
    x, y = gauss()
    rows = spark.createDataFrame([(k, v.tolist(), int(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, features array<double>, label int")
    seen = []
    real = machines.calibrated
    monkeypatch.setattr(machines, "calibrated", lambda d, key: seen.append(key) or real(d, key))
    whole = machines.one_vs_one(rows, kernel=("rbf", 0.3), probability=True).support.orderBy("id").toPandas()
    assert not seen
    monkeypatch.setattr(smo, "FULL", 100)
    apart = machines.one_vs_one(rows, kernel=("rbf", 0.3), probability=True).support.orderBy("id").toPandas()
    assert seen == ["problem"]
    pd.testing.assert_frame_equal(whole, apart)


def test_cascade_calibrates_a_large_top_node_once_by_folds(spark, monkeypatch):
    x, y = gauss()
    rows = spark.createDataFrame([(k, v.tolist(), int(t)) for k, (v, t) in enumerate(zip(x, y))], "id long, features array<double>, label int")
    made, real = [], cascade.calibration
    monkeypatch.setattr(cascade, "calibration", lambda *a: made.append(real(*a)) or made[-1])
    p = cascade.CascadeParameter(subsets=2, passes=2, gamma=0.3, epsilon=0.0, probability=True)
    whole = cascade.fit(rows, p)
    assert not made
    monkeypatch.setattr(smo, "FULL", 20)
    apart = cascade.fit(rows, p)
    assert made == [(apart.prob_a, apart.prob_b)]
    assert (apart.prob_a, apart.prob_b) == pytest.approx((whole.prob_a, whole.prob_b))


def test_cascade_of_large_nodes(spark, many):
    model = cascade.fit(many, cascade.CascadeParameter(subsets=1, passes=1, gamma=0.01, probability=True))
    node = model.nodes[0]
    assert node["n_rows"] == 21_000 and node["gap"] < 1e-3 and node["ld"] > 0 and model.prob_a < 0
    sv = model.support.join(many, "id").select("id", "features", "coef")
    f = scoring.dense_decisions(many, sv, model.rho, 0.01).join(many, "id")
    assert f.where("decision * label <= 0").isEmpty()


def test_platt_and_coupling():
    rng = np.random.default_rng(1)
    f = rng.normal(size=4000)
    y = np.where(rng.random(4000) < 1 / (1 + np.exp(-2 * f + 0.3)), 1, -1)
    A, B = smo.platt(f, y)
    assert abs(A + 2) < 0.2 and abs(B - 0.3) < 0.2
    p = np.array([0.5, 0.3, 0.2])
    r = p[:, None] / (p[:, None] + p)
    np.fill_diagonal(r, 0)
    assert np.abs(smo.couple(r) - p).max() < 1e-9


def test_multi_class_machine():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.5, (30, 2)) for c in ([0, 0], [3, 0], [0, 3])])
    labels = np.repeat([4, 1, 9], 30)
    K = kernels.standard("rbf", 0.5)(x, x)
    m = smo.one_vs_one(K, labels, 1.0, probability=True)
    assert m.classes == [4, 1, 9] and (m.predict(K) == labels).mean() > 0.95
    p = m.probabilities(K)
    assert np.abs(p.sum(1) - 1).max() < 1e-9 and (np.array(m.classes)[p.argmax(1)] == labels).mean() > 0.95


@pytest.mark.parametrize("n", [1, 3, 4])
def test_cascade_reaches_the_single_machine(spark, n):
    x, y = gauss(60)
    rows = spark.createDataFrame([(i, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, features array<double>, label int")
    p = cascade.CascadeParameter(subsets=n, gamma=1.0, passes=6, tolerance=1e-4, epsilon=1e-5)
    model, single = cascade.fit(rows, p), cascade.fit_single(rows, p)
    best, got = single.nodes[-1]["ld"], max(k["ld"] for k in model.nodes)
    assert got <= best * (1 + 1e-3) and got >= best * (1 - 1e-3)
    assert all(k["gap"] < 1e-4 for k in model.nodes)
    sv = model.support.join(rows, "id").select("id", "features", "coef")
    f = {r.id: r.decision for r in scoring.dense_decisions(rows, sv, model.rho, 1.0).collect()}
    K = cascade.kernel_values(x, x, p)
    s = smo.c_svc(K, y, 1.0, 1e-4)
    assert max(abs(f[i] - v) for i, v in enumerate(K @ (s.alpha * y) - s.rho)) < 0.05


def test_one_class_subset_passes_its_ids_up(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i % 3)], 1 if i < 10 else -1) for i in range(20)], "id long, features array<double>, label int")
    split = rows.select("id", (F.col("id") / 10).cast("int").alias("subset"))
    model = cascade.fit(rows, cascade.CascadeParameter(subsets=2, passes=2, gamma=0.1), split)
    assert model.nodes[0]["n_sv"] == 10 and model.nodes[2]["ld"] > 0


def test_calibrated_cascade_scores_end_to_end(spark, tmp_path):
    x, y = gauss(60)
    rows = spark.createDataFrame([(i, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, features array<double>, label int")
    p = cascade.CascadeParameter(subsets=3, gamma=1.0, passes=2, tolerance=1e-4, probability=True)
    model = cascade.fit(rows, p)
    assert model.prob_a is not None and model.prob_a < 0
    given = cascade.fit(rows.select("id", "label"), p, kernel=kernel_join.dense_kernel(rows, rows, "rbf"))
    assert given.rho == pytest.approx(model.rho) and given.prob_a == pytest.approx(model.prob_a)
    assert [n["ld"] for n in given.nodes] == pytest.approx([n["ld"] for n in model.nodes])
    models, sv = model.tables("c.0", "c", 0)
    more, sv2 = model.tables("c.1", "c", 1)
    models, sv = models.union(more), sv.union(sv2)
    prob = {r.id: r.prob for r in scorer.score_ensemble(rows, rows, sv, models).collect()}
    assert np.mean([(prob[i] > 0.5) == (v > 0) for i, v in enumerate(y)]) > 0.85 and min(prob.values()) > 0
    one = {r.id: r.decision for r in scoring.tile_decisions(rows, rows, sv, models).where("model_id = 'c.0'").collect()}
    long = {r.id: r.decision for r in scoring.decisions(kernel_join.dense_kernel(rows, rows, "rbf"), sv, models).where("model_id = 'c.0'").collect()}
    assert one == pytest.approx(long)
    rows.select("id", "features").write.parquet(str(tmp_path / "in"))
    q = scorer.start_ensemble(spark, str(tmp_path / "in"), "id long, features array<double>", str(tmp_path / "out"), str(tmp_path / "ck"), rows, sv, models)
    q.awaitTermination()
    assert {r.id: r.prob for r in spark.read.parquet(str(tmp_path / "out")).collect()} == pytest.approx(prob)
    tables.write_machines(models, sv, str(tmp_path / "m"))
    rows.select("id", "features").write.parquet(str(tmp_path / "v"))
    cli.score(spark, [str(tmp_path / "v"), str(tmp_path / "v"), str(tmp_path / "m"), str(tmp_path / "s")])
    assert {r.id: r.prob for r in spark.read.parquet(str(tmp_path / "s")).collect()} == pytest.approx(prob)
    cli.kernel(spark, ["-t", "linear", str(tmp_path / "v"), str(tmp_path / "v"), str(tmp_path / "k")])
    cli.fuse(spark, [str(tmp_path / "f"), str(tmp_path / "k"), str(tmp_path / "k")])
    assert spark.read.parquet(str(tmp_path / "f")).where("i = 3 and j = 5").head().k == pytest.approx(float(x[3] @ x[5]))


def test_cascade_bounds_and_first_layer(spark):
    x, y = gauss(40)
    rows = spark.createDataFrame([(i, r.tolist(), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, features array<double>, label int")
    with pytest.raises(ValueError, match="more than 10"):
        cascade.fit(rows, cascade.CascadeParameter(subsets=2, gamma=1.0, most_rows=10))
    model = cascade.fit(rows, cascade.CascadeParameter(subsets=2, gamma=1.0, passes=4, criterion="first_layer"))
    assert model.nodes[0]["layer"] == 0 and {n["pass"] for n in model.nodes} <= {1, 2, 3, 4}


def test_cascade_parameters():
    p = cascade.CascadeParameter()
    assert (p.subsets, p.cost, p.gamma, p.epsilon, p.passes) == (8, 1.0, 1e-3, 1e-3, 5)
    with pytest.raises(ValueError):
        cascade.CascadeParameter(cost=0)


# -- linear -----------------------------------------------------------------------------------------
TOY = [(0, [1.0, 1.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0, 0.0]), (1, [0.0, 0.0, 1.0, 0.0]), (0, [2.0, 1.0, 0.0, 1.0])]


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(TOY)], "id long, label int, features array<double>").persist()


@pytest.mark.parametrize("solver", [0, 1, 2, 3, 4, 5, 6, 7])
@pytest.mark.parametrize("C", [1.0, 30.0])
def test_separable_toy(toy, solver, C):
    model = linear.train(toy, linear.Parameter(solver, C, 1e-4))
    assert model.w.shape == ((2, 4) if solver == 4 else (1, 4))
    assert all(r.label == r.prediction for r in linear.predict(toy, model).collect())


def test_probabilities(toy):
    model = linear.train(toy, linear.Parameter(0, 1.0))
    for r in linear.predict(toy, model, True).collect():
        assert abs(sum(r.probabilities) - 1) < 1e-9 and max(r.probabilities) >= 0.5
    with pytest.raises(ValueError):
        linear.predict(toy, linear.train(toy, linear.Parameter(2)), True)


def frame(spark, x, y, kind="int"):
    return spark.createDataFrame([(i, v, r.tolist()) for i, (r, v) in enumerate(zip(x, y.tolist()))], f"id long, label {kind}, features array<double>")


def test_smooth_solvers_are_stationary(spark):
    x, y = gauss(80)
    df = frame(spark, x, y.astype(int))
    for solver, loss in ((0, "logistic"), (2, "squared_hinge")):
        m = linear.train(df, linear.Parameter(solver, 0.5, 1e-8))
        _, g, _ = L.loss_parts(loss, x @ m.w[0], y)
        assert np.abs(m.w[0] + x.T @ (0.5 * g)).max() < 1e-5
    for solver, loss in ((6, "logistic"), (5, "squared_hinge")):
        w = linear.train(df, linear.Parameter(solver, 0.5, 1e-8)).w[0]
        _, g, _ = L.loss_parts(loss, x @ w, y)
        g = x.T @ (0.5 * g)
        assert all(abs(gi + np.sign(wi)) < 1e-4 if wi else abs(gi) <= 1 + 1e-4 for gi, wi in zip(g, w))
    z = x @ [0.3, -0.2] + 0.05 * y
    w = linear.train(frame(spark, x, z, "double"), linear.Parameter(11, 2.0, 1e-8)).w[0]
    _, g, _ = L.loss_parts("squared_tube", x @ w, z)
    assert np.abs(w + x.T @ (2.0 * g)).max() < 1e-5


def test_duals_close_the_gap():
    x, y = gauss(60)
    for squared in (False, True):
        w, a = L.hinge_dual(x, y, np.full(len(y), 0.7), squared, 1e-6, 20000)
        d = np.maximum(0, 1 - y * (x @ w))
        primal = w @ w / 2 + 0.7 * (d * d if squared else d).sum()
        dual = a.sum() - w @ w / 2 - (a @ a / (4 * 0.7) if squared else 0)
        assert primal - dual < 1e-2 * max(1, primal)
    z = x @ [0.3, -0.2]
    for squared in (False, True):
        w, b = L.tube_dual(x, z, 1.0, 0.1, squared, 1e-8, 20000)
        r = np.maximum(0, np.abs(x @ w - z) - 0.1)
        primal = w @ w / 2 + (r * r if squared else r).sum()
        dual = z @ b - 0.1 * np.abs(b).sum() - w @ w / 2 - (b @ b / 4 if squared else 0)
        assert primal - dual < 1e-3 * max(1, primal)


def test_joint_multi_class():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.6, (40, 2)) for c in ([3, 0], [-3, 3], [-3, -3])])
    k = np.repeat(np.arange(3), 40)
    C = np.full(120, 1.0)
    W = L.crammer_singer(x, k, 3, C, 1e-6, 5000)
    m = x @ W.T
    own = m[np.arange(120), k]
    loss = np.maximum(0, (m - own[:, None] + (np.arange(3) != k[:, None])).max(1))
    best = (W * W).sum() / 2 + loss.sum()
    rng = np.random.default_rng(4)
    for _ in range(200):  # no nearby point is better
        V = W + rng.normal(scale=0.02, size=W.shape)
        mv = x @ V.T
        lv = np.maximum(0, (mv - mv[np.arange(120), k][:, None] + (np.arange(3) != k[:, None])).max(1))
        assert (V * V).sum() / 2 + lv.sum() >= best - 1e-4
    assert (m.argmax(1) == k).mean() > 0.95


def test_one_vs_rest_and_cross_validation(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.6, (40, 2)) for c in ([3, 0], [-3, 3], [-3, -3])])
    df = frame(spark, x, np.repeat([7, 5, 6], 40))
    model = linear.train(df, linear.Parameter(2), bias=1.0)
    assert model.labels == [7, 5, 6] and model.w.shape == (3, 3)
    got = linear.cross_validate(df, linear.Parameter(0), 4, 1.0)
    assert got.count() == 120 and metrics.accuracy(got).head()[0] > 0.95


def sparse_frame(spark, rows, y, kind="int"):
    return spark.createDataFrame([(k, v, sorted(r), [float(r[j]) for j in sorted(r)]) for k, (r, v) in enumerate(zip(rows, y))], f"id long, label {kind}, idx array<int>, val array<double>")


def test_sparse_solvers_are_stationary(spark):
    """10^5 features: the gradient of the penalised cost is 0 (L2), or within the penalty (L1)."""
    rng, n = np.random.default_rng(3), 100_000
    rows = [{int(j): float(v) for j, v in zip(rng.integers(1, n + 1, 12), rng.normal(size=12))} for _ in range(120)]
    rows[5] = {}
    y = np.where(rng.random(120) < 0.5, 1, -1)
    for r, v in zip(rows, y):
        r |= {1: float(v) + rng.normal() * 0.5, n: 0.3}
    df = sparse_frame(spark, rows, y.tolist())
    sign = y * y[0]  # the first class is the positive one

    def cost(w, loss, target, c=0.5):
        z = np.array([sum(v * w[j - 1] for j, v in r.items()) + 2.0 * w[n] for r in rows])
        f, g, _ = L.loss_parts(loss, z, target)
        grad = np.zeros(n + 1)
        for r, s in zip(rows, g):
            for j, v in r.items():
                grad[j - 1] += c * s * v
            grad[n] += c * s * 2.0
        return c * f.sum(), grad

    for solver, loss in ((0, "logistic"), (1, "squared_hinge")):
        m = linear.train_sparse(df, linear.Parameter(solver, 0.5), n, bias=2.0, tol=1e-7)
        assert m.w.shape == (1, n + 1) and m.labels == [int(y[0]), -int(y[0])]
        assert np.abs(m.w[0] + cost(m.w[0], loss, sign)[1]).max() < 1e-5
    got = linear.predict(df, m).collect()
    assert np.mean([r.label == r.prediction for r in got]) > 0.9
    m = linear.train_sparse(df, linear.Parameter(6, 0.5), n, bias=2.0, tol=1e-5)
    g = cost(m.w[0], "logistic", sign)[1]
    assert np.abs(g[m.w[0] == 0]).max() <= 1 + 1e-2 and np.abs(g + np.sign(m.w[0]))[m.w[0] != 0].max() < 1e-2
    z = rng.normal(size=120)
    m = linear.train_sparse(sparse_frame(spark, rows, z.tolist(), "double"), linear.Parameter(11, 0.5), n, bias=2.0, tol=1e-7)
    assert np.abs(m.w[0] + cost(m.w[0], "squared_tube", z)[1]).max() < 1e-5


def test_sparse_equals_dense(spark):
    x, y = gauss(60)
    df = frame(spark, x, y.astype(int))
    for solver in (0, 2, 11):
        own = df if solver < 11 else df.withColumn("label", F.col("label").cast("double"))
        a = linear.train(own, linear.Parameter(solver, 0.5, 1e-8), 1.0)
        b = linear.train_sparse(linear.as_sparse(own), linear.Parameter(solver, 0.5, 1e-8), 2, 1.0, tol=1e-10)
        assert np.abs(a.w - b.w).max() < 1e-5
    assert [r.prediction for r in linear.predict(own, a).orderBy("id").collect()] == pytest.approx([r.prediction for r in linear.predict(linear.as_sparse(own), b).orderBy("id").collect()], abs=1e-4)


def test_oversize_problem(spark):
    with pytest.raises(ValueError, match="number of classes.*too large"):
        linear._sized(1000, 20_000_000)
    df = spark.range(1000).select("id", F.col("id").cast("int").alias("label"), F.array(F.lit(20_000_000)).alias("idx"), F.array(F.lit(1.0)).alias("val"))
    with pytest.raises(ValueError, match="too large"):
        linear.train_sparse(df, linear.Parameter(2), 20_000_000)


def test_parameters():
    assert linear.Parameter(0).eps == 0.01 and linear.Parameter(1).eps == 0.1 and linear.Parameter(11).eps == 0.001
    for bad in ({"C": 0}, {"C": -1}, {"eps": 0}, {"solver": 9}, {"p": -1}):
        with pytest.raises(ValueError):
            linear.Parameter(**bad)


# -- splits, sets, metrics --------------------------------------------------------------------------
def test_splits(spark):
    ids = spark.range(103)
    assert sorted(r["count"] for r in partition.equal_subsets(ids, 4).groupBy("subset").count().collect()) == [25, 25, 25, 28]
    rows = ids.withColumn("label", F.when(F.col("id") % 2 == 0, 1).otherwise(-1))
    split = partition.unbalanced_subsets(rows, 4, "label")
    share = {r.subset: r.s for r in split.groupBy("subset").agg(F.avg((F.col("label") > 0).cast("int")).alias("s")).collect()}
    assert len(share) == 4 and min(share[0], share[1]) > 0.8 and max(share[2], share[3]) < 0.2
    assert partition.gaps(spark.createDataFrame([(0,), (2,)], "k long"), "k").head()[0] == 1
    assert [r.rn for r in features.numbered(ids.withColumn("k", F.col("id") * 3), "k").orderBy("k").collect()] == list(range(1, 104))


def test_bind_and_wide(spark):
    parts = spark.createDataFrame([(1, 0, "c"), (0, 1, "b"), (0, 0, "a")], "block long, row long, v string")
    assert [r.v for r in scoring.row_bind(parts, "block", "row").orderBy("position").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        scoring.row_bind(parts.where("block = 1"), "block", "row")
    p = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25)], "id long, concept string, prob double")
    assert tuple(scoring.wide(p, ["a", "b"], 10).head()) == (11, 0.5, 0.25)


# -- formats ----------------------------------------------------------------------------------------
GOOD = "1 1:1  3:1  4:1   6:1\n2 2:1  3:1  5:1   7:1\n1 3:1  5:1\n1 1:1  4:1  7:1\n2 4:1  5:1  7:1\n"


def put(tmp_path, text, name="f.txt"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_svmlight(spark, tmp_path):
    rows, n = formats.read_svmlight(spark, put(tmp_path, GOOD), bias=1.0)
    got = rows.orderBy("id").collect()
    assert n == 8 and [r.label for r in got] == [1, 2, 1, 1, 2] and all(r.idx[-1] == 8 and r.val[-1] == 1 for r in got)
    rows, n = formats.read_svmlight(spark, put(tmp_path, "1 1:1  3:1  4:1   6:1\n2 \n", "g.txt"))
    assert n == 6 and rows.orderBy("id").collect()[1].idx == []
    formats.write_svmlight(rows, str(tmp_path / "out"))
    again, m = formats.read_svmlight(spark, str(tmp_path / "out"))
    assert m == 6 and again.count() == 2
    dense = formats.densify(rows, 3).orderBy("id").collect()
    assert dense[0].features == [1, 0, 1] and dense[1].features == [0, 0, 0]


@pytest.mark.parametrize("line", ["1 3:1  5:1  4:1", "2 2:1  3:1  5:1  -4:1", "1 3:1  5:a", "1 abc", "1 1:", "", "1 0:3"])
def test_svmlight_errors(spark, tmp_path, line):
    with pytest.raises(formats.InvalidInput):
        formats.read_svmlight(spark, put(tmp_path, GOOD + line + "\n" + "1 1:1\n"))


def test_labels_ids_manifest(spark, tmp_path):
    assert sorted(map(tuple, formats.read_labels(spark, put(tmp_path, "1 1\n2 1\n3 -1\n1 -1\n")).collect())) == [(1, -1), (2, 1), (3, -1)]
    assert [r.id for r in formats.read_ids(spark, put(tmp_path, " 1\n2 \n3\n", "i")).orderBy("id").collect()] == [1, 2, 3]
    m = formats.read_manifest(spark, put(tmp_path, "a/b_1.x 1\nc_2.x 9\n", "m")).orderBy("id").collect()
    assert [(r.id, r.name, r.grp) for r in m] == [(1, "a/b_1.x", "a"), (2, "c_2.x", "")]


def test_binary_chunks(spark, tmp_path):
    (tmp_path / "x-inpart0-2").write_bytes(formats.encode_feature_chunk([(4, [0, 40000], [0.5, 2.0]), (5, [], [])]))
    got = formats.read_feature_chunks(spark, str(tmp_path / "x-inpart0-2")).orderBy("id").collect()
    assert got[0].idx == [0, 40000] and got[0].val == [0.5, 2.0] and got[1].idx == []
    for end in "<>":
        (tmp_path / "k-c3-r2").write_bytes(np.array([[1, 2], [3, 4]], f"{end}f4").tobytes())
        k = formats.read_kernel_chunks(spark, str(tmp_path / "k-c3-r2"), 2, end).orderBy("r").collect()
        assert [(r.block, r.ks) for r in k] == [(3, [1, 2]), (3, [3, 4])]
    (tmp_path / "p").write_bytes(np.array([[7, 0.25, 0.75]], ">f8").tobytes())
    assert tuple(formats.read_prediction_chunks(spark, str(tmp_path / "p"), 2).head()) == (7, [0.25, 0.75])
    rows = spark.createDataFrame([(1, 0, [3.0]), (0, 0, [1.0])], "block int, r long, ks array<double>")
    assert [r.value for r in formats.kernel_lines(rows, ["block", "r"], -1).orderBy("n").collect()] == ["0:1 1:-1.0", "0:2 1:-3.0"]


def test_kernel_lines_and_chunks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0]), (1, 0, [5.0, 6.0])], "block int, r long, ks array<double>")
    formats.kernel_lines(rows, ["block", "r"]).orderBy("n").select("value").coalesce(1).write.text(str(tmp_path / "k"))
    assert [(r.n, r.ks) for r in formats.read_kernel_lines(spark, str(tmp_path / "k")).orderBy("n").collect()] == [(1, [1, 2]), (2, [3, 4]), (3, [5, 6])]
    assert formats.read_kernel_lines(spark, put(tmp_path, "1 0:7 1:0.5 2:1\n", "lab")).head() == (7, [0.5, 1.0])
    for bad in ("0:1 2:3\n", "1:2 2:3\n", "0:1 1:x\n"):
        with pytest.raises(formats.InvalidInput):
            formats.read_kernel_lines(spark, put(tmp_path, bad, "bad"))
    folder = tmp_path / "chunks"
    folder.mkdir()
    for r in formats.kernel_chunk_bytes(rows).collect():
        (folder / f"x-c{r.block}-2").write_bytes(bytes(r.content))
    assert formats.check_kernel_chunks(spark, str(folder), 2) == 2
    assert sorted((r.block, r.r, r.ks) for r in formats.read_kernel_chunks(spark, str(folder), 2).collect()) == [(0, 0, [1, 2]), (0, 1, [3, 4]), (1, 0, [5, 6])]
    (folder / "x-c3-2").write_bytes(b"12345678")
    with pytest.raises(formats.InvalidInput):
        formats.check_kernel_chunks(spark, str(folder), 2)
    formats.write_kernel_table(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("block = 1").head().ks == [5, 6]


def test_feature_writers(spark, tmp_path):
    rows = spark.createDataFrame([(9, [0, 3], [0.5, 1.0]), (4, [1], [2.0]), (30, [], [])], "id long, idx array<int>, val array<float>")
    folder = tmp_path / "feat"
    folder.mkdir()
    for r in formats.feature_chunk_bytes(rows, 2).collect():
        (folder / f"f-inpart{r.chunk}-2").write_bytes(bytes(r.content))
    assert [k for k, _ in formats.chunk_files(spark, str(folder), r"inpart(\d+)")] == [0, 1]
    got = sorted((r.id, list(r.idx), list(r.val)) for r in formats.read_feature_chunks(spark, str(folder)).collect())
    assert got == [(0, [1], [2.0]), (1, [0, 3], [0.5, 1.0]), (2, [], [])]
    both = formats.modality_blocks([rows, rows.where("id < 20")], 2).orderBy("block", "r").collect()
    assert [(r.block, r.m, r.r, r.id) for r in both] == [(0, 0, 0, 4), (0, 0, 1, 9), (0, 1, 2, 4), (0, 1, 3, 9), (1, 0, 0, 30)]
    f = spark.createDataFrame([(1, [1], [1.0]), (2, [2], [2.0])], "n long, idx array<int>, val array<double>")
    ids = spark.createDataFrame([(1, 1), (2, 5)], "n long, id long")
    assert [(r.rn, r.label) for r in formats.label_features(f, ids).orderBy("rn").collect()] == [(1, 1), (2, -1)]
    with pytest.raises(formats.InvalidInput):
        formats.label_features(f, ids.limit(1))
    listed = spark.createDataFrame([(0, 30), (1, 77), (2, 4)], "pos long, id long")
    out, missing = formats.concatenated(listed, rows, "id")
    assert missing == 1 and [(r.n, r.id) for r in out.orderBy("n").collect()] == [(1, 30), (2, 4)]
    lines = formats.check_lines(spark, put(tmp_path, "1 1:1 3:2\n2\n1 3:1 2:1\n1 0:1\nx 1:1\n1 2:\n", "lines"))
    assert [r.ok for r in lines.orderBy("id").collect()] == [True, True, False, False, False, False]


def test_binary_linear_model(spark):
    m = {"w": np.array([0.5, -1.25, 0.0]), "b": 0.75, "label": [1, -1], "probA": [-2.0], "probB": [0.25]}
    again = formats.parse_binary_linear_model(formats.format_binary_linear_model(m))
    assert again["w"].tolist() == m["w"].tolist() and (again["b"], again["probA"], again["dim"]) == (0.75, [-2.0], 3)
    rows = spark.createDataFrame([(1, [2.0, 1.0, 9.0])], "id long, features array<double>")
    assert scoring.linear_scores(rows, formats.linear_machine_table(spark, again, "u").select("model_id", "w", "b")).head().decision == 0.5
    for bad in (["dim 2", "w", "1"], ["what 3", "w"], ["b 1"]):
        with pytest.raises(formats.InvalidInput):
            formats.parse_binary_linear_model(bad)


def test_arff(spark, tmp_path):
    df, classes = formats.read_arff(spark, put(tmp_path, "@relation r\n@attribute a numeric\n@attribute class {x, y}\n@data\n1,2,x\n3,4,y\n"))
    assert classes == ["x", "y"] and [(r.features, r.label) for r in df.orderBy("id").collect()] == [([1, 2], "x"), ([3, 4], "y")]


def test_model_texts(spark, tmp_path, toy):
    m = linear.train(toy, linear.Parameter(0), bias=2.0)
    formats.write_lines(spark, formats.format_linear_model(m), str(tmp_path / "lin"))
    again = formats.read_linear_model(spark, str(tmp_path / "lin"))
    assert again.labels == m.labels and again.bias == 2.0 and np.abs(again.w - m.w).max() < 1e-14
    with pytest.raises(formats.InvalidInput):
        formats.parse_linear_model(["solver_type L2R_LR", "what 3", "w"])
    machine = {"svm_type": "c_svc", "kernel_type": "precomputed", "gamma": 0.5, "nr_class": 2, "rho": [0.25], "label": [1, -1], "probA": [-2.0], "probB": [0.1], "nr_sv": [1, 1], "sv": [([0.5], {0: 3.0}), ([-0.5], {0: 9.0})]}
    parsed = formats.parse_machine_model(formats.format_machine_model(machine))
    assert parsed["sv"] == machine["sv"] and parsed["rho"] == [0.25] and parsed["gamma"] == 0.5
    model, sv = formats.machine_tables(spark, parsed, "m", "c", 0)
    assert model.head().prob_a == -2.0 and sorted(r.sv_id for r in sv.collect()) == [3, 9]


# -- machines and command line ----------------------------------------------------------------------
def test_one_vs_one_frames(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.5, (30, 2)) for c in ([0, 0], [3, 0], [0, 3])])
    labels = np.repeat([4, 1, 9], 30)
    df = frame(spark, x, labels)
    m = machines.one_vs_one(df, kernel=("rbf", 0.5))
    assert [p[1:] for p in m.problems] == [(4, 1), (4, 9), (1, 9)]
    got = {r.id: r.prediction for r in machines.predict(df, m, df).collect()}
    K = kernels.standard("rbf", 0.5)(x, x)
    want = smo.one_vs_one(K, labels, 1.0).predict(K)
    assert np.mean([got[i] == v for i, v in enumerate(want)]) > 0.98
    cv = machines.cross_validate(df, 3, kernel=("rbf", 0.5))
    assert cv.count() == 90 and metrics.accuracy(cv).head()[0] > 0.9


def test_one_class_regression_and_grid(spark):
    x, y = gauss(40)
    df = frame(spark, x, y.astype(int))
    d = {r.id: r.decision for r in machines.decide(df, machines.one_class(df, 0.2, ("rbf", 0.2)), df).collect()}
    assert abs(np.mean([v < -1e-3 for v in d.values()]) - 0.2) < 0.1
    t = np.linspace(0, 6, 60)
    reg = frame(spark, t[:, None], np.sin(t), "double")
    got = {r.id: r.decision for r in machines.decide(reg, machines.regression(reg, 10.0, 0.05), reg).collect()}
    assert max(abs(got[i] - v) for i, v in enumerate(np.sin(t))) < 0.07
    grid = machines.grid_search(df, (0.5, 1.0), (1.0, 2.0)).collect()
    assert len(grid) == 4 and all(0.7 < r.map <= 1 for r in grid)


def test_class_probabilities_and_noise(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.5, (20, 2)) for c in ([0, 0], [3, 0], [0, 3])])
    labels = np.repeat([4, 1, 9], 20)
    df = frame(spark, x, labels)
    got = {r.id: r for r in machines.probabilities(df, machines.one_vs_one(df, kernel=("rbf", 0.5), probability=True), df).collect()}
    K = kernels.standard("rbf", 0.5)(x, x)
    want = smo.one_vs_one(K, labels, 1.0, probability=True).probabilities(K)
    assert list(got[0].classes) == [4, 1, 9] and max(abs(got[i].probs[k] - want[i, k]) for i in got for k in range(3)) < 1e-6
    t = np.linspace(0, 6, 60)
    reg = frame(spark, t[:, None], np.sin(t) + rng.normal(scale=0.2, size=60), "double")
    assert 0.05 < machines.regression_noise(reg, 3, C=10.0).head()[0] < 0.5


def test_fusion_in_one_pass(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.5), (2, "x", 1.0)], "id long, idx string, val double")
    b = spark.createDataFrame([(7, "x", 0.25), (7, "z", 0.75)], "id long, idx string, val double")
    ids, other = spark.createDataFrame([(1,), (2,), (3,)], "id long"), spark.createDataFrame([(7,)], "id long")
    for digits in (None, 15):
        one = kernel_join.fused_sparse([(a, b), (b.union(a), a)], ids, other, "chi2", [0.25, 0.75], digits)
        two = kernel_join.fused([kernel_join.sparse_kernel(a, ids, b, other, "chi2"), kernel_join.sparse_kernel(b.union(a), ids, a, other, "chi2")], [0.25, 0.75])
        assert {(r.i, r.j): r.k for r in one.collect()} == pytest.approx({(r.i, r.j): r.k for r in two.collect()})


def test_gaussians(spark):
    got = machines.gaussians(spark, 400).groupBy("label").agg(F.avg(F.col("features")[1]).alias("m"), F.count("*").alias("n")).collect()
    assert {r.label: (round(r.m), r.n) for r in got} == {1: (3, 400), -1: (7, 400)}


def test_command_line(spark, tmp_path):
    data = put(tmp_path, "1 1:1 2:1\n-1 3:1\n-1 3:1\n1 1:2 2:1 4:1\n")
    cli.linear_train(spark, ["-s", "0", "-c", "5", "-q", data, str(tmp_path / "m")])
    cli.linear_predict(spark, ["-b", "1", data, str(tmp_path / "m"), str(tmp_path / "o")])
    assert [r.value.split()[0] for r in spark.read.text(str(tmp_path / "o")).collect()] == ["1", "-1", "-1", "1"]
    with pytest.raises(cli.ParameterFormatError):
        cli.options(["-x", "1"], {"n": int})
    assert cli.options(["-w1", "1.234", "-w2", "0.12", "f"], {"w": float}) == ({"w": {1: 1.234, 2: 0.12}}, ["f"])
    x, y = gauss(20)
    frame(spark, x, y.astype(int)).select("id", "features").write.parquet(str(tmp_path / "f"))
    labels = put(tmp_path, "".join(f"{i} {int(v)}\n" for i, v in enumerate(y)), "l")
    cli.cascade_train(spark, ["-n", "2", "-g", "1", "-i", "2", str(tmp_path / "f"), labels, str(tmp_path / "c")])
    assert spark.read.parquet(str(tmp_path / "c/support")).count() > 2


def test_ensemble_tables(spark, tmp_path):
    machine = {"gamma": 0.5, "nr_class": 2, "rho": [0.25], "label": [1, -1], "probA": [-2.0], "probB": [0.1], "nr_sv": [1, 1], "sv": [([0.5], {0: 3.0}), ([-0.5], {0: 9.0})]}
    folder = tmp_path / "models"
    folder.mkdir()
    for name in ("cat.0", "cat.1", "dog.0"):
        (folder / name).write_text("\n".join(formats.format_machine_model(machine)))
    (folder / "cat.0.performance").write_text("x")
    m, sv = tables.read_ensemble(spark, str(folder))
    assert sorted((r.concept, r.layer, r.gamma) for r in m.collect()) == [("cat", 0, 0.5), ("cat", 1, 0.5), ("dog", 0, 0.5)] and sv.count() == 6
    tables.write_machines(m, sv, str(tmp_path / "e"))
    a, b = tables.read_machines(spark, str(tmp_path / "e"))
    assert a.count() == 3 and b.count() == 6
    p = spark.createDataFrame([(2, "a", 0.75), (1, "a", 0.25)], "id long, concept string, prob double")
    tables.write_by_concept(scoring.unpivot(p), str(tmp_path / "u"))
    assert [r.value for r in spark.read.text(str(tmp_path / "u/concept=a")).collect()] == ["label 1 0", "0 0.25 0.75", "1 0.75 0.25"]
    tables.write_predictions(scoring.wide(p, ["a"]), str(tmp_path / "w"))
    tables.write_ids(p.select("id"), str(tmp_path / "i"), text=True)
    assert [r.id for r in formats.read_ids(spark, str(tmp_path / "i")).collect()] == [1, 2]
    assert [r.id for r in tables.first_rows(p, "id", 1, 1).collect()] == [2]


def test_large_machines_start_from_like_ones():
    """Multipliers of a like problem, out of balance and out of the box, save rounds and lead to the same minimum, whatever the precision of the sums on the way."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2600, 16)).astype(np.float32).astype(np.float64)
    x /= 4
    x = x.astype(np.float32).astype(np.float64)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=len(x)) > 0.2, 1.0, -1.0)
    K = smo.gram(kernels.standard("rbf", 0.5), x)
    assert K.single is not None and len(x) > smo.FULL
    cold = smo.c_svc(K, y, 1.0, 1e-4)
    warm = smo.c_svc(K, y, 1.0, 1e-4, np.where(y > 0, 0.4, 3.0) * cold.alpha)
    full = kernels.standard("rbf", 0.5)(x, x)
    for s in (cold, warm):
        g = y * (full @ (s.alpha * y)) - 1  # by hand, in double precision
        v, a = -y * g, s.alpha
        gap = v[np.where(y > 0, a < 1, a > 0)].max() - v[np.where(y > 0, a > 0, a < 1)].min()
        assert gap < 1e-4 + 1e-9 and abs(gap - s.gap) < 1e-9 and abs(s.alpha @ y) < 1e-6 and a.min() >= 0 and a.max() <= 1
    assert warm.rounds < cold.rounds and abs(warm.objective - cold.objective) < 1e-3
    again = smo.c_svc(K, y, 1.0, 1e-4, cold.alpha)
    assert again.rounds <= cold.rounds / 20
    # Rows that single precision cannot hold, or too long for it, keep to double.
    assert smo.Gram(kernels.standard("rbf", 0.5), x + 1e-9).single is None and smo.Gram(kernels.standard("rbf", 0.5), x * 64).single is None


def test_single_sums_of_kernel_values():
    x = np.random.default_rng(1).normal(size=(700, 8)).astype(np.float32).astype(np.float64) / 4
    v, cols, rows = np.linspace(-1, 1, 60), np.arange(0, 1200, 20), np.arange(5, 1400, 7)
    K = smo.Gram(kernels.standard("rbf", 0.7), x, 2)
    want = np.tile(kernels.standard("rbf", 0.7)(x, x), (2, 2))
    K.exact = False
    assert np.abs(K.times(cols, v) - want[:, cols] @ v).max() < 1e-5
    assert np.abs(K.times(cols, v, rows) - want[np.ix_(rows, cols)] @ v).max() < 1e-5


def test_large_nodes_start_from_the_layer_before(spark):
    """A large node that gets its own multipliers back is at its minimum at once, with the same support vectors and values."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(2500, 8)) / 4).astype(np.float32).astype(float)
    y = np.where(x[:, 0] + 0.2 * rng.normal(size=len(x)) > 0, 1, -1)
    rows = spark.createDataFrame([(k, r.tolist(), int(c)) for k, (r, c) in enumerate(zip(x, y))], "id long, features array<double>, label int")
    p = cascade.CascadeParameter(subsets=1, gamma=1.0)
    members = rows.select(F.lit(0).alias("node"), "id")
    first = cascade.train_layer(members, rows, p, 1, 0).toPandas()
    start = spark.createDataFrame(first[["id", "coef"]])
    second = cascade.train_layer(members, rows, p, 2, 0, start=start).toPandas()
    one, two = (d.set_index("id").sort_index() for d in (first, second))
    assert one.index.equals(two.index) and np.abs(one["coef"] - two["coef"]).max() < 1e-3 and abs(one["ld"].iloc[0] - two["ld"].iloc[0]) < 1e-3 and two["gap"].max() < 1e-3


def test_folds_start_from_the_whole_node():
    """Held-out decisions of a large node are the same from its own multipliers as from nothing."""
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(2800, 8)) / 4).astype(np.float32).astype(float)
    y = np.where(x[:, 0] + 0.2 * rng.normal(size=len(x)) > 0, 1.0, -1.0)
    K, part = smo.gram(kernels.standard("rbf", 0.5), x), smo.parts(len(x))[1]
    whole = smo.c_svc(K, y, 1.0, 1e-5)
    cold, warm = smo.held_decisions(K, y, 1.0, part, 1e-5), smo.held_decisions(K, y, 1.0, part, 1e-5, whole.alpha)
    assert np.abs(cold - warm).max() < 1e-3
