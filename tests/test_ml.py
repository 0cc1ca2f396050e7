import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastat.operators import blocks as BL
from terrastat.operators import dbscan as DB
from terrastat.operators import features as FE
from terrastat.operators import lloyd as LL
from terrastat.operators import pivots as PV
from terrastat.operators import profiles as PR
from terrastat.operators import silhouette as SI
from terrastat.operators import sparse as SP
from terrastat.operators.components import connected_components
from terrastat.operators.silhouette import best_k, silhouette_samples, silhouette_score


def brute_silhouette(X, labels):
    X = np.asarray(X, float)
    n = len(X)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(n):
        own = labels == labels[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, labels == c].mean() for c in set(labels) if c != labels[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def brute_dbscan(X, eps, min_samples):
    """Row-order expansion, as the reference's library does."""
    X = np.asarray(X, float)
    n = len(X)
    D2 = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    nb = [np.where(D2[i] <= eps * eps)[0] for i in range(n)]  # same criterion as the operator
    core = np.array([len(x) >= min_samples for x in nb])
    lab = -np.ones(n, int)
    c = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        lab[i] = c
        stack = [i]
        while stack:
            j = stack.pop()
            if not core[j]:
                continue
            for k in nb[j]:
                if lab[k] == -1:
                    lab[k] = c
                    if core[k]:
                        stack.append(k)
        c += 1
    return lab


def _points(spark, X):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(X)], "k bigint, x double, y double")


def test_silhouette_exact_matches_bruteforce(spark):
    rnd = np.random.default_rng(3)
    X = np.vstack([rnd.normal(0, 1, (30, 3)), rnd.normal(5, 1, (25, 3)), [[20, 20, 20]]])
    lab = np.array([0] * 30 + [1] * 25 + [2])
    df = spark.createDataFrame([(i, [float(v) for v in x], int(l)) for i, (x, l) in enumerate(zip(X, lab))],
                               "id bigint, x array<double>, label int")
    got = silhouette_score(df, "id", "x", "label", tile_rows=16).first().silhouette
    assert got == pytest.approx(brute_silhouette(X, lab), rel=1e-9)
    singleton = silhouette_samples(df, "id", "x", "label", tile_rows=16).where("label = 2").first()
    assert singleton.silhouette == 0.0


def test_best_k_tie_takes_smallest(spark):
    ev = spark.createDataFrame([(2, 0.5), (3, 0.7), (5, 0.7)], "k bigint, silhouette double")
    assert best_k(ev).first().best_k == 3


@pytest.mark.parametrize("eps,ms", [(0.3, 4), (0.5, 6), (0.05, 3), (100.0, 3)])
def test_dbscan_matches_row_order_expansion(spark, eps, ms):
    rnd = np.random.default_rng(11)
    X = np.vstack([rnd.normal(0, 0.3, (60, 2)), rnd.normal(3, 0.3, (50, 2)), rnd.uniform(-2, 5, (30, 2))])
    got = {r.k: r.label for r in DB.dbscan_labels(_points(spark, X), "k", ["x", "y"], eps, ms).collect()}
    ref = brute_dbscan(X, eps, ms)
    assert [got[i] for i in range(len(X))] == list(ref)


def test_dbscan_border_takes_smaller_cluster(spark):
    # two dense groups on a line; the middle point is within eps of two cores
    # of each group but has too few neighbours to be a core itself
    A = [(x, 0.0) for x in (0.10, 0.12, 0.14, 0.16, 0.18)]
    B = [(x, 0.0) for x in (1.02, 1.04, 1.06, 1.08, 1.10)]
    X = A + B + [(0.6, 0.0)]
    got = DB.dbscan_labels(_points(spark, X), "k", ["x", "y"], 0.45, 6).collect()
    lab = {r.k: r.label for r in got}
    core = {r.k: r.is_core for r in got}
    assert not core[10] and core[4] and core[5]
    assert lab[10] == 0 and lab[0] == 0 and lab[9] == 1
    assert [lab[i] for i in range(len(X))] == list(brute_dbscan(np.array(X), 0.45, 6))


def test_dbscan_all_noise_and_plan(spark):
    X = [(float(i), 0.0) for i in range(10)]
    labels = DB.dbscan_labels(_points(spark, X), "k", ["x", "y"], 0.1, 3)
    assert {r.label for r in labels.collect()} == {-1}
    s = PR.dbscan_summary(labels.withColumnRenamed("label", "cluster").withColumn("population", F.lit(1)))
    assert s.count() == 0 and s.columns == ["cluster", "members", "mean_population", "type"]
    for pairs in (DB.neighbour_pairs(_points(spark, X), "k", ["x", "y"], 0.1),
                  DB.fine_grid(_points(spark, X), "k", ["x", "y"], 0.1)[1]):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_effective_min_samples():
    assert DB.effective_min_samples(None, 3) == 6
    assert DB.effective_min_samples(None, 1) == 4
    assert DB.effective_min_samples(5, 3) == 5
    assert DB.effective_min_samples(5, 3, legacy_auto=True) == 6
    assert DB.effective_min_samples(38, 3, legacy_auto=True) == 38


def test_connected_components(spark):
    v = spark.createDataFrame([(i,) for i in range(10)], "id bigint")
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6), (9, 8), (8, 7)], "src bigint, dst bigint")
    got = {r.id: r.comp for r in connected_components(v, e).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7, 9: 7}


def _mart(spark, extra_str=False):
    rnd = random.Random(5)
    rows = []
    for i in range(60):
        pop = 5000 + rnd.randint(0, 100000)
        rows.append((i, f"M{i}", "S", pop, rnd.randint(0, 50), rnd.randint(0, 80), 7, rnd.randint(0, 30)))
    df = spark.createDataFrame(rows, "muni_key bigint, muni string, state string, population bigint, "
                                     "Robo_a_casa bigint, Fraude bigint, Const bigint, Total bigint")
    return df.withColumn("Nota", F.lit("x")) if extra_str else df


def test_feature_roles_and_errors(spark):
    ids, feats = FE.feature_roles(_mart(spark))
    assert ids == ["muni_key", "muni", "population", "state"]
    assert feats == ["Robo_a_casa", "Fraude", "Const"]
    with pytest.raises(TypeError):
        FE.feature_roles(_mart(spark, extra_str=True))
    with pytest.raises(KeyError):
        FE.filter_population(_mart(spark).drop("population"))


def test_scaling_zero_variance_and_pca_invariants(spark):
    m = _mart(spark)
    ids, feats = FE.feature_roles(m)
    rates = FE.feature_rates(m, ids, feats)
    scaled = FE.standardise(rates, ids, feats)
    X = np.array([[r[f] for f in feats] for r in scaled.collect()])
    pd_rates = np.array([[r[f] for f in feats] for r in rates.collect()])
    assert np.allclose(X.mean(0), 0, atol=1e-9)
    # population std (ddof 0) except the constant rate column, which is 0 everywhere
    assert np.allclose(X[:, 0].std(), 1.0)
    const = FE.standardise(spark.createDataFrame([(1, 5.0), (2, 5.0)], "muni_key bigint, c double"), ["muni_key"], ["c"])
    assert [r.c for r in const.collect()] == [0.0, 0.0]
    pca = FE.pca_scores(scaled, ids, feats, variance=0.999999)
    assert sum(pca.ratios) == pytest.approx(1.0, rel=1e-9)
    S = np.array([[r[c] for c in FE.pc_columns(pca.n_components)] for r in pca.scores.collect()])
    C = np.cov(S, rowvar=False)
    C = np.atleast_2d(C)
    assert np.allclose(C - np.diag(np.diag(C)), 0, atol=1e-8)
    for j in range(pca.n_components):
        col = pca.loadings[:, j]
        assert col[np.argmax(np.abs(col))] > 0


def test_pca_projection_is_the_loadings_product(spark):
    m = _mart(spark)
    ids, feats = FE.feature_roles(m)
    scaled = FE.standardise(FE.feature_rates(m, ids, feats), ids, feats)
    a = FE.pca_scores(scaled, ids, feats, variance=0.999999)
    cols = FE.pc_columns(a.n_components)
    got = {r.muni_key: [r[c] for c in cols] for r in a.scores.collect()}
    for r in scaled.collect():
        assert np.allclose(got[r.muni_key], np.array([r[f] for f in feats]) @ a.loadings, atol=1e-9)


def test_cluster_naming(spark):
    m = _mart(spark)
    ids, feats = FE.feature_roles(m)
    rates = FE.feature_rates(m, ids, feats).withColumn("cluster", F.col("muni_key") % 3)
    names = PR.cluster_names(rates, feats).collect()
    pd_rates = rates.toPandas()
    for n in names:
        sub = pd_rates[pd_rates.cluster == n.cluster]
        z = (sub[feats].mean() - pd_rates[feats].mean()) / (pd_rates[feats].std() + 1e-9)
        assert n.specialty == z.idxmax()
        assert n.top_z == pytest.approx(z.max(), rel=1e-9)
        k = f"{sub.population.mean() / 1000:.0f}k"
        assert n.cluster_name.endswith(f"(N={len(sub)} | Pob: {k})")
        assert n.cluster_name.startswith("Perfil Pacifico" if z.max() < 0 else "Foco: ")


def test_one_feature_mart(spark):
    m = _mart(spark)
    ids, feats = FE.feature_roles(m)
    rates = FE.feature_rates(m, ids, feats[:1]).withColumn("cluster", F.col("muni_key") % 3)
    names = PR.cluster_names(rates, feats[:1]).collect()
    assert {n.specialty for n in names} == {feats[0]}

def test_kmeans_invariants(spark):
    from terrastat.operators import kmeans as KM
    rnd = random.Random(1)
    rows = [(i, f"M{i}", "S", 10000, *(rnd.randint(0, 9) + (50 if i % 3 == 0 else 0) for _ in range(4)))
            for i in range(90)]
    m = spark.createDataFrame(rows, "muni_key bigint, muni string, state string, population bigint, "
                                    "a bigint, b bigint, c bigint, d bigint")
    prep = KM.prepare(m)
    model, lab = KM.fit_labels(prep, 3)
    got = lab.select("cluster").distinct().count()
    assert got <= 3
    centers = np.array(model.clusterCenters())
    for r in lab.collect():
        x = np.array([r[c] for c in FE.pc_columns(prep.pca.n_components)])
        assert r.cluster == int(np.argmin(((centers - x) ** 2).sum(1)))
    ev = KM.evaluate_k(prep, ks=range(2, 5)).orderBy("k").collect()
    assert len(ev) == 3 and all(-1 <= e.silhouette <= 1 for e in ev)


@pytest.mark.parametrize("d,eps,ms", [(1, 0.2, 5), (3, 0.6, 5), (4, 0.9, 5), (5, 1.0, 4)])
def test_dbscan_other_dims_match_bruteforce(spark, d, eps, ms):
    rnd = np.random.default_rng(20 + d)
    X = np.vstack([rnd.normal(0, 0.3, (50, d)), rnd.normal(2, 0.3, (40, d)), rnd.uniform(-1, 3, (20, d))])
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *[float(v) for v in x]) for i, x in enumerate(X)],
                               "k bigint, " + ", ".join(f"{c} double" for c in cols))
    got = {r.k: r.label for r in DB.dbscan_labels(df, "k", cols, eps, ms).collect()}
    assert [got[i] for i in range(len(X))] == list(brute_dbscan(X, eps, ms))


def test_dbscan_hot_cell_emits_no_same_cell_pairs(spark):
    # a third of the points are identical: they share one fine cell
    rnd = np.random.default_rng(4)
    X = np.vstack([np.zeros((100, 2)), rnd.uniform(-3, 3, (200, 2))])
    pts = _points(spark, X)
    cells, cross = DB.fine_grid(pts, "k", ["x", "y"], 0.3)
    hot = {r.id for r in cells.where("cell_n >= 100").collect()}
    assert set(range(100)) <= hot
    pairs = cross.collect()
    assert not any(a in hot and b in hot for a, b, _ in pairs)
    assert len(pairs) < 100 * 200
    got = {r.k: r.label for r in DB.dbscan_labels(pts, "k", ["x", "y"], 0.3, 5).collect()}
    assert [got[i] for i in range(len(X))] == list(brute_dbscan(X, 0.3, 5))


def test_dbscan_copies_collapse_high_dims(spark):
    rnd = np.random.default_rng(12)
    X = np.vstack([np.zeros((60, 5)), np.full((60, 5), 0.2), rnd.uniform(-2, 2, (60, 5))])
    cols = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *[float(v) for v in x]) for i, x in enumerate(X)],
                               "k bigint, " + ", ".join(f"{c} double" for c in cols))
    got = {r.k: (r.label, r.neighbours) for r in DB.dbscan_labels(df, "k", cols, 0.5, 5).collect()}
    assert [got[i][0] for i in range(len(X))] == list(brute_dbscan(X, 0.5, 5))
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    assert [got[i][1] for i in range(len(X))] == list((D <= 0.5).sum(1))


def test_dbscan_copies_collapse(spark):
    # two adjacent groups of exact copies (a third of the rows each) plus noise
    rnd = np.random.default_rng(8)
    X = np.vstack([np.zeros((80, 2)), np.full((80, 2), 0.25), rnd.uniform(-3, 3, (80, 2))])
    got = {r.k: (r.label, r.neighbours) for r in DB.dbscan_labels(_points(spark, X), "k", ["x", "y"], 0.3, 5).collect()}
    ref = brute_dbscan(X, 0.3, 5)
    assert [got[i][0] for i in range(len(X))] == list(ref)
    # neighbour counts are exact, and null inside dense cells (no pairs there)
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    exact = (D <= 0.3).sum(1)
    for i in range(len(X)):
        assert got[i][1] == exact[i] or (got[i][1] is None and exact[i] >= 5)


def test_dbscan_keeps_points_without_a_place(spark):
    rows = [(0, 0.0, 0.0), (1, 0.1, 0.0), (2, 0.0, 0.1), (3, None, 0.0), (4, 0.0, float("nan"))]
    df = spark.createDataFrame(rows, "k bigint, x double, y double")
    got = {r.k: (r.label, r.is_core) for r in DB.dbscan_labels(df, "k", ["x", "y"], 0.5, 3).collect()}
    assert got == {0: (0, True), 1: (0, True), 2: (0, True), 3: (-1, False), 4: (-1, False)}


@pytest.mark.parametrize("gap", [0.999, 1.001])
def test_hot_dense_cells_link_only_within_eps(spark, gap):
    # two long walls of points facing each other just within or beyond eps
    ys = np.linspace(0, 0.6, 400)
    X = np.vstack([np.c_[np.zeros(400), ys], np.c_[np.full(400, gap), ys]])
    got = DB.dbscan_labels(_points(spark, X), "k", ["x", "y"], 1.0, 5)
    assert got.select("label").distinct().count() == (1 if gap < 1 else 2)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_dense_cell_links_match_bruteforce(spark, d):
    # many points per cell so most cells are dense; links decided by sub-cells
    rnd = np.random.default_rng(30 + d)
    X = np.vstack([rnd.normal(0, 0.25, (300, d)), rnd.normal(1.2, 0.25, (300, d))])
    eps, ms = 0.35, 4
    cols = [f"c{i}" for i in range(d)]
    df = spark.createDataFrame([(i, *[float(v) for v in x]) for i, x in enumerate(X)],
                               "k bigint, " + ", ".join(f"{c} double" for c in cols))
    got = {r.k: r.label for r in DB.dbscan_labels(df, "k", cols, eps, ms).collect()}
    assert [got[i] for i in range(len(X))] == list(brute_dbscan(X, eps, ms))


def test_connected_components_long_chain(spark):
    # a path of 3000 vertices with shuffled ids: diameter 2999, one component
    rnd = random.Random(3)
    ids = list(range(3000))
    rnd.shuffle(ids)
    v = spark.createDataFrame([(i,) for i in ids], "id bigint")
    e = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(len(ids) - 1)], "src bigint, dst bigint")
    got = connected_components(v, e, max_rounds=40).collect()
    assert len(got) == 3000 and {r.comp for r in got} == {0}


# --- DBSCAN above three coordinates ---------------------------------------------
def _cloud(seed, d=6):
    """Blobs of several widths, a tight ball, copies and a background."""
    rnd = np.random.default_rng(seed)
    centres = rnd.uniform(-4, 4, (4, d))
    X = np.vstack([rnd.normal(c, s, (n, d)) for c, s, n in
                   zip(centres, (0.25, 0.05, 0.5, 0.02), (60, 80, 40, 120))]
                  + [rnd.uniform(-5, 5, (60, d)), np.repeat(centres[:1] + 0.1, 15, axis=0)])
    return X[rnd.permutation(len(X))]


def _high(spark, X):
    names = [f"c{i}" for i in range(X.shape[1])]
    return spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)],
                                 "k bigint, " + ", ".join(f"{c} double" for c in names)), names


@pytest.mark.parametrize("eps,ms,count_all", [(0.5, 5, False), (0.9, 12, False), (0.25, 4, True),
                                              (0.02, 3, False), (50.0, 4, False)])
def test_dbscan_pivots_match_brute_force(spark, monkeypatch, eps, ms, count_all):
    monkeypatch.setattr(PV, "BLOCK", 40)
    monkeypatch.setattr(PV, "ROWS_PER_PIVOT", 30)
    X = _cloud(3)
    df, names = _high(spark, X)
    got = sorted(DB.dbscan_labels(df.repartition(3), "k", names, eps, ms, count_all).collect())
    assert [r.label for r in got] == list(brute_dbscan(X, eps, ms))
    near = (np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)) <= eps).sum(1)
    assert [r.is_core for r in got] == list(near >= ms)
    assert all(r.neighbours == n for r, n in zip(got, near) if r.neighbours is not None)
    if count_all:
        assert all(r.neighbours is not None for r in got)


def test_dbscan_pivots_between_dense_balls(spark, monkeypatch):
    """Dense balls whose leaders are one to two eps apart, with and without a
    pair within eps."""
    rnd = np.random.default_rng(5)
    ball = lambda c, n: rnd.normal(0, 0.02, (n, 4)) + np.array([c, 0, 0, 0])
    X = np.vstack([ball(0, 50), ball(1.05, 50), ball(2.3, 50), ball(5, 50), ball(6.02, 50)])
    df, names = _high(spark, X)
    for block in (2048, 16):
        monkeypatch.setattr(PV, "BLOCK", block)
        got = sorted(DB.dbscan_labels(df, "k", names, 1.0, 5, count_all=False).collect())
        assert [r.label for r in got] == list(brute_dbscan(X, 1.0, 5))


def test_dbscan_pivots_odd_rows(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, None, 0.0), (2, 1.0, float("nan"), 1.0, 1.0),
                                (3, 1.0, 1.0, 1.0, 1.0), (4, 1.0, 1.0, 1.0, 1.0)],
                               "k bigint, a double, b double, c double, d double")
    cols = ["a", "b", "c", "d"]
    got = {r.k: r.label for r in DB.dbscan_labels(df, "k", cols, 0.5, 2).collect()}
    assert got == {1: -1, 2: -1, 3: 0, 4: 0}
    got = DB.dbscan_labels(df, "k", cols, 0.5, 2, count_all=False).collect()
    assert {r.k: r.label for r in got} == {1: -1, 2: -1, 3: 0, 4: 0}
    assert DB.dbscan_labels(df.limit(0), "k", cols, 0.5, 2).collect() == []
    plan = DB.dbscan_labels(df, "k", cols, 0.5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_dbscan_pairs_stay_linear_beside_a_dense_ball(spark):
    """A ball with a third of the rows: doubling the rows about doubles the
    comparisons, which stay far below the ball's pairs."""
    eps, ms, looked = 0.4, 10, []
    for n in (1500, 3000):
        rnd = np.random.default_rng(n)
        X = np.vstack([rnd.normal(0, 0.02, (n // 3, 8)), rnd.uniform(-3, 3, (2 * n // 3, 8))])
        pts = spark.createDataFrame([(i, 1, list(map(float, x))) for i, x in enumerate(X)],
                                    "id bigint, w bigint, x array<double>")
        plan = PV.layout(pts, n, eps, ms, True)
        placed = DB.checkpointed(PV.place(pts, plan))
        dense = [r.ball for r in placed.where("ball >= 0").groupBy("ball").sum("w").collect()
                 if r["sum(w)"] >= ms]
        inside = F.col("ball").isin(dense)
        loose, members = placed.where(~inside), placed.where(inside)
        assert members.count() >= n // 3
        a = PV.near_balls(loose, members, plan, ms).agg(F.sum("looked")).first()[0] or 0
        b = PV.count_neighbours(loose, eps).agg(F.sum("looked")).first()[0]
        looked.append((a, b))
        assert a < 4 * n and a + b < (n // 3) ** 2 / 2 + (2 * n // 3) ** 2
    assert looked[1][0] <= 4 * max(looked[0][0], 1000)


# --- silhouette with pruned clusters --------------------------------------------
def _labelled_cloud(spark, k, n, spread, seed=2):
    rnd = np.random.default_rng(seed)
    centres = rnd.uniform(-10, 10, (k, 3))
    lab = np.arange(n) % k
    X = centres[lab] + rnd.normal(0, spread, (n, 3))
    df = spark.createDataFrame([(i, [float(v) for v in x], int(c)) for i, (x, c) in enumerate(zip(X, lab))],
                               "id bigint, x array<double>, label int")
    return X, lab, df


@pytest.mark.parametrize("spread", [0.3, 6.0])
def test_pruned_silhouette_equals_the_whole_one(spark, spread):
    X, lab, df = _labelled_cloud(spark, 7, 210, spread)
    got = {r.id: r.silhouette for r in silhouette_samples(df, "id", "x", "label", tile_rows=16).collect()}
    many = SI.silhouette_many(df, "id", "x", ["label"], tile_rows=16).collect()
    assert len(got) == len(X)
    for r in many:
        assert got[r.id] == pytest.approx(r.silhouette, abs=1e-12)


def test_pruned_silhouette_skips_far_clusters(spark, monkeypatch):
    """On clustered data most other clusters need no distance."""
    X, lab, df = _labelled_cloud(spark, 12, 480, 0.2)
    looked, original = [], SI._distance_sums

    def counted(queries, targets, tiles):
        sizes = np.bincount(lab)
        per = {r.c: r["count"] for r in queries.groupBy("c").count().collect()}
        looked.append(sum(int(sizes[c]) * n for c, n in per.items()))
        return original(queries, targets, tiles)

    monkeypatch.setattr(SI, "_distance_sums", counted)
    got = silhouette_score(df, "id", "x", "label", tile_rows=32).first().silhouette
    assert got == pytest.approx(brute_silhouette(X, lab), rel=1e-9)
    own, off = 480 * 40, 480 * 440
    assert sum(looked) - own <= off / 2


def test_pruned_silhouette_odd_rows(spark):
    schema = "id bigint, x array<double>, label int"
    one = spark.createDataFrame([(1, [0.0], 4), (2, [1.0], 4)], schema)
    assert [r.silhouette for r in silhouette_samples(one, "id", "x", "label").collect()] == [0.0, 0.0]
    assert silhouette_samples(one.limit(0), "id", "x", "label").collect() == []
    same = spark.createDataFrame([(1, [0.0], 4), (2, [0.0], 4), (3, [0.0], 5), (4, [0.0], -1)], schema)
    assert {r.silhouette for r in silhouette_samples(same, "id", "x", "label").collect()} == {0.0}


# --- thousands of features ------------------------------------------------------
def test_sparse_mart_of_5000_features(spark):
    d, n = 5000, 150
    rnd = np.random.default_rng(9)
    names = [f"f{i}" for i in range(d)]
    dense = np.zeros((n, d))
    rows = []
    for i in range(n):
        for j in rnd.choice(d - 1, 60, replace=False):  # the last feature never occurs
            for _ in range(int(rnd.integers(1, 3))):
                v = int(rnd.integers(1, 9))
                rows.append((i, names[j], v))
                dense[i, j] += v
    rows += [(0, "unlisted", 5), (n, "unlisted", 5), (0, names[3], None)]
    long = spark.createDataFrame(rows, "muni_key bigint, feature string, value bigint")
    mart = SP.sparse_matrix(long, ["muni_key"], "feature", "value", names)
    got = {r.muni_key: {c.position: c.value for c in r.cells} for r in mart.collect()}
    assert got[n] == {}
    for i in range(n):
        assert got[i] == {int(j): dense[i, j] for j in np.flatnonzero(dense[i])}
    plan = mart._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 20_000 and "CartesianProduct" not in plan and "Python" not in plan
    pop = mart.where(F.col("muni_key") < n).withColumn("population", F.lit(200_000)).withColumn(
        "cluster", F.col("muni_key") % 3)
    rates = DB.checkpointed(SP.sparse_rates(pop))
    stats = SP.sparse_stats(rates, d)
    X = dense / 200_000 * 100_000
    assert np.allclose(stats.mean, X.mean(0)) and np.allclose(stats.std, X.std(0))
    scaled = SP.scaled_rows(rates, ["muni_key"], stats)
    S = np.array([r.x for r in scaled.orderBy("muni_key").collect()])
    want = np.where(X.std(0) > 0, (X - X.mean(0)) / np.where(X.std(0) > 0, X.std(0), 1), 0)
    assert np.allclose(S, want, atol=1e-9)
    axes, ratios, kept = FE.principal_axes(DB.checkpointed(scaled.select("x")), d, 0.05)
    full = np.linalg.svd(want - want.mean(0), compute_uv=False) ** 2
    assert np.allclose(ratios[:kept], (full / full.sum())[:kept], atol=1e-9)
    prof = {(r.cluster, r.position): r["mean"] for r in SP.sparse_profile(rates, "cluster").collect()}
    for c in range(3):
        m = X[np.arange(n) % 3 == c].mean(0)
        assert all(prof.get((c, j), 0.0) == pytest.approx(m[j]) for j in range(d))


def test_sparse_rows_equal_the_dense_path(spark):
    m = _mart(spark).drop("Total")
    ids, feats = FE.feature_roles(m)
    dense = FE.standardise(FE.feature_rates(m, ids, feats), ids, feats)
    long = m.select("muni_key", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in feats])).alias("e")
    ).select("muni_key", "e.*")
    mart = SP.sparse_matrix(long, ["muni_key"], "feature", "value", feats).join(
        m.select("muni_key", "population"), "muni_key")
    rates = SP.sparse_rates(mart)
    got = {r.muni_key: r.x for r in
           SP.scaled_rows(rates, ["muni_key"], SP.sparse_stats(rates, len(feats))).collect()}
    for r in dense.collect():
        assert np.allclose(got[r.muni_key], [r[f] for f in feats], atol=1e-9)


def test_principal_axes_grow_until_the_variance_is_met(spark, monkeypatch):
    """A basis smaller than the space, iterated and widened."""
    monkeypatch.setattr(FE, "FULL_DIMS", 4)
    monkeypatch.setattr(FE, "FIRST_BASIS", 10)
    rnd = np.random.default_rng(1)
    scale = np.concatenate([np.linspace(9, 5, 12), np.full(28, 0.4)])
    X = rnd.normal(size=(400, 40)) * scale @ np.linalg.qr(rnd.normal(size=(40, 40)))[0] + 3
    df = spark.createDataFrame([([float(v) for v in x],) for x in X], "x array<double>").repartition(3)
    axes, ratios, kept = FE.principal_axes(df, 40, 0.95)
    C = np.cov(X, rowvar=False, bias=True)
    e, v = np.linalg.eigh(C)
    e, v = e[::-1], v[:, ::-1]
    assert kept == int(np.searchsorted(np.cumsum(e) / e.sum(), 0.95, side="right") + 1) and kept > 10
    assert np.allclose(ratios[:kept], e[:kept] / e.sum(), rtol=1e-9)
    assert np.allclose(np.abs((axes[:, :kept] * v[:, :kept]).sum(0)), 1, atol=1e-6)


# --- K-Means steps ----------------------------------------------------------------
def _plain_kmeans(X, k, seed, limit=300):
    """The same seeds and Lloyd steps without bounds."""
    draw = lambda j: (seed + j) * 0.6180339887498949 % 1.0
    C = [X[int(draw(0) * len(X))]]
    for j in range(1, k):
        d = ((X[:, None] - np.array(C)[None]) ** 2).sum(-1).min(1)
        if d.sum() <= 0:
            C.append(X[int(draw(j) * len(X))])
            continue
        C.append(X[int(np.searchsorted(np.cumsum(d), draw(j) * d.sum(), side="right"))])
    C, lab = np.array(C, float), None
    for _ in range(limit):
        new = ((X[:, None] - C[None]) ** 2).sum(-1).argmin(1)
        if lab is not None and (new == lab).all():
            break
        lab = new
        C = np.array([X[lab == c].mean(0) if (lab == c).any() else C[c] for c in range(k)])
    return C, lab, ((X - C[lab]) ** 2).sum()


def test_kmeans_sweep_equals_plain_lloyd(spark):
    rnd = np.random.default_rng(4)
    X = np.vstack([rnd.normal(c, 0.6, (70, 5)) for c in rnd.uniform(-4, 4, (5, 5))])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)],
                               "id bigint, x array<double>").repartition(3)
    looked = []
    fits, lab = LL.sweep(df, [2, 5, 8], 42, looked=looked)
    got = np.array([r.l for r in lab.orderBy("id").collect()])
    for i, k in enumerate((2, 5, 8)):
        C, want, inertia = _plain_kmeans(X, k, 42)
        assert (got[:, i] == want).all()
        assert np.allclose(fits[k].centres, C) and fits[k].inertia == pytest.approx(inertia)
    # bounds spare most distances once centres move little
    assert looked[-1] < looked[0] / 3


def test_kmeans_defined_cases(spark):
    schema = "id bigint, x array<double>"
    fits, lab = LL.sweep(spark.createDataFrame([], schema), [2, 3])
    assert fits[2].inertia == 0 and lab.collect() == []
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    fits, lab = LL.sweep(same, [2, 3])
    assert fits[3].inertia == 0 and {tuple(r.l) for r in lab.collect()} == {(0, 0)}
    few = spark.createDataFrame([(1, [0.0]), (2, [5.0])], schema)
    fits, lab = LL.sweep(few, [4])
    assert fits[4].inertia == 0
    ranges, LL.RANGES = LL.RANGES, 3
    try:  # seeds don't depend on how the running sum is cut
        pts = spark.createDataFrame([(i, [float(i * i % 37)]) for i in range(90)], schema)
        a = LL.seeds(pts, 6, 7)
    finally:
        LL.RANGES = ranges
    assert (a == LL.seeds(pts, 6, 7)).all()


def test_kmeans_disk_does_not_grow_with_steps(spark, monkeypatch):
    """A step writes no copy of the points, and a table of bounds that is replaced goes."""
    rnd = np.random.default_rng(3)
    X = rnd.uniform(size=(3000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id bigint, x array<double>")
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def used():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)

    floor, seen, step = used(), [], LL._step

    def stepped(*args):
        out = step(*args)
        seen.append(used() - floor)
        return out

    monkeypatch.setattr(LL, "_step", stepped)
    fits, _ = LL.sweep(df, [3, 6], 42)
    assert len(seen) > 10 and max(fits[k].steps for k in (3, 6)) == len(seen) - 1
    assert max(seen) < 3 * X.nbytes


def test_kmeans_of_floats_ties_and_repeated_ids(spark, monkeypatch):
    """Points as floats, in several tiles of a range, many at the same distance from two
    centres, with ids of text that come twice: labels are those of plain steps."""
    monkeypatch.setattr(LL, "TILE_ELEMENTS", 40)
    rnd = np.random.default_rng(8)
    rows = [(f"k{int(i):04d}", [float(v) for v in x])
            for i, x in zip(rnd.integers(0, 300, 600), rnd.integers(-3, 4, (600, 4)))]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "id string, x array<float>").repartition(5)
    X = np.array([x for _, x in sorted(rows)])
    fits, lab = LL.sweep(df, [4, 7], 42)
    got = lab.collect()
    assert sorted((r.id, r.x) for r in got) == sorted(rows)
    for i, k in enumerate((4, 7)):
        C, want, inertia = _plain_kmeans(X, k, 42)
        assert np.allclose(fits[k].centres, C) and fits[k].inertia == pytest.approx(inertia)
        label = {tuple(x): c for x, c in zip(X, want)}
        assert all(r.l[i] == label[tuple(r.x)] for r in got)
    with pytest.raises(Exception, match="a point without coordinates"):
        LL.seeds(spark.createDataFrame([("a", [1.0]), ("b", None)], "id string, x array<double>"), 2, 42)


# --- blocks of distances --------------------------------------------------------
def _joined(blocks, shape, kind=float):
    out = np.full(shape, 7, kind)
    for rows, cols, d in blocks:
        out[rows, cols] = d
    return out


def test_distance_blocks_keep_near_duplicates_and_odd_rows():
    """The matrix product agrees with coordinate differences, also far from the
    origin, for near duplicates, and beside rows that are no numbers."""
    rnd = np.random.default_rng(4)
    a = rnd.normal(0, 1, (700, 6)) + 1e4
    b = np.vstack([a[:300] + 1e-9, a[300:500], rnd.normal(0, 1, (900, 6)) + 1e4])
    a[5], a[6], b[700] = np.nan, np.inf, -np.inf
    with np.errstate(invalid="ignore"):
        d2 = ((a[:, None] - b[None]) ** 2).sum(-1)
    got = _joined(BL.distances(a, b), d2.shape)
    assert np.allclose(got, np.sqrt(d2), rtol=1e-9, atol=0, equal_nan=True)
    for eps in (1e-8, 1.3, float(np.sqrt(d2[20, 900]))):
        assert (_joined(BL.within(a, b, eps), d2.shape, bool) == (d2 <= eps * eps)).all()


def test_silhouette_tiles_are_not_copied_for_their_pairs(spark):
    """Tiles meet without a shuffle of a copy for every pair, in both forms."""
    X, lab, df = _labelled_cloud(spark, 5, 480, 3.0)
    for s in (SI.silhouette_many(df, "id", "x", ["label"], tile_rows=16),
              SI._distance_sums(df.select("id", F.col("label").alias("c"), "x"), SI._packs(
                  df.select("id", F.col("label").alias("c"), "x"), "c", F.lit(6)), 30)):
        assert s.count() == 480
        plan = s._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "shuffle_replicate_nl" in plan
    assert SI._tile_rows(2000, 200) == 200 and SI._tile_rows(10 ** 6, 200) == SI.DEFAULT_TILE_ROWS


@pytest.mark.parametrize("scale", [1.0, 1e-6])
def test_silhouette_on_a_line_compares_no_pairs(spark, scale):
    """One coordinate: running sums along the line, the same scores as from all pairs,
    for ties across tiles, far outliers and a cluster of one."""
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.pareto(0.8, 300), np.repeat(1.25, 90), 1e5 + rng.random(60) * scale, [-3e6]])
    labels = np.array([np.digitize(x, [1.0, 5.0]), np.arange(len(x)) % 5, np.arange(len(x)) == 3]).T
    df = spark.createDataFrame([(i, [float(v)], *map(int, l)) for i, (v, l) in enumerate(zip(x, labels))],
                               "id bigint, x array<double>, l0 int, l1 int, l2 int")
    many = SI.silhouette_many(df, "id", "x", ["l0", "l1", "l2"], tile_rows=16)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "shuffle_replicate_nl" not in plan
    got = {(r.position, r.id): (r.label, r.silhouette) for r in many.collect()}
    assert len(got) == 3 * len(x)
    D = np.abs(x[:, None] - x[None])
    for k, lab in enumerate(labels.T):
        sums, size = np.array([D[:, lab == c].sum(1) for c in np.unique(lab)]).T, np.bincount(lab)
        for i, c in enumerate(lab):
            a, b = sums[i, c] / max(1, size[c] - 1), np.delete(sums[i] / size, c).min()
            want = (b - a) / max(a, b) if size[c] > 1 else 0.0
            assert got[k, i] == (c, pytest.approx(want, abs=1e-12))


def test_silhouette_on_a_line_odd_rows(spark):
    """Equal points score 0, also in many tiles; what isn't finite takes the pairs' way."""
    same = spark.range(40).select("id", F.array(F.lit(2.5)).alias("x"), (F.col("id") % 2).alias("label"))
    assert {r.silhouette for r in SI.silhouette_many(same, "id", "x", ["label"], tile_rows=8).collect()} == {0.0}
    assert SI.silhouette_many(same.limit(0), "id", "x", ["label"]).collect() == []
    odd = same.withColumn("x", F.when(F.col("id") == 3, F.array(F.lit(float("nan")))).otherwise(F.col("x")))
    many = SI.silhouette_many(odd, "id", "x", ["label"], tile_rows=8)
    assert many.count() == 40
    assert "shuffle_replicate_nl" in many._jdf.queryExecution().optimizedPlan().toString()


def test_dbscan_rows_are_not_copied_for_cells_balls_or_blocks(spark, monkeypatch):
    """Points travel in tiles: no row for every cell, ball or block that a point may
    meet. Counts below ``enough`` are whole."""
    monkeypatch.setattr(PV, "BLOCK", 40)
    monkeypatch.setattr(PV, "ROWS_PER_PIVOT", 30)
    X = np.unique(_cloud(3), axis=0)
    pts = spark.createDataFrame([(i, 1, list(map(float, x))) for i, x in enumerate(X)],
                                "id bigint, w bigint, x array<double>")
    plan = PV.layout(pts, len(X), 0.9, 12, True)
    placed = DB.checkpointed(PV.place(pts, plan))
    assert set(placed.columns) == {"id", "w", "x", "cell", "ball", "ball_r"}
    near = (np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)) <= 0.9).sum(1)
    whole, some = PV.count_neighbours(placed, 0.9), PV.count_neighbours(placed, 0.9, 12)
    assert {r.id: r.n for r in whole.collect()} == dict(enumerate(near))
    for r in some.collect():
        assert r.n == near[r.id] if near[r.id] < 12 else 12 <= r.n <= near[r.id]
    balls = PV.near_balls(placed.where("ball < 0"), placed.where("ball >= 0"), plan, 12)
    for df in (whole, some, balls):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in text and "shuffle_replicate_nl" in text
