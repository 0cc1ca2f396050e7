import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrastat.llm import eigen, whitening
from terrastat.llm.queries import QUERIES
from tests.conftest import SF001


@pytest.mark.parametrize("seed", range(8))
def test_eigenpairs(seed):
    rng = np.random.default_rng(seed)
    d = [1, 2, 3, 7, 24, 64, 40, 33][seed]
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = rng.uniform(0, 1, d) * 10.0 ** rng.integers(-6, 6)
    if seed >= 6:  # clusters: equal, nearly equal and zero eigenvalues
        values[:8], values[8:12], values[12:20] = values[0], values[8] * (1 + 1e-12), 0
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = eigen.leading(a, 32)
    size = np.abs(values).max()
    assert np.allclose(e, np.sort(np.linalg.eigvalsh(a))[::-1][:32], rtol=0, atol=1e-13 * size)
    assert np.abs(a @ v - v * e).max() < 1e-12 * size
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-11


def test_eigenpairs_of_plain_matrices():
    for a in (np.zeros((3, 3)), np.eye(5), np.diag([1.0, 3, 2, 3]), np.ones((4, 4)),
              np.diag([1e-300, 1e300]), np.kron(np.eye(3), [[2.0, 1], [1, 2]])):
        e, v = eigen.leading(a, 9)
        size = max(np.abs(a).max(), 1e-300)
        assert np.abs(a @ v - v * e).max() <= 1e-14 * size * len(a)
        assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-13
        assert np.all(np.diff(e) <= 0)


def brute(rows, components):
    """vec_id, component -> values by plain arithmetic and the library's solver."""
    ok = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for d in {len(x) for _, x in ok}:
        same = [(i, x) for i, x in ok if len(x) == d]
        n = len(same)
        s = [sum(x[k] for _, x in same) for k in range(d)]
        y = np.array([[n * a - b for a, b in zip(x, s)] for _, x in same], float).reshape(n, d) / n
        v = y.T @ y / n
        e, q = np.linalg.eigh(v) if d else (np.zeros(0), np.zeros((0, 0)))
        e, q = e[::-1][:components], q[:, ::-1][:, :components]
        for (i, x), r in zip(same, y):
            dev = sum((n * a - b) ** 2 for a, b in zip(x, s))
            out += [(i, k + 1, n, dev, float(r @ q[:, k]) / math.sqrt(e[k]), e[k] / np.trace(v))
                    for k in range(len(e)) if e[k] > 1e-9 * max(e[0], 1e-300)]
    return out


def check(got, expect):
    got = got.collect()
    assert len(got) == len(expect)
    signs = {}
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3], abs(r[4]))
    for a, b in zip(sorted((tuple(r) for r in got), key=key), sorted(expect, key=key)):
        assert a[:4] == b[:4]
        assert abs(abs(a[4]) - abs(b[4])) < 1e-8
        assert abs(a[5] - b[5]) < 1e-10
        assert 0 <= a[6] < 1e-9
        if abs(b[4]) > 1e-6:  # one sign a component and fit list
            assert signs.setdefault((a[1], a[2]), a[4] * b[4] > 0) == (a[4] * b[4] > 0)


def test_brute_force(spark):
    rng = random.Random(4)
    mix = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(6)]
    rows = []
    for i in range(400):
        z = [rng.gauss(0, 1 + k) for k in range(6)]
        rows.append((i, [sum(m * a for m, a in zip(r, z)) + 5 for r in mix]))
    rows += [(7, rows[7][1])] * 90 + [(None, rows[3][1]), (None, None), (900, [1.0, None] * 3),
                                      (901, [math.nan] * 6), (902, [math.inf] * 6), (903, [])]
    rows += [(1000 + i, [rng.uniform(-1, 1), 3.0]) for i in range(30)]  # a length of its own
    df = (spark.createDataFrame(rows, "vec_id long, embedding array<double>")
          .withColumn("x", F.lit("clash")).withColumn("component", F.lit(1)))
    check(whitening.whiten(df.repartition(5), 4), brute(rows, 4))


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [0.5, 0.25])], [(1, [0.5, 0.25])] * 3, [(1, None)], [(1, [])]):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.collect() == []
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained",
                               "identity_error"]
    rows = [(1, [0.5, 0.25, 0.0]), (2, [0.0, 0.5, 0.0])]  # one direction only
    check(whitening.whiten(spark.createDataFrame(rows, schema)), brute(rows, 32))
    with pytest.raises(Exception, match="OverflowError"):
        whitening.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], schema)).collect()


def test_exact_products():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 28, 1 << 40):
        c = rng.integers(-top, top, (50, 3))
        expect = [[sum(int(a) * int(b) for a, b in zip(c[:, i], c[:, j])) for j in range(3)]
                  for i in range(3)]
        assert whitening._products(c).tolist() == expect


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in
            spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    check(QUERIES["op11_whitening"](spark, SF001), brute(rows, 32))
