import math
import random

from pyspark.sql import functions as F

from terrastat.llm import topk


def brute(rows, every, k):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {i: v for i, v in sorted(ok, reverse=True) if i % every == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in ok
                      if c != q and len(w) == len(v))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def check(spark, rows, every=7, k=5, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    got = topk.top_k(df.repartition(3), F.col("vec_id") % every == 0, k, **kw)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"),
                          ("score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, every, k)


def test_brute_force_ties_blocks_nulls(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.5]) for i in range(300, 420)]  # ties of any number
    rows += [(420, None), (427, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (434, [math.nan] * 6), (441, [math.inf] * 6),
             (None, [1.0] * 6), (448, [0.25, 0.5]), (449, [0.5, 0.5]), (455, []), (456, [])]
    check(spark, rows)
    check(spark, rows, block=9)
    check(spark, [(0, [1e6, -1e6]), (1, [3e3, 5e3]), (7, [1e6, 2e5])])  # beyond exact doubles


def test_rows_that_repeat_an_id(spark):
    """Each query row is answered, and meets every row but itself."""
    rows = [(50, [1.0, 0.0]), (50, [0.5, 0.5]), (51, [0.0, 1.0]), (52, [1.0, 1.0]), (50, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, 3).collect()
    want = []
    for n, (q, v) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, w)), c)
                          for m, (c, w) in enumerate(rows) if m != n)[:3]
            want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_few_candidates_and_empty(spark):
    check(spark, [(0, [1.0]), (7, [2.0])])
    check(spark, [(0, [1.0])])
    check(spark, [])
    check(spark, [(1, [1.0])])
