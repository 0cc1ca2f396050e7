
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrastat.operators import dependence as D
from terrastat.operators import descriptive as A
from terrastat.operators import pareto as P
from terrastat.operators.scan import global_prefix


def _rollup(spark, totals, pops=None):
    pops = pops or [100000] * len(totals)
    rows = [(i + 1, f"M{i + 1}", "S", t, p) for i, (t, p) in enumerate(zip(totals, pops))]
    return spark.createDataFrame(rows, "muni_key bigint, muni string, state string, total bigint, population bigint")


def test_moments_match_pandas(spark):
    xs = [1, 2, 2, 3, 10, 25, 7, 100]
    df = spark.createDataFrame([(float(x), float(x), float(x)) for x in xs], "total double, rate_100k double, population double")
    r = A.descriptive_stats(df).where(F.col("column") == "total").first()
    s = pd.Series(xs, dtype=float)
    assert r.skew == pytest.approx(2.550906629699928, rel=1e-12)
    assert r.kurtosis == pytest.approx(6.689714113702156, rel=1e-12)
    assert r.q1 == 2.0 and r.q3 == 13.75 and r.median == s.median()
    assert r.std == pytest.approx(s.std(), rel=1e-12)


def test_moments_short_columns(spark):
    for n in (2, 3):
        df = spark.createDataFrame([(float(i), float(i), float(i)) for i in range(n)], "total double, rate_100k double, population double")
        r = A.descriptive_stats(df).where(F.col("column") == "total").first()
        assert r.kurtosis is None
        assert (r.skew is None) == (n < 3)


def test_gini(spark):
    assert A.gini(_rollup(spark, [5, 5, 5, 5])).first().gini == pytest.approx(0.0, abs=1e-12)
    g = A.gini(_rollup(spark, [0, 0, 0, 0, 10])).first().gini
    assert g == pytest.approx(4 / 5)


def test_lorenz_shape(spark):
    pts = A.lorenz_curve(_rollup(spark, [1, 3, 6])).orderBy("point").collect()
    assert [(p.point, p.pop_pct, round(p.cases_pct, 9)) for p in pts] == [
        (0, 0.0, 0.0), (1, 100 / 3, 10.0), (2, 200 / 3, 40.0), (3, 100.0, 100.0)]


@pytest.mark.parametrize("totals,critical", [([50, 30, 20], 2), ([70, 20, 10], 1), ([25, 25, 25, 25], 3)])
def test_pareto_critical(spark, totals, critical):
    inc = _rollup(spark, totals)
    s = P.pareto_summary(P.pareto_curve(inc)).first()
    assert s.critical_count == critical and s.municipalities == len(totals)


def test_pareto_tie_and_zero(spark):
    c = P.pareto_curve(_rollup(spark, [10, 10, 10])).orderBy("rank").collect()
    assert [r.muni_key for r in c] == [1, 2, 3]
    z = P.pareto_curve(_rollup(spark, [0, 0])).collect()
    assert all(r.share_pct is None and r.cum_pct is None for r in z)


def test_pareto_keeps_null_population_rollup_drops_it(spark):
    rows = [(1, "A", "S", 10, None), (2, "B", "S", 20, 1000)]
    inc = spark.createDataFrame(rows, "muni_key bigint, muni string, state string, total bigint, population bigint")
    assert P.muni_rollup_pareto(inc).count() == 2
    assert A.muni_rollup(inc).count() == 1


def test_prefix_any_number_of_ranges(spark):
    import random
    rnd = random.Random(7)
    # a third of the rows share one value: ranges still split them by key
    vals = [5] * 300 + [rnd.randint(0, 50) for _ in range(600)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k bigint, v bigint")
    order = [("v", False), ("k", True)]
    one = {r.k: (r.rank, r.cum) for r in global_prefix(df, order, "v").collect()}
    many = global_prefix(df, order, "v", rows_per_range=50)
    got = {r.k: (r.rank, r.cum) for r in many.collect()}
    assert got == one
    ref = sorted(enumerate(vals), key=lambda kv: (-kv[1], kv[0]))
    cum = 0
    for rank, (k, v) in enumerate(ref, start=1):
        cum += v
        assert one[k] == (rank, cum)


def test_prefix_plan_has_no_single_partition_over_rows(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    out = global_prefix(df, [("v", True), ("k", True)], "v", rows_per_range=200)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # the only single-partition exchange is the one over the per-range offsets
    assert plan.count("SinglePartition") <= 1
    assert "hashpartitioning(_rng" in plan


def _table(spark, rows):
    data = []
    goods = ["g1", "g2", "g3"]
    classes = ["Rural", "Urbano", "Megalópolis"]
    for gi, row in enumerate(rows):
        for ci, v in enumerate(row):
            data.append((goods[gi], classes[ci], v))
    return spark.createDataFrame(data, "legal_good string, settlement string, observed bigint")


def test_chi_square_even_dof(spark):
    c = D.chi_square(_table(spark, [[10, 30, 15], [20, 40, 60]])).first()
    assert c.chi2 == pytest.approx(8.838383838383837, rel=1e-12)
    assert c.dof == 2
    assert c.p_value == pytest.approx(0.012043960847, rel=1e-9)


def test_chi_square_yates(spark):
    c = D.chi_square(_table(spark, [[10, 30], [20, 40]])).first()
    assert c.dof == 1
    assert c.chi2 < 0.793650793651
    # Yates: sum((|o-e| - 0.5)^2 / e)
    n = 100
    o = [[10, 30], [20, 40]]
    r = [40, 60]
    col = [30, 70]
    exp = sum((abs(o[i][j] - r[i] * col[j] / n) - 0.5) ** 2 / (r[i] * col[j] / n) for i in range(2) for j in range(2))
    assert c.chi2 == pytest.approx(exp, rel=1e-12)
    assert 0 < c.p_value < 1


def test_chi_square_odd_dof_pvalue(spark):
    from terrastat.functions.stats import _chi2_sf_scalar
    # chi2 survival at dof 3 and 5 against known values
    assert _chi2_sf_scalar(7.814727903251178, 3) == pytest.approx(0.05, rel=1e-9)
    assert _chi2_sf_scalar(11.070497693516351, 5) == pytest.approx(0.05, rel=1e-9)
    assert _chi2_sf_scalar(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)


def test_one_column_table_has_null_v(spark):
    t = spark.createDataFrame([("g1", "Rural", 5), ("g2", "Rural", 7)], "legal_good string, settlement string, observed bigint")
    d = D.diagnosis(D.chi_square(t)).first()
    assert d.cramers_v is None and d.related is False


def test_contingency_drops_zero_marginals(spark, make_inc):
    from tests.conftest import wide_row
    inc = make_inc([wide_row(legal_good="A", population=1000), wide_row(legal_good="B", population=1000),
                    wide_row(legal_good="C", months=[0] * 12, population=1000)])
    t = D.contingency(inc).collect()
    assert {(r.legal_good, r.settlement) for r in t} == {("A", "Rural"), ("B", "Rural")}


def test_histogram_max_in_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 10]], "rate_100k double")
    h = {r.bin: r.n for r in A.rate_histogram(df, bins=5).collect()}
    assert h == {1: 2, 2: 1, 5: 1}   # width 2: [0,2) [2,4) ... the max closes bin 5


def test_quartiles_agree_with_pandas(spark):
    import random
    rnd = random.Random(9)
    xs = [float(rnd.randint(0, 40)) for _ in range(301)] + [7.0] * 150   # heavy tie
    df = spark.createDataFrame([(i, x, x, x) for i, x in enumerate(xs)],
                               "muni_key bigint, total double, rate_100k double, population double")
    r = A.descriptive_stats(df).where(F.col("column") == "total").first()
    s = pd.Series(xs)
    assert (r.q1, r.median, r.q3) == pytest.approx((s.quantile(.25), s.median(), s.quantile(.75)))
    b = A.rate_box(df).first()
    assert (b.q1, b.median, b.q3) == pytest.approx((s.quantile(.25), s.median(), s.quantile(.75)))


def test_rank_quantiles_multi_range(spark):
    from terrastat.operators.scan import rank_quantiles
    xs = [float(i % 97) for i in range(1000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k bigint, v double")
    q = rank_quantiles(df, "v", [0.1, 0.5, 0.9], "k", rows_per_range=100)
    got = spark.range(1).select(q.alias("q")).first().q
    s = pd.Series(xs)
    assert got == pytest.approx([s.quantile(.1), s.quantile(.5), s.quantile(.9)])


def test_gini_beyond_64_bits(spark):
    df = spark.range(200_000).select(F.col("id").alias("muni_key"), F.lit(10 ** 9).cast("bigint").alias("total"))
    g = A.gini(df).first()
    assert g.gini == pytest.approx(0.0, abs=1e-9) and g.municipalities == 200_000


def test_chi_square_odd_dof_in_spark(spark):
    from terrastat.functions.stats import _chi2_sf_scalar
    data = [("g1", c, v) for c, v in zip(["Rural", "Urbano", "Megalópolis", "X"], [10, 20, 30, 25])]
    data += [("g2", c, v) for c, v in zip(["Rural", "Urbano", "Megalópolis", "X"], [30, 15, 10, 40])]
    t = spark.createDataFrame(data, "legal_good string, settlement string, observed bigint")
    c = D.chi_square(t).first()
    assert c.dof == 3
    assert c.p_value == pytest.approx(_chi2_sf_scalar(c.chi2, 3), rel=1e-12)
    assert 0 < c.p_value < 0.05


def test_descriptive_table_shape_and_rounding(spark):
    xs = [1, 2, 2, 3, 10, 25, 7, 100]
    df = spark.createDataFrame([(float(x), float(x), float(x)) for x in xs],
                               "total double, rate_100k double, population double")
    t = {r.stat: (r.position, r.total) for r in A.descriptive_table(A.descriptive_stats(df)).collect()}
    s = pd.Series(xs, dtype=float)
    assert list(t) and sorted(p for p, _ in t.values()) == list(range(9))
    assert t["Media"][1] == round(s.mean(), 2) and t["Mediana"][1] == round(s.median(), 2)
    assert t["Desv. Est."][1] == round(s.std(), 2) and t["Curtosis"][1] == round(s.kurt(), 2)
    assert t["Asimetría"][1] == round(s.skew(), 2) and t["Q3 (75%)"][1] == 13.75


def test_chi2_survival_on_the_jvm(spark):
    from terrastat.functions.stats import _chi2_sf_scalar, chi2_sf
    rows = [(x, k) for k in (1, 2, 3, 5, 9, 30, 101, 447, 5001)
            for x in (0.0, 1e-6, 0.5, k * 0.5, k - 0.5, float(k), k + 1.0, k * 1.3, k * 2.0 + 40)]
    df = spark.createDataFrame(rows, "x double, k int")
    plan = df.select(chi2_sf("x", "k"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    for r in df.select("x", "k", chi2_sf("x", "k").alias("p")).collect():
        want = _chi2_sf_scalar(r.x, r.k)
        if r.k < 1000:  # the scalar's sums over- and underflow beyond
            assert r.p == pytest.approx(want, rel=1e-9, abs=1e-13), (r.x, r.k)
        assert 0 <= r.p <= 1
    none = df.limit(1).select(chi2_sf(F.lit(None).cast("double"), F.lit(3)).alias("p"),
                              chi2_sf(F.lit(1.0), F.lit(-1)).alias("q")).first()
    assert none.p is None and none.q is None


def test_sketch_quartiles_keep_their_bound(spark):
    import numpy as np
    from terrastat.operators import descriptive as A
    rnd = np.random.default_rng(7)
    x = np.concatenate([rnd.normal(0, 1, 20_000), np.full(10_000, 0.25), rnd.exponential(50, 10_000)])
    rnd.shuffle(x)
    df = spark.createDataFrame([(float(v), None) for v in x], "total double, empty double").repartition(7)
    got = {r.column: r for r in A.descriptive_stats_sketch(df, ["total", "empty"], k=200).collect()}
    bound, r = A.sketch_rank_error(200), got["total"]
    for q, v in ((0.25, r.q1), (0.5, r.median), (0.75, r.q3)):
        assert (x < v).mean() - bound <= q <= (x <= v).mean() + bound
    assert r["mean"] == pytest.approx(x.mean()) and r["max"] == x.max()
    assert got["empty"].median is None and got["empty"]["mean"] is None
    plan = A.descriptive_stats_sketch(spark.range(9).selectExpr("id AS total"), ["total"])
    plan = plan._jdf.queryExecution().executedPlan().toString()  # one aggregate, no sort
    assert "Sort " not in plan and plan.count("Exchange") == 1
