from pyspark.sql import functions as F

from terrastat.functions import records as R
from terrastat.operators import explore as Q
from tests.conftest import wide_row


def _vals(df, col):
    return [r[col] for r in df.collect()]


def test_settlement_bounds(spark):
    df = spark.createDataFrame([(14999,), (15000,), (250000,), (250001,), (None,)], "population bigint")
    got = _vals(df.select(R.settlement_class("population").alias("s")), "s")
    assert got == ["Rural", "Urbano", "Urbano", "Megalópolis", "Megalópolis"]


def test_risk_bounds(spark):
    df = spark.createDataFrame([(50.0,), (49.99,), (20.0,), (19.99,)], "rate_100k double")
    assert _vals(df.select(R.risk_level().alias("r")), "r") == ["Alto", "Medio", "Medio", "Bajo"]


def test_rate_zero_and_null_population(spark):
    df = spark.createDataFrame([(10, 0), (10, None), (10, 200000)], "total bigint, population bigint")
    got = _vals(df.select(R.rate_per_100k("total", "population").alias("r")), "r")
    assert got == [0.0, 0.0, 5.0]


def test_peak_month_tie_and_empty(make_inc):
    m = [0] * 12
    m[2] = 9
    m[6] = 9
    df = make_inc([wide_row(months=m), wide_row(muni_key=2, months=[0] * 12),
                   wide_row(muni_key=3, months=[None] * 12)])
    rows = df.select(R.peak_month().alias("p"), R.peak_cases().alias("c")).collect()
    assert rows[0]["p"] == 3 and rows[0]["c"] == 9
    assert rows[1]["p"] == 1 and rows[1]["c"] == 0     # all zero: a peak of 0
    assert rows[2]["p"] is None                          # no counts


def test_pattern_bounds(make_inc):
    def active(n):
        return [1] * n + [0] * (12 - n)
    df = make_inc([wide_row(muni_key=i, months=active(n)) for i, n in enumerate([10, 9, 4, 3, 1, 0])]
                  + [wide_row(muni_key=99, months=[None] * 12)])
    got = _vals(df.select(R.occurrence_pattern().alias("p")), "p")
    L = R.PATTERN_LABELS
    assert got == [L[0], L[1], L[1], L[2], L[2], L[3], L[4]]


def test_trend(make_inc):
    even = [1] * 12
    up = [0] * 6 + [1] * 6
    down = [1] * 6 + [0] * 6
    hole = [1] * 11 + [None]
    df = make_inc([wide_row(months=m) for m in (even, up, down, hole)])
    got = _vals(df.select(R.half_year_trend().alias("t")), "t")
    assert got == ["Criminalidad Estable", "Alza Criminal en Semestre 2",
                   "Reducción Criminal en Semestre 2", "Datos Incompletos"]


def test_quarter_and_month_name(spark):
    df = spark.createDataFrame([(m,) for m in range(1, 13)], "month int")
    rows = df.select(R.quarter_of_month("month").alias("q"), R.month_name("month").alias("n")).collect()
    assert [r.q for r in rows] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 4]
    assert rows[0].n == "ENERO" and rows[11].n == "DICIEMBRE"


def test_crime_class_weight_urgency(spark):
    goods = ["La vida y la Integridad corporal", "Libertad personal", "El patrimonio", "La familia",
             "La libertad y la seguridad sexual", "Otro"]
    df = spark.createDataFrame([(g, 10.0) for g in goods], "legal_good string, rate_100k double")
    cls = R.crime_class("legal_good")
    rows = df.select(cls.alias("c"), R.class_weight(cls).alias("w"),
                     R.urgency_index("rate_100k", R.class_weight(cls)).alias("u")).collect()
    assert [r.c for r in rows] == ["violent", "violent", "patrimonial", "family", "sexual", "other"]
    assert [r.w for r in rows] == [10, 10, 3, 6, 9, 1]
    assert [r.u for r in rows] == [100.0, 100.0, 30.0, 60.0, 90.0, 10.0]


def test_enrich_is_one_projection(make_inc):
    df = make_inc([wide_row()])
    plan = Q.enrich(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_month_overflow_guard(spark):
    rows = [(1, "A", "F", i) for i in range(13)] + [(2, "A", "F", i) for i in range(12)]
    long = spark.createDataFrame(rows, "muni_key bigint, legal_good string, modality string, month int")
    v = Q.month_overflow(long).collect()
    assert [(r.muni_key, r.n_counts) for r in v] == [(1, 13)]


def test_explorer_filters_and_counts(make_inc):
    from terrastat.functions.records import FIXTURE_LEGAL_GOOD_CLASS
    df = make_inc([wide_row(muni_key=1, state="A", months=[5] * 12, population=1000),
                   wide_row(muni_key=2, state="B", months=[0] * 12, population=1000)])
    assert Q.filter_records(df, state="ZZ").count() == 0
    assert Q.filter_records(df).count() == 2
    e = Q.enrich(df, mapping=FIXTURE_LEGAL_GOOD_CLASS)
    rc = {r.risk: r.records_at_level for r in Q.risk_counts(e).collect()}
    assert rc == {"Alto": 1, "Medio": 0, "Bajo": 1}
    pm = Q.predominant_month(e).first()
    assert pm.predominant_month == "ENERO" and pm.records == 1
    none = Q.predominant_month(Q.enrich(Q.filter_records(df, state="B"))).first()
    assert none.predominant_month == "Sin incidentes"


def test_sample_exact_size_and_reproducible(make_inc):
    df = make_inc([wide_row(muni_key=i) for i in range(50)])
    a = Q.sample_exact(df, n=7)
    b = Q.sample_exact(df.repartition(5), n=7)
    ka = sorted(r.muni_key for r in a.collect())
    assert len(ka) == 7 and ka == sorted(r.muni_key for r in b.collect())
    assert Q.sample_exact(df, n=500).count() == 50


def test_sample_exact_takes_the_smallest_hashes(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("muni_key"), F.lit("G").alias("legal_good"),
                                     (F.col("id") % 2).cast("string").alias("modality"))
    order = Q.sample_order(["muni_key", "legal_good", "modality"], Q.SAMPLE_SEED)
    want = sorted(r.muni_key for r in df.orderBy(order).limit(25).collect())
    got = sorted(r.muni_key for r in Q.sample_exact(df, n=25).collect())
    assert len(got) == 25 and got == want


def test_records_of_different_subtypes_and_years_have_their_own_ids(make_inc):
    df = make_inc([wide_row(muni_key=1), wide_row(muni_key=1)])
    years = df.withColumn("subtype", F.lit("a")).unionByName(df.withColumn("subtype", F.lit("b")))
    years = years.dropDuplicates(["subtype"]).crossJoin(df.sparkSession.range(2015, 2018).select(
        F.col("id").cast("int").alias("year")))
    ids = Q.enrich(years).select("record_id", "year").collect()
    assert len({r.record_id for r in ids}) == 6 and {r.year for r in ids} == {2015, 2016, 2017}
