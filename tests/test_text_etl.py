import os
import tempfile

import pytest
from pyspark.sql import functions as F

from terrastat.functions.text import feature_label, strip_accents, title_case
from terrastat.operators import etl as E


def test_strip_accents(spark):
    df = spark.createDataFrame([("Ávila Müñoz",)], "s string")
    assert df.select(strip_accents("s").alias("x")).first().x == "Avila Munoz"


def test_title_case_like_python(spark):
    words = ["robo_a_casa-habitación", "d'artagnan x", "3d objeto", "ÁRBOL grande", "robo de vehículo"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    got = [r.x for r in df.select(feature_label("s").alias("x")).collect()]
    assert got == [w.replace("_", " ").title() for w in words]
    assert df.select(title_case("s").alias("x")).first().x == words[0].title()


def test_latin1_csv(spark):
    d = tempfile.mkdtemp(prefix="terrastat-latin1-")
    p = os.path.join(d, "in.csv")
    header = ",".join(E.CONTRACT)
    row = ["1", "Estado", "7", "Le\xf3n", "El patrimonio", "Robo", "Robo", "Con violencia"] + ["1"] * 12 + ["12", "5000"]
    with open(p, "wb") as fh:
        fh.write((header + "\n" + ",".join(row) + "\n").encode("latin-1"))
    df = E.read_incidence_csv(spark, p, encoding="ISO-8859-1")
    r = df.first()
    assert r.muni == "León" and r.total == 12 and r.population == 5000


def test_contract_drop_and_missing(spark):
    df = spark.createDataFrame([(1, 2)], "a int, NOM_ENT int")
    assert E.drop_columns(df, ["NOM_ENT", "NOM_MUN"]).columns == ["a"]
    with pytest.raises(KeyError):
        E.select_contract(df)


def test_pivot_zero_fill(spark):
    long = spark.createDataFrame([(1, "Brand_1", 5), (1, "Brand_2", 3), (2, "Brand_1", 4)],
                                 "muni_key bigint, feature string, value bigint")
    wide = E.pivot_matrix(long, ["muni_key"], "feature", "value", ["Brand_1", "Brand_2"])
    got = {r.muni_key: (r.Brand_1, r.Brand_2) for r in wide.collect()}
    assert got == {1: (5, 3), 2: (4, 0)}


def test_population_merge_keeps_unmatched(spark):
    inc = spark.createDataFrame([(1, 10), (2, 20)], "muni_key bigint, total bigint")
    pop = spark.createDataFrame([(1, "Múni", 5), (1, "Múni", 5)], "muni_key bigint, muni string, population bigint")
    clean = E.clean_population(pop)  # one year, no totals among the parts
    assert clean.first().muni == "Muni" and clean.first().population == 10
    m = {r.muni_key: (r.population, r.rate_100k) for r in E.merge_population(inc, clean).collect()}
    assert m == {1: (10, 100000.0), 2: (None, 0.0)}


def test_standardise_catalogue(spark):
    inc = spark.createDataFrame([(1, " x ", 3), (9, "y", None)], "state_key int, state string, m01 bigint")
    cat = spark.createDataFrame([(1, "UNO")], "cat_key int, cat_name string")
    std, bad = E.standardise(inc, cat)
    rows = {r.state_key: (r.state, r.m01) for r in std.collect()}
    assert rows == {1: ("UNO", 3), 9: ("y", 0)}
    assert [r.state_key for r in bad.collect()] == [9]


def test_write_round_trip_partitioned(spark):
    from terrastat.session import scratch_path
    df = spark.createDataFrame([(1, "a"), (2, "b")], "state_key int, v string")
    p = scratch_path(spark, "t-roundtrip")
    E.write_table(df, p, partition_by=["state_key"])
    back = spark.read.parquet(p)
    assert sorted((r.state_key, r.v) for r in back.collect()) == [(1, "a"), (2, "b")]
    assert back.where(F.col("state_key") == 1).count() == 1


def test_mart_csv_dynamic_columns(spark):
    d = tempfile.mkdtemp(prefix="terrastat-mart-")
    p = os.path.join(d, "mart.csv")
    with open(p, "w", encoding="utf-8") as fh:
        fh.write("Cve_Municipio,Municipio,Poblacion_Total,Robo_a_casa,Fraude,Total\n")
        fh.write("1,León,20000,5,0,5\n2,Ags,8000,1,2,3\n")
    df = E.read_mart_csv(spark, p)
    assert df.columns == ["Cve_Municipio", "Municipio", "Poblacion_Total", "Robo_a_casa", "Fraude", "Total"]
    assert dict(df.dtypes)["Robo_a_casa"] in ("int", "bigint")
    assert df.where("Cve_Municipio = 1").first().Municipio == "León"
    from terrastat.session import scratch_path
    pq = E.mart_csv_to_parquet(spark, p, scratch_path(spark, "t-mart"))
    assert pq.schema == df.schema and pq.count() == 2


def test_profile(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(10)], "k int, v string")
    counts, head = E.profile(df, ["k"])
    c = counts.first()
    assert (c.n_rows, c.n_columns) == (10, 2)
    assert [r.k for r in head.collect()] == [0, 1, 2]


# --- quarantine, layout, co-location ----------------------------------------------
def test_quarantine_sets_broken_records_aside(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("name", T.StringType()),
                           T.StructField("v", T.LongType())])
    lines = ["k,name,v", "1,a,10", '2,"b, c",20', "3,d", "4,e,40,x", "5,f,many", "six,g,60", "7,,", "8,h,",
             '9,"quoted, twice",90', "", "99999999999,i,1"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    good, bad = E.read_incidence_quarantine(spark, str(tmp_path / "in.csv"), schema=schema,
                                            canonical=False)
    assert sorted(tuple(r) for r in good.collect()) == [
        (1, "a", 10), (2, "b, c", 20), (7, None, None), (8, "h", None), (9, "quoted, twice", 90)]
    got = {r.record: r.reason for r in bad.collect()}
    assert got == {"3,d": "too few fields", "4,e,40,x": "too many fields", "5,f,many": "not a number: v",
                   "six,g,60": "not a number: k", "99999999999,i,1": "not a number: k"}
    assert {r.file for r in bad.collect()} == {"in.csv"}
    assert good.select("name").count() == 5  # a pruned read sees the same rows
    (tmp_path / "none.csv").write_text("k,name,v\n")
    good, bad = E.read_incidence_quarantine(spark, str(tmp_path / "none.csv"), schema=schema,
                                            canonical=False)
    assert good.count() == 0 and bad.count() == 0


def test_quarantine_reads_latin1(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("v", T.LongType())])
    (tmp_path / "in.csv").write_bytes("name,v\nÁvila,1\nMüñoz,x\n".encode("latin-1"))
    good, bad = E.read_incidence_quarantine(spark, str(tmp_path / "in.csv"), "ISO-8859-1", schema,
                                            canonical=False)
    assert [r.name for r in good.collect()] == ["Ávila"]
    assert [r.record for r in bad.collect()] == ["Müñoz,x"]


def test_clustered_files_are_skipped_by_any_filter(spark, tmp_path):
    import pyarrow.parquet as pq
    rows = [(f"s{i % 13:02d}", f"m{i % 89:02d}", f"g{i % 31:02d}", i) for i in range(12_000)]
    rows += [(None, "m00", "g00", -1)] * 50
    df = spark.createDataFrame(rows, "state string, muni string, legal_good string, v long").repartition(5)
    path = str(tmp_path / "z")
    table = E.write_clustered(df, path, ["state", "muni", "legal_good"], 32)
    assert sorted(map(repr, table.collect())) == sorted(map(repr, df.collect()))
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "z").glob("part-*.parquet")]
    assert len(files) >= 24

    def kept(**want):
        n = 0
        for f in files:
            ranges = {}
            for g in range(f.num_row_groups):
                for c in range(f.num_columns):
                    col = f.row_group(g).column(c)
                    if col.statistics is not None and col.statistics.has_min_max:
                        lo, hi = col.statistics.min, col.statistics.max
                        a, b = ranges.get(col.path_in_schema, (lo, hi))
                        ranges[col.path_in_schema] = (min(a, lo), max(b, hi))
            n += all(c in ranges and ranges[c][0] <= v <= ranges[c][1] for c, v in want.items())
        return n / len(files)

    # each filter alone skips files, and together they skip most
    for want in ({"state": "s05"}, {"muni": "m40"}, {"legal_good": "g17"}):
        assert kept(**want) <= 0.75, want
    assert kept(state="s05", muni="m40") <= 0.5
    assert kept(state="s05", muni="m40", legal_good="g17") <= 0.3
    plan = table.where("state = 's05'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(state,s05)" in plan


def test_clustering_defined_cases(spark, tmp_path):
    schema = "state string, muni string, v long"
    empty = spark.createDataFrame([], schema)
    assert E.write_clustered(empty, str(tmp_path / "a"), ["state", "muni"], 4).count() == 0
    nulls = spark.createDataFrame([(None, None, 1), (None, None, 1), ("a", None, None)], schema)
    assert E.write_clustered(nulls, str(tmp_path / "b"), ["state", "muni"], 4).count() == 3


def test_bucketed_merge_shuffles_no_facts(spark):
    from terrastat.plans.registry import QUERIES
    from tests.conftest import SF001
    merged = QUERIES["etl_merge_bucketed"](spark, SF001)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merged._jdf.queryExecution().executedPlan().toString()
        rows = merged.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    want = QUERIES["etl_merge_rate"](spark, SF001).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
