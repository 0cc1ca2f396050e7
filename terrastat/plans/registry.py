"""Named queries: (spark, sf_dir) -> DataFrame, one per operator group.

Every query reads the driver's parquet tables (through the fixture views of
``terrastat.sources.fixtures``) and runs over whole tables. Output columns are
aliased to match ``terrastat.plans.oracle``; derived doubles are rounded to 6
digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastat.functions import records as R
from terrastat.operators import dbscan as DB
from terrastat.operators import dependence as D
from terrastat.operators import descriptive as A
from terrastat.operators import etl as E
from terrastat.operators import explore as Q
from terrastat.operators import features as FE
from terrastat.operators import kmeans as KM
from terrastat.operators import pareto as P
from terrastat.operators import profiles as PR
from terrastat.operators import sparse as SP
from terrastat.operators.common import checkpointed
from terrastat.operators.silhouette import best_k, silhouette_means, silhouette_score
from terrastat.session import scratch_path
from terrastat.sources import fixtures as fx
from terrastat.sources.tables import read_table

KEYS = ["muni_key", "legal_good", "modality", "year"]
# parameters of the registered queries (fixture-specific choices)
FILTER_STATE = "NATION_1"
FILTER_GOOD = "PROMO"
POINTS_EPS = 0.2
POINTS_MIN_SAMPLES = 10
KMEANS_LABELS = 4          # fixed labels: muni_key % 4
SWEEP_KS = range(2, 9)


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _inc(spark, sf):
    return fx.incidence(spark, sf)


def _counts(spark, sf):
    """The wide monthly counts alone: queries that need no municipality
    attribute skip the municipality join (Catalyst cannot drop a left join
    on its own without knowing the key is unique)."""
    return fx.inc_wide(spark, sf)


def _enriched(spark, sf):
    return Q.enrich(_inc(spark, sf), mapping=R.FIXTURE_LEGAL_GOOD_CLASS, with_id=False)


# --- ETL ---------------------------------------------------------------------
def etl_contract(spark, sf):
    ref = E.to_reference_names(_inc(spark, sf)).withColumn("NOM_ENT", F.col("Entidad")) \
        .withColumn("NOM_MUN", F.col("Municipio"))
    return E.select_contract(E.drop_columns(ref))


def etl_round_trip(spark, sf):
    path = scratch_path(spark, "etl-round-trip")
    E.write_table(etl_contract(spark, sf), path, fmt="csv")
    return E.read_incidence_csv(spark, path, canonical=False)


def profile_table(spark, sf):
    return E.profile(etl_contract(spark, sf), ["Cve_Municipio"])[0]


def profile_head(spark, sf):
    # the contract has no year: the counts break ties between a record's years
    return E.profile(etl_contract(spark, sf), ["Cve_Municipio", "Bien_juridico_afectado", "Modalidad",
                                               *E.CONTRACT[8:21]])[1]


def etl_clean_names(spark, sf):
    return E.clean_names(fx.population_long(spark, sf), columns=("muni",)).select(
        "muni_key", "muni", "state_key", "sex", "population")


def etl_annual_total(spark, sf):
    return fx.inc_wide(spark, sf).select(*KEYS, E.annual_total().cast("bigint").alias("annual_total"),
                                         "total")


def etl_population(spark, sf):
    return E.clean_population(fx.population_long(spark, sf))


def etl_merge_rate(spark, sf):
    m = E.merge_population(fx.inc_wide(spark, sf), E.clean_population(fx.population_long(spark, sf)))
    return m.select(*KEYS, "total", "population", r6("rate_100k").alias("rate_100k"))


BUCKETS = 8


def etl_merge_bucketed(spark, sf):
    """E11 + E12 on tables bucketed by municipality: neither side is shuffled."""
    inc = E.bucketed(fx.inc_wide(spark, sf), scratch_path(spark, "inc-bucketed"), "muni_key", BUCKETS)
    pop = E.bucketed(E.clean_population(fx.population_long(spark, sf)),
                     scratch_path(spark, "pop-bucketed"), "muni_key", BUCKETS)
    return E.merge_population(inc, pop).select(*KEYS, "total", "population",
                                               r6("rate_100k").alias("rate_100k"))


def _damaged_csv(spark, sf):
    """The incidence as CSV lines without header, some of them short, long or with
    a word in the place of a number, by the municipality's key."""
    table = etl_contract(spark, sf)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]
    kind = F.pmod("Cve_Municipio", F.lit(7))
    word = [F.when(kind == 3, F.lit("n/d")).otherwise(c) if n == "Marzo" else c
            for n, c in zip(table.columns, cells)]
    line = (F.when(kind == 1, F.concat_ws(",", *cells[:-1]))
            .when(kind == 2, F.concat_ws(",", *cells, F.lit("9")))
            .otherwise(F.concat_ws(",", *word)))
    path = scratch_path(spark, "damaged-csv")
    table.select(line.alias("value")).write.text(path)
    return E.read_incidence_quarantine(spark, path, header=False, canonical=False)


def etl_rejects(spark, sf):
    """E1 quarantine: the broken records and why."""
    return _damaged_csv(spark, sf)[1].select("record", "reason")


def etl_accepted(spark, sf):
    """E1 quarantine: the rows that are whole."""
    return _damaged_csv(spark, sf)[0]


def _catalogue(spark, sf):
    """A catalogue that spells names its own way and lacks every fifth code."""
    nation = read_table(spark, sf, "nation").where(F.col("n_nationkey") % 5 != 0)
    return nation.select(F.col("n_nationkey").alias("cat_key"),
                         F.concat(F.lit(" Edo. "), F.col("n_name")).alias("cat_name"))


def etl_catalogue(spark, sf):
    std, _ = E.standardise(_inc(spark, sf), _catalogue(spark, sf))
    return std.select("state_key", "state", *KEYS, "m01", "total")


def etl_catalogue_unmatched(spark, sf):
    _, bad = E.standardise(_inc(spark, sf), _catalogue(spark, sf))
    return bad.select("state_key", *KEYS)


def etl_mart_csv(spark, sf):
    """The mart written as header CSV and read back with its dynamic
    columns."""
    folder = scratch_path(spark, "mart-csv")
    E.write_table(fx.mart(spark, sf), f"{folder}/csv", fmt="csv")
    mart = E.mart_csv_to_parquet(spark, f"{folder}/csv", f"{folder}/parquet")
    return mart.select(*[F.col(c).cast("bigint") if c not in ("muni", "state") else F.col(c)
                         for c in mart.columns])


def etl_latin1_read(spark, sf):
    """Accented names written in Latin-1 and read back in that encoding."""
    path = scratch_path(spark, "latin1-csv")
    names = fx.population_long(spark, sf).select("muni_key", "muni", "year", "sex", "population")
    names.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    schema = T.StructType([T.StructField("muni_key", T.LongType()), T.StructField("muni", T.StringType()),
                           T.StructField("year", T.IntegerType()), T.StructField("sex", T.StringType()),
                           T.StructField("population", T.LongType())])
    return E.read_incidence_csv(spark, path, encoding="ISO-8859-1", schema=schema, canonical=False)


FILTER_STATE_KEY = 1


def etl_partitioned_read(spark, sf):
    """E4 + E1 with partition pruning: the incidence table written once
    partitioned by state, then one state read back (a partition filter)."""
    table = E.materialize(_inc(spark, sf), scratch_path(spark, "incidence"), ["state_key"])
    return table.where(F.col("state_key") == FILTER_STATE_KEY).select(
        "state_key", "state", *KEYS, "total", "population")


def mart_pivot(spark, sf):
    return fx.mart(spark, sf)


# --- record derivations -------------------------------------------------------
def settlement_class(spark, sf):
    return fx.muni(spark, sf).select("muni_key", "population",
                                     R.settlement_class("population").alias("settlement"))


def _months_long(df):
    return df.select(*KEYS, F.explode(R.months_struct_array()).alias("e")).select(
        *KEYS, F.col("e.month").alias("month"), F.col("e.cases").alias("cases"))


def months_long(spark, sf):
    return _months_long(_counts(spark, sf))


def quarter_totals(spark, sf):
    return (months_long(spark, sf).groupBy("legal_good", R.quarter_of_month("month").alias("quarter"))
            .agg(F.sum("cases").cast("bigint").alias("cases")))


def month_names(spark, sf):
    return (months_long(spark, sf).groupBy("month", R.month_name("month").alias("month_name"))
            .agg(F.sum("cases").cast("bigint").alias("cases")))


def month_overflow(spark, sf):
    """R5 guard on a long input in which one legal good was loaded twice:
    records with more than 12 monthly counts."""
    long = _counts(spark, sf).select(*KEYS, F.explode(R.months_array()).alias("cases"))
    return Q.month_overflow(long.unionByName(long.where(F.col("legal_good") == FILTER_GOOD)))


def peak_month(spark, sf):
    pk = R.peak_month()
    return _counts(spark, sf).select(*KEYS, pk.alias("peak_month"), R.month_name(pk).alias("peak_month_name"),
                                  R.peak_cases().alias("peak_cases"))


def risk_level(spark, sf):
    return _inc(spark, sf).select(*KEYS, r6("rate_100k").alias("rate_100k"),
                                  R.risk_level("rate_100k").alias("risk"))


def half_year_trend(spark, sf):
    s1 = sum((F.col(c) for c in R.MONTH_COLS[:6]), F.lit(0))
    s2 = sum((F.col(c) for c in R.MONTH_COLS[6:]), F.lit(0))
    return _counts(spark, sf).select(*KEYS, s1.cast("bigint").alias("s1"), s2.cast("bigint").alias("s2"),
                                  R.half_year_trend().alias("trend"))


def crime_class_weight(spark, sf):
    cls = R.crime_class("legal_good", R.FIXTURE_LEGAL_GOOD_CLASS)
    return _counts(spark, sf).select(*KEYS, cls.alias("crime_class"), R.class_weight(cls).alias("weight"))


def urgency_index(spark, sf):
    cls = R.crime_class("legal_good", R.FIXTURE_LEGAL_GOOD_CLASS)
    return _inc(spark, sf).select(*KEYS, r6(R.urgency_index("rate_100k", R.class_weight(cls)))
                                  .alias("urgency"))


def occurrence_pattern(spark, sf):
    return _counts(spark, sf).select(*KEYS, R.active_months().cast("int").alias("active_months"),
                                  R.occurrence_pattern().alias("pattern"))


def state_municipalities(spark, sf):
    """Each state's municipalities in order."""
    return Q.state_municipalities(fx.muni(spark, sf))


def record_enriched(spark, sf):
    e = _enriched(spark, sf)
    return e.select(*[r6(c).alias(c) if c in ("rate_100k", "urgency") else F.col(c)
                      for c in e.columns if c != "crime_type"])


# --- explorer and KPIs ---------------------------------------------------------
SAMPLE_ROWS = 500


def sample_exact(spark, sf):
    """Q1 with a size below the row count at every scale."""
    return Q.sample_exact(_counts(spark, sf), SAMPLE_ROWS).select(*KEYS, "total")


def filter_options(spark, sf):
    states, munis, goods = Q.filter_options(_inc(spark, sf), FILTER_STATE)
    return (states.select(F.lit("state").alias("kind"), F.col("state").alias("value"))
            .unionByName(munis.select(F.lit("muni").alias("kind"), F.col("muni").alias("value")))
            .unionByName(goods.select(F.lit("legal_good").alias("kind"),
                                      F.col("legal_good").alias("value"))))


def filtered_records(spark, sf):
    f = Q.filter_records(_inc(spark, sf), state=FILTER_STATE, legal_good=FILTER_GOOD)
    return f.select("state", *KEYS, "total")


CLUSTER_COLUMNS, CLUSTER_FILES = ["state", "muni", "legal_good"], 16


def filtered_records_clustered(spark, sf):
    """Q3 over a table clustered by all three filter columns."""
    table = E.write_clustered(_inc(spark, sf), scratch_path(spark, "clustered"), CLUSTER_COLUMNS,
                              CLUSTER_FILES)
    f = Q.filter_records(table, state=FILTER_STATE, legal_good=FILTER_GOOD)
    return f.select("state", *KEYS, "total")


def risk_counts(spark, sf):
    return Q.risk_counts(_enriched(spark, sf))


def predominant_month(spark, sf):
    return Q.predominant_month(_enriched(spark, sf))


def record_cards(spark, sf):
    c = Q.record_cards(_enriched(spark, sf))
    return c.select(*[r6(x).alias(x) if x in ("urgency", "rate_100k") else F.col(x) for x in c.columns])


def kpi_total(spark, sf):
    return Q.kpi_total(_counts(spark, sf))


def kpi_municipalities(spark, sf):
    return Q.kpi_municipalities(_inc(spark, sf))


def kpi_top_state(spark, sf):
    return Q.top_by_volume(_inc(spark, sf), "state", "top_state")


def kpi_top_good(spark, sf):
    return Q.top_by_volume(_counts(spark, sf), "legal_good", "top_legal_good")


# --- descriptive statistics ---------------------------------------------------
def _rollup(spark, sf):
    return A.muni_rollup(_inc(spark, sf))


def muni_rollup(spark, sf):
    return _rollup(spark, sf).withColumn("rate_100k", r6("rate_100k"))


def descriptive_stats(spark, sf):
    d = A.descriptive_stats(_rollup(spark, sf))
    return d.select("column", *[r6(c).alias(c) for c in d.columns if c != "column"])


SKETCH_COLUMNS = ("total", "m01", "m12")
SKETCH_QS = (0.01, 0.25, 0.5, 0.75, 0.99)


def descriptive_stats_sketch(spark, sf):
    """A3 by sketches over every incidence record: for each column and quantile,
    the number of values and whether the exact rank range of the sketch's answer
    lies within the stated error."""
    rows = fx.inc_wide(spark, sf).select(*SKETCH_COLUMNS)
    one = rows.agg(*A.sketch_quantiles(rows, SKETCH_COLUMNS, SKETCH_QS)).first()
    cells = []
    for c in SKETCH_COLUMNS:
        for q, v in zip(SKETCH_QS, one[f"{c}__q"]):
            cells.append(F.struct(F.lit(c).alias("column"), F.lit(q).alias("q"),
                                  F.count(c).alias("n"), F.count(F.when(F.col(c) < v, 1)).alias("below"),
                                  F.count(F.when(F.col(c) <= v, 1)).alias("upto")))
    ranks = rows.agg(F.array(*cells).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    bound = A.sketch_rank_error()
    off = F.greatest(F.lit(0.0), F.col("below") / F.col("n") - F.col("q"),
                     F.col("q") - F.col("upto") / F.col("n"))
    return ranks.select("column", "q", "n", (off <= bound).alias("within"))


def descriptive_table(spark, sf):
    return A.descriptive_table(A.descriptive_stats(_rollup(spark, sf)), decimals=6)


def rate_histogram(spark, sf):
    h = A.rate_histogram(_rollup(spark, sf))
    return h.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "n")


def rate_box(spark, sf):
    b = A.rate_box(_rollup(spark, sf))
    return b.select(*[r6(c).alias(c) if c != "n_outliers" else F.col(c) for c in b.columns])


def rate_outliers(spark, sf):
    o = A.rate_outliers(_rollup(spark, sf))
    return o.select("muni_key", "muni", "population", "total", r6("rate_100k").alias("rate_100k"))


def top_goods(spark, sf):
    return A.top_goods(_counts(spark, sf))


def top_rate_munis(spark, sf):
    return A.top_rate_munis(_rollup(spark, sf)).select("muni_key", "muni", "population", "total",
                                                       r6("rate_100k").alias("rate_100k"))


def pop_rate_points(spark, sf):
    return A.pop_rate_points(_rollup(spark, sf)).withColumn("rate_100k", r6("rate_100k"))


def lorenz_curve(spark, sf):
    return A.lorenz_curve(_rollup(spark, sf)).select("point", r6("pop_pct").alias("pop_pct"),
                                                     r6("cases_pct").alias("cases_pct"))


def gini(spark, sf):
    return A.gini(_rollup(spark, sf)).select(r6("gini").alias("gini"), "municipalities")


# --- Pareto ---------------------------------------------------------------------
def _curve(spark, sf):
    return P.pareto_curve(_inc(spark, sf))


def _round_curve(c):
    return c.select(*[r6(x).alias(x) if x in ("rate_100k", "share_pct", "cum_pct") else F.col(x)
                      for x in c.columns])


def pareto_curve(spark, sf):
    return _round_curve(_curve(spark, sf))


def pareto_critical(spark, sf):
    return _round_curve(P.pareto_critical(_curve(spark, sf)))


def pareto_summary(spark, sf):
    s = P.pareto_summary(_curve(spark, sf))
    return s.withColumn("territory_pct", r6("territory_pct"))


def pareto_rank(spark, sf):
    return _curve(spark, sf).select("rank", "muni_key", r6("cum_pct").alias("cum_pct"))


def pareto_top10(spark, sf):
    return P.pareto_top(_curve(spark, sf)).withColumn("cum_pct", r6("cum_pct"))


# --- dependence -----------------------------------------------------------------
def _table(spark, sf):
    return D.contingency(_inc(spark, sf))


def contingency(spark, sf):
    return _table(spark, sf)


def chi_square(spark, sf):
    c = D.chi_square(_table(spark, sf))
    p = F.col("p_value")
    return c.select(r6("chi2").alias("chi2"), "dof", r6(p).alias("p_value"),
                    F.when(p > 0, F.round(-F.log10(p), 4)).alias("p_neglog10"), "n")


QUARTERS = ("Q1", "Q2", "Q3", "Q4")


def chi_square_odd(spark, sf):
    """C2 with an odd number of degrees of freedom: records by legal good and
    quarter of the year."""
    li = read_table(spark, sf, "lineitem").select("l_partkey", "l_shipdate")
    part = read_table(spark, sf, "part").select("p_partkey", "p_type")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_type").alias("legal_good"),
        F.concat(F.lit("Q"), F.quarter("l_shipdate").cast("string")).alias("settlement"),
        F.lit(1).alias("total"))
    c = D.chi_square(D.contingency_of(rows, QUARTERS))
    return c.select(r6("chi2").alias("chi2"), "dof", r6("p_value").alias("p_value"), "n")


def cramers_v(spark, sf):
    c = D.chi_square(_table(spark, sf))
    return c.select("n", "min_dim", r6("cramers_v").alias("cramers_v"))


def residuals(spark, sf):
    return D.residuals(_table(spark, sf)).withColumn("residual", r6("residual"))


def hotspots(spark, sf):
    return D.hotspots(D.residuals(_table(spark, sf))).withColumn("residual", r6("residual"))


def column_profile(spark, sf):
    return D.column_profile(_table(spark, sf)).withColumn("pct", r6("pct"))


def dependence_diagnosis(spark, sf):
    d = D.diagnosis(D.chi_square(_table(spark, sf)))
    return d.select("related", "strength", "cramers_v", "p_text")


# --- features -------------------------------------------------------------------
def _prep_rates(spark, sf):
    """F1 + F3, materialised once: every profile operator reads the rates
    at least twice (cluster means and global statistics)."""
    m = FE.filter_population(fx.mart(spark, sf))
    ids, feats = FE.feature_roles(m)
    return checkpointed(FE.feature_rates(m, ids, feats)), ids, feats


def _sparse(spark, sf):
    """The mart's sparse rows: ids + cells of the brands."""
    feats = fx.mart_features(spark, sf)
    cells = SP.sparse_matrix(fx.mart_long(spark, sf), ["muni_key"], "feature", "value", feats)
    m = fx.muni(spark, sf).select("muni_key", "muni", "state", "population")
    mart = m.join(cells, "muni_key", "left").withColumn(
        "cells", F.coalesce("cells", F.array().cast(SP.CELLS.format("bigint"))))
    return mart, feats


def mart_sparse(spark, sf):
    """E14 as sparse rows, a row a cell."""
    mart, _ = _sparse(spark, sf)
    return mart.select("muni_key", F.explode("cells").alias("c")).select("muni_key", "c.position", "c.value")


def features_scaled_sparse(spark, sf):
    """F1 + F3 + F4 on sparse rows, a row a feature."""
    mart, feats = _sparse(spark, sf)
    rates = checkpointed(SP.sparse_rates(FE.filter_population(mart)))
    x = SP.scaled_rows(rates, ["muni_key"], SP.sparse_stats(rates, len(feats)))
    return x.select("muni_key", F.posexplode("x").alias("position", "z")).withColumn("z", r6("z"))


def _round_feats(df, feats):
    return df.select(*[r6(c).alias(c) if c in feats else F.col(c) for c in df.columns])


def features_filtered(spark, sf):
    return FE.filter_population(fx.mart(spark, sf))


def feature_roles(spark, sf):
    """F2 on a mart with ids, excluded aggregates and features: the role the
    operator gives each column, its place in the role, and the column's sum
    over the mart (null for names)."""
    mart = fx.mart(spark, sf)
    every = sum((F.col(c) for c in mart.columns[4:]), F.lit(0))
    mart = mart.withColumn("Total", every).withColumn("Robos_Totales", every)
    ids, feats = FE.feature_roles(mart)
    cells = []
    for c, kind in mart.dtypes:
        role = "id" if c in ids else "feature" if c in feats else "excluded"
        place = (ids if role == "id" else feats).index(c) if role != "excluded" else None
        value = F.lit(None) if kind == "string" else F.sum(c)
        cells.append(F.struct(F.lit(c).alias("feature"), F.lit(role).alias("role"),
                              F.lit(place).cast("int").alias("position"),
                              value.cast("bigint").alias("total")))
    return mart.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def feature_rates(spark, sf):
    rates, ids, feats = _prep_rates(spark, sf)
    return _round_feats(rates, feats)


def features_scaled(spark, sf):
    rates, ids, feats = _prep_rates(spark, sf)
    return _round_feats(FE.standardise(rates, ids, feats), feats)


ALL_DIMS = 64  # coordinates of an embedding


def pca_scores(spark, sf):
    prep = KM.prepare(fx.mart(spark, sf))
    return _round_feats(prep.scores, FE.pc_columns(prep.pca.n_components))


def pca_variance(spark, sf):
    prep = KM.prepare(fx.mart(spark, sf))
    ratios = prep.pca.ratios
    rows = [(i + 1, float(r), float(sum(ratios[:i + 1])), i < prep.pca.n_components)
            for i, r in enumerate(ratios)]
    out = spark.createDataFrame(rows, "component int, ratio double, cumulative double, retained boolean")
    return out.withColumn("ratio", r6("ratio")).withColumn("cumulative", r6("cumulative"))


def _embedding_pca(spark, sf):
    """F4 + F5 over all coordinates of the embeddings, three components at least."""
    names = [f"e{i}" for i in range(ALL_DIMS)]
    wide = _embeddings(spark, sf).select("vec_id", *[
        F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    return FE.pca_scores(FE.standardise(checkpointed(wide), ["vec_id"], names), ["vec_id"], names,
                         min_components=EMBEDDING_PCS)


def pca_embeddings(spark, sf):
    pcs = FE.pc_columns(EMBEDDING_PCS)
    return _round_feats(_embedding_pca(spark, sf).scores.select("vec_id", *pcs), pcs)


def pca_embeddings_variance(spark, sf):
    ratios = _embedding_pca(spark, sf).ratios[:EMBEDDING_PCS]
    return spark.createDataFrame([(i + 1, round(r, 9)) for i, r in enumerate(ratios)],
                                 "component int, ratio double")


# --- silhouette / K -------------------------------------------------------------
def _embeddings(spark, sf):
    return read_table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


EMBEDDING_PCS, EMBEDDING_KS = 3, [3, 8]
SILHOUETTE_TILE = 200  # several tiles at every scale of the driver's tables


def silhouette_exact(spark, sf):
    s = silhouette_score(_embeddings(spark, sf), "vec_id", "embedding", "label",
                         tile_rows=SILHOUETTE_TILE)
    return s.select(r6("silhouette").alias("silhouette"))


def silhouette_sweep(spark, sf):
    """Exact silhouette of the labelings vec_id % K, K = 2..8 (an evaluation
    table computed from the data), all from one pass over the blocks."""
    emb = _embeddings(spark, sf).select("vec_id", "embedding", *[
        F.pmod(F.col("vec_id"), F.lit(k)).alias(f"l{k}") for k in SWEEP_KS])
    means = silhouette_means(emb, "vec_id", "embedding", [f"l{k}" for k in SWEEP_KS],
                             tile_rows=SILHOUETTE_TILE)
    return means.select((F.col("position") + SWEEP_KS[0]).cast("bigint").alias("k"),
                        r6("silhouette").alias("silhouette"))


def best_k_query(spark, sf):
    return best_k(silhouette_sweep(spark, sf))


def kmeans_evaluation(spark, sf):
    ev = KM.evaluate_k(KM.prepare(fx.mart(spark, sf)))
    return ev.select("k", r6("inertia").alias("inertia"), r6("silhouette").alias("silhouette"))


def kmeans_embeddings(spark, sf):
    """M4 over all coordinates of the embeddings: label and distance to the own
    centre for two K of one sweep."""
    points = _embeddings(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    fits, labelled = KM.LL.sweep(points, EMBEDDING_KS, KM.SEED)
    rows = []
    for i, k in enumerate(EMBEDDING_KS):
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in fits[k].centres])
        own = F.zip_with(F.col("x"), centres[F.col("l")[i]], lambda a, b: (a - b) * (a - b))
        rows.append(labelled.select(
            F.col("id").alias("vec_id"), F.lit(k).cast("bigint").alias("k"),
            F.col("l")[i].cast("bigint").alias("cluster"),
            F.round(F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, v: s + v)), 6).alias("distance")))
    return rows[0].unionByName(rows[1])


def kmeans_labels(spark, sf):
    _, lab = KM.fit_labels(KM.prepare(fx.mart(spark, sf)))
    return lab.select("muni_key", "muni", "population", "cluster")


def kmeans_assignment(spark, sf):
    """M4 whatever the seeding: points, clusters, and points that are nearer to
    another centre than to their own (none)."""
    prep = KM.prepare(fx.mart(spark, sf))
    model, lab = KM.fit_labels(prep)
    d2 = [sum(((F.col(c) - float(x)) * (F.col(c) - float(x))
               for c, x in zip(FE.pc_columns(prep.pca.n_components), centre)), F.lit(0.0))
          for centre in model.clusterCenters()]
    own = F.array(*d2)[F.col("cluster").cast("int")]
    return lab.agg(F.count(F.lit(1)).alias("points"), F.countDistinct("cluster").alias("clusters"),
                   F.count(F.when(F.array_min(F.array(*d2)) < own * (1 - 1e-9), 1)).alias("misplaced"))


def kmeans_metrics(spark, sf):
    m = KM.run_kmeans(fx.mart(spark, sf)).metrics
    return m.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


# --- cluster profiles on fixed labels -------------------------------------------
def _labelled_rates(spark, sf):
    rates, ids, feats = _prep_rates(spark, sf)
    return rates.withColumn("cluster", F.pmod(F.col("muni_key"), F.lit(KMEANS_LABELS))), feats


def cluster_summary(spark, sf):
    lab, _ = _labelled_rates(spark, sf)
    return PR.cluster_summary(lab).withColumn("mean_population", r6("mean_population"))


def cluster_zscores(spark, sf):
    lab, feats = _labelled_rates(spark, sf)
    return PR.cluster_zscores(lab, feats).withColumn("z", r6("z"))


def _names(lab, feats):
    return PR.cluster_names(lab, feats)


def cluster_names(spark, sf):
    lab, feats = _labelled_rates(spark, sf)
    n = _names(lab, feats)
    return n.select("cluster", "members", r6("mean_population").alias("mean_population"), "specialty",
                    r6("top_z").alias("top_z"), "cluster_name")


def cluster_members_named(spark, sf):
    lab, feats = _labelled_rates(spark, sf)
    return PR.members_named(lab, _names(lab, feats)).select("muni_key", "cluster", "cluster_name")


def _profiles(spark, sf):
    lab, feats = _labelled_rates(spark, sf)
    return PR.cluster_profiles(lab, _names(lab, feats), feats)


def cluster_profiles(spark, sf):
    return _profiles(spark, sf).withColumn("mean_rate", r6("mean_rate"))


def cluster_top3(spark, sf):
    return PR.cluster_top_features(_profiles(spark, sf))


def cluster_heat(spark, sf):
    return PR.cluster_heat(_profiles(spark, sf)).withColumn("mean_rate", r6("mean_rate"))


# --- DBSCAN ---------------------------------------------------------------------
def dbscan_labels(spark, sf):
    lab = DB.dbscan_labels(fx.points(spark, sf), "k", ["x", "y"], POINTS_EPS, POINTS_MIN_SAMPLES)
    return lab.select("k", "label", "is_core")


EMBEDDING_DIMS = 5
EMBEDDING_EPS = 0.12


def dbscan_high_dims(spark, sf):
    """D1 + D2 in more than three coordinates: the first five raw coordinates of
    the embeddings (no PCA), min_samples 5 meaning automatic: max(4, 2·dims) = 10."""
    coords = [f"e{i}" for i in range(EMBEDDING_DIMS)]
    pts = _embeddings(spark, sf).select("vec_id", *[
        F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(coords)])
    min_samples = DB.effective_min_samples(5, EMBEDDING_DIMS, legacy_auto=True)
    lab = DB.dbscan_labels(pts, "vec_id", coords, EMBEDDING_EPS, min_samples)
    return lab.select(F.col("vec_id").alias("k"), "label", "is_core", "neighbours")


ALL_DIMS_EPS, ALL_DIMS_MIN_SAMPLES = 1.17, 5


def dbscan_embeddings(spark, sf):
    """D2 over all coordinates of the embeddings."""
    coords = [f"e{i}" for i in range(ALL_DIMS)]
    pts = _embeddings(spark, sf).select("vec_id", *[
        F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(coords)])
    lab = DB.dbscan_labels(pts, "vec_id", coords, ALL_DIMS_EPS, ALL_DIMS_MIN_SAMPLES, count_all=False)
    return lab.select(F.col("vec_id").alias("k"), "label", "is_core")


def _dbscan_shape(spark, sf):
    rates, ids, feats = _prep_rates(spark, sf)
    lab = F.when(F.pmod(F.col("muni_key"), F.lit(5)) == 0, F.lit(-1)).otherwise(
        F.pmod(F.col("muni_key"), F.lit(3))).cast("long")
    return rates.withColumn("cluster", lab), feats


def dbscan_members(spark, sf):
    lab, feats = _dbscan_shape(spark, sf)
    return lab.select("muni_key", "muni", "population", "cluster",
                      (F.col("cluster") == -1).alias("is_outlier"))


def dbscan_metrics(spark, sf):
    lab, _ = _dbscan_shape(spark, sf)
    m = DB.dbscan_metrics(lab, POINTS_EPS, POINTS_MIN_SAMPLES, None, None)
    return m.select("n_clusters", "n_outliers", "noise_pct")


def dbscan_summary(spark, sf):
    lab, _ = _dbscan_shape(spark, sf)
    return PR.dbscan_summary(lab).withColumn("mean_population", r6("mean_population"))


def outlier_anomaly(spark, sf):
    lab, feats = _dbscan_shape(spark, sf)
    a = PR.outlier_anomaly(lab, lab, feats)
    return a.withColumn("max_z", r6("max_z"))


def outlier_list(spark, sf):
    lab, feats = _dbscan_shape(spark, sf)
    return PR.outlier_list(PR.outlier_anomaly(lab, lab, feats)).select(
        "muni_key", "muni", "population", "main_anomaly")


def dbscan_display(spark, sf):
    lab, _ = _dbscan_shape(spark, sf)
    return lab.select("muni_key", PR.display_label("cluster").alias("cluster_text"))


def kmeans_cluster_names(spark, sf):
    """M5-M9 on the real K-Means labels (K = 4)."""
    return _round_feats(KM.run_kmeans(fx.mart(spark, sf), sweep=False).names,
                        ["mean_population", "top_z"])


def kmeans_profiles(spark, sf):
    """M10 on the real K-Means labels, long form."""
    return _round_feats(KM.run_kmeans(fx.mart(spark, sf), sweep=False).profiles, ["mean_rate"])


def dbscan_pipeline_outliers(spark, sf):
    """D3, D6, D7 on the real DBSCAN labels of the mart's PCA scores."""
    res = DB.run_dbscan(fx.mart(spark, sf), eps=2.0, min_samples=38)
    m = res.members
    feats = [c for c in m.columns if c not in ("muni_key", "muni", "population", "state",
                                                "cluster", "pc1", "pc2")]
    return _round_feats(PR.outlier_list(PR.outlier_anomaly(m, m, feats), n=None), ["max_z"])


def dbscan_pipeline(spark, sf):
    """D1-D4 end to end on the mart's PCA scores (eps/min_samples of the
    reference's page: 2.0 / 38)."""
    return DB.run_dbscan(fx.mart(spark, sf), eps=2.0, min_samples=38).metrics


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "etl_contract": etl_contract, "etl_round_trip": etl_round_trip,
    "profile_table": profile_table, "profile_head": profile_head,
    "etl_clean_names": etl_clean_names, "etl_annual_total": etl_annual_total,
    "etl_population": etl_population, "etl_merge_rate": etl_merge_rate,
    "etl_merge_bucketed": etl_merge_bucketed, "etl_rejects": etl_rejects, "etl_accepted": etl_accepted,
    "filtered_records_clustered": filtered_records_clustered,
    "etl_catalogue": etl_catalogue, "etl_catalogue_unmatched": etl_catalogue_unmatched,
    "mart_pivot": mart_pivot, "etl_partitioned_read": etl_partitioned_read,
    "etl_mart_csv": etl_mart_csv, "etl_latin1_read": etl_latin1_read,
    "settlement_class": settlement_class, "quarter_totals": quarter_totals,
    "month_names": month_names, "months_long": months_long, "month_overflow": month_overflow,
    "peak_month": peak_month, "risk_level": risk_level, "half_year_trend": half_year_trend,
    "crime_class_weight": crime_class_weight, "urgency_index": urgency_index,
    "occurrence_pattern": occurrence_pattern, "state_municipalities": state_municipalities,
    "record_enriched": record_enriched,
    "sample_exact": sample_exact, "filter_options": filter_options,
    "filtered_records": filtered_records, "risk_counts": risk_counts,
    "predominant_month": predominant_month, "record_cards": record_cards,
    "kpi_total": kpi_total, "kpi_municipalities": kpi_municipalities,
    "kpi_top_state": kpi_top_state, "kpi_top_good": kpi_top_good,
    "muni_rollup": muni_rollup, "descriptive_stats": descriptive_stats,
    "descriptive_table": descriptive_table, "descriptive_stats_sketch": descriptive_stats_sketch,
    "rate_histogram": rate_histogram, "rate_box": rate_box, "rate_outliers": rate_outliers,
    "top_goods": top_goods,
    "top_rate_munis": top_rate_munis, "pop_rate_points": pop_rate_points,
    "lorenz_curve": lorenz_curve, "gini": gini,
    "pareto_curve": pareto_curve, "pareto_critical": pareto_critical,
    "pareto_summary": pareto_summary, "pareto_rank": pareto_rank, "pareto_top10": pareto_top10,
    "contingency": contingency, "chi_square": chi_square, "chi_square_odd": chi_square_odd, "cramers_v": cramers_v,
    "residuals": residuals, "hotspots": hotspots, "column_profile": column_profile,
    "dependence_diagnosis": dependence_diagnosis,
    "features_filtered": features_filtered, "feature_roles": feature_roles,
    "feature_rates": feature_rates, "features_scaled": features_scaled,
    "mart_sparse": mart_sparse, "features_scaled_sparse": features_scaled_sparse,
    "pca_scores": pca_scores, "pca_variance": pca_variance,
    "pca_embeddings": pca_embeddings, "pca_embeddings_variance": pca_embeddings_variance,
    "silhouette_exact": silhouette_exact, "silhouette_sweep": silhouette_sweep,
    "best_k": best_k_query,
    "kmeans_evaluation": kmeans_evaluation, "kmeans_labels": kmeans_labels,
    "kmeans_assignment": kmeans_assignment, "kmeans_embeddings": kmeans_embeddings,
    "kmeans_metrics": kmeans_metrics,
    "cluster_summary": cluster_summary, "cluster_zscores": cluster_zscores,
    "cluster_names": cluster_names, "cluster_members_named": cluster_members_named,
    "cluster_profiles": cluster_profiles, "cluster_top3": cluster_top3, "cluster_heat": cluster_heat,
    "dbscan_labels": dbscan_labels, "dbscan_high_dims": dbscan_high_dims,
    "dbscan_embeddings": dbscan_embeddings, "dbscan_members": dbscan_members,
    "dbscan_metrics": dbscan_metrics, "dbscan_summary": dbscan_summary,
    "outlier_anomaly": outlier_anomaly, "outlier_list": outlier_list,
    "dbscan_display": dbscan_display, "dbscan_pipeline": dbscan_pipeline,
    "dbscan_pipeline_outliers": dbscan_pipeline_outliers,
    "kmeans_cluster_names": kmeans_cluster_names, "kmeans_profiles": kmeans_profiles,
}
