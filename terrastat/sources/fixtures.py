"""Incidence-shaped views derived from the star schema.

Role mapping: supplier = municipality, nation = state, ``p_type`` = legal good,
``l_linestatus`` = modality, year and month of ``l_shipdate`` = year and month
column, ``l_quantity`` = cases. ``p_brand`` gives the mart features.

All views are lazy DataFrames over whole tables: scans are column-pruned and
the month columns come from one partially aggregated group-by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastat.functions.records import MONTH_COLS, rate_per_100k
from terrastat.operators.common import scalars
from terrastat.operators.etl import pivot_matrix
from terrastat.sources.tables import read_table

# Fixed values of the fixture: the population shaping.
POPULATION_SCALE = 1500000
ACCTBAL_SHIFT = 1000.0
ACCTBAL_SPAN = 11000.0


def muni(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per municipality: key, name, state key/name, population.

    Population is a cubic reshaping of the account balance so that every
    settlement class occurs (and population 0 occurs at larger scales).
    """
    s = read_table(spark, sf_dir, "supplier").select(
        "s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    x = (F.col("s_acctbal") + F.lit(ACCTBAL_SHIFT)) / F.lit(ACCTBAL_SPAN)
    return (s.join(n, s.s_nationkey == n.n_nationkey)
            .select(F.col("s_suppkey").cast("bigint").alias("muni_key"),
                    F.col("s_name").alias("muni"),
                    F.col("n_nationkey").alias("state_key"),
                    F.col("n_name").alias("state"),
                    F.floor(x * x * x * F.lit(POPULATION_SCALE))
                    .cast("bigint").alias("population")))


def inc_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide incidence counts: (muni_key, legal_good, modality, year, m01..m12,
    total), a record for every year of the fact table.

    One group-by over lineitem ⋈ part with conditional sums; partial
    aggregation runs before the shuffle.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_quantity", "l_linestatus", "l_shipdate")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    month = F.month("l_shipdate")
    q = F.col("l_quantity").cast("bigint")
    keys = [F.col("l_suppkey").cast("bigint").alias("muni_key"),
            F.col("p_type").alias("legal_good"),
            F.col("l_linestatus").alias("modality"),
            F.year("l_shipdate").alias("year")]
    aggs = [F.sum(F.when(month == i, q).otherwise(F.lit(0).cast("bigint"))).cast("bigint").alias(c)
            for i, c in enumerate(MONTH_COLS, start=1)]
    aggs.append(F.sum(q).cast("bigint").alias("total"))
    return j.groupBy(*keys).agg(*aggs)


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full incidence record table in canonical column order, then year.

    Left join keeps a null population for unmatched municipalities (E11);
    ``crime_type`` and ``subtype`` carry the legal good at this grain.
    """
    w = inc_wide(spark, sf_dir)
    m = muni(spark, sf_dir)
    j = w.join(m, "muni_key", "left")
    return j.select(
        "state_key", "state", "muni_key", "muni", "legal_good",
        F.col("legal_good").alias("crime_type"),
        F.col("legal_good").alias("subtype"),
        "modality", *MONTH_COLS, "total", "population",
        rate_per_100k(F.col("total"), F.col("population")).alias("rate_100k"), "year")


def mart_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long mart: (muni_key, feature, value), feature = brand with '#'→'_'."""
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return (j.groupBy(F.col("l_suppkey").cast("bigint").alias("muni_key"),
                      F.regexp_replace("p_brand", "#", "_").alias("feature"))
            .agg(F.sum(F.col("l_quantity").cast("bigint")).cast("bigint").alias("value")))


def mart_features(spark: SparkSession, sf_dir: str) -> list[str]:
    """Feature names of the mart in a stable (natural numeric) order.

    Derived from ``part`` (a dimension), not from the fact table: one small
    distinct over brands, sorted by the numeric brand suffix.
    """
    rows = (read_table(spark, sf_dir, "part")
            .select(F.regexp_replace("p_brand", "#", "_").alias("f")).distinct().collect())
    names = [r.f for r in rows if r.f is not None]

    def _k(name: str):
        tail = name.rsplit("_", 1)[-1]
        return (int(tail) if tail.isdigit() else 10 ** 9, name)
    return sorted(names, key=_k)


def mart(spark: SparkSession, sf_dir: str, features: list[str] | None = None) -> DataFrame:
    """Wide mart: muni ids + one column per feature, 0 where absent."""
    feats = features or mart_features(spark, sf_dir)
    # straight from lineitem ⋈ part: one partially aggregated pass keyed by
    # municipality (no long intermediate, no second shuffle)
    li = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").cast("bigint").alias("muni_key"),
        F.regexp_replace("p_brand", "#", "_").alias("feature"),
        F.col("l_quantity").cast("bigint").alias("value"))
    wide = pivot_matrix(rows, ["muni_key"], "feature", "value", feats)
    m = muni(spark, sf_dir).select("muni_key", "muni", "state", "population")
    return m.join(wide, "muni_key", "left").select(
        "muni_key", "muni", "state", "population",
        *[F.coalesce(f, F.lit(0)).cast("bigint").alias(f) for f in feats])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two standardised features per customer: order count and mean price
    (population standard deviation), the DBSCAN input with an SQL oracle."""
    o = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    r = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg("o_totalprice").alias("a"))
    g = r.withColumn("_g", scalars(r, mn=F.avg("n"), sn=F.stddev_pop("n"),
                                   ma=F.avg("a"), sa=F.stddev_pop("a")))
    return g.select("k", ((F.col("n") - F.col("_g.mn")) / F.col("_g.sn")).alias("x"),
                    ((F.col("a") - F.col("_g.ma")) / F.col("_g.sa")).alias("y"))


def population_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw population table shaped like a census extract: one row per
    municipality × year × sex, totals among the sexes, with accented names,
    derived from ``muni`` (E10 input). The older year has half of everyone."""
    m = muni(spark, sf_dir)
    half = F.floor(F.col("population") / 2).cast("bigint")
    older = lambda c: F.floor(c / 2).cast("bigint")
    rows = [(sex, 2015, pop) for sex, pop in (("Hombres", half), ("Mujeres", F.col("population") - half),
                                              ("Total", F.col("population")))]
    rows += [(sex, 2010, older(pop)) for sex, _, pop in rows]
    sexes = F.array(*[F.struct(F.lit(sex).alias("sex"), F.lit(year).alias("year"), pop.alias("pop"))
                      for sex, year, pop in rows])
    return (m.select("muni_key", "muni", "state_key", F.explode(sexes).alias("s"))
            .select("muni_key",
                    F.concat(F.lit("Múnicipio "), F.col("muni")).alias("muni"),
                    "state_key", F.col("s.sex").alias("sex"),
                    F.col("s.year").alias("year"), F.col("s.pop").alias("population")))
