"""Explorer queries Q1-Q6 and landing KPIs K1-K4."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastat.functions import records as R
from terrastat.operators.common import checkpointed
from terrastat.operators.scan import global_prefix

# Filter sentinels and the empty-month text.
ALL_STATES = "Todas"
ALL_OTHER = "Todos"
NO_INCIDENTS = "Sin incidentes"
SAMPLE_SIZE = 100000
SAMPLE_SEED = 42
CARDS = 50

# what makes a record one of its kind: place, crime down to subtype, modality, year
NATURAL_KEY = ["muni_key", "legal_good", "crime_type", "subtype", "modality", "year"]


def _key(df: DataFrame, key: list[str]) -> list[str]:
    """The key columns that ``df`` has."""
    return [k for k in key if k in df.columns]


def sample_order(key: list[str], seed: int) -> Column:
    """60 uniform bits from MD5 of the seed and the key values."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def sample_exact(df: DataFrame, n: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED,
                 key: list[str] = NATURAL_KEY) -> DataFrame:
    """Q1: exactly ``n`` rows (the whole table when smaller), reproducible
    for a seed and independent of partitioning: the n smallest values of a
    seeded hash of the natural key (the key breaks hash ties).

    Rows whose (uniform) hash falls below a cut with margin survive, the cut
    being widened if too few do; the survivors are ranked exactly with the
    range-partitioned ``global_prefix``, so no task sees partitions × n rows.
    """
    key = _key(df, key)
    keyed = df.withColumn("_h", sample_order(key, seed))
    total = df.count()
    frac = min(1.0, 1.2 * n / max(total, 1) + 1000.0 / max(total, 1))
    while True:
        cand = checkpointed(keyed.where(F.col("_h") < F.lit(int(frac * 2 ** 60))))
        if frac >= 1.0 or cand.count() >= n:
            break
        frac = min(1.0, frac * 2)
    ranked = global_prefix(cand, [("_h", True)] + [(k, True) for k in key], None,
                           rank_col="_r", materialize=False)
    return ranked.where(F.col("_r") <= n).drop("_h", "_r")


def filter_options(df: DataFrame, state: str = ALL_STATES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q2: sorted distinct states, municipalities of the chosen state (empty
    when no state is chosen), legal goods."""
    states = df.select("state").where(F.col("state").isNotNull()).distinct()
    munis = (df.where(F.col("state") == state).select("muni").distinct()
             if state != ALL_STATES else df.select("muni").where(F.lit(False)))
    goods = df.select("legal_good").where(F.col("legal_good").isNotNull()).distinct()
    return states, munis, goods


def filter_records(df: DataFrame, state: str = ALL_STATES, muni: str = ALL_OTHER,
                   legal_good: str = ALL_OTHER) -> DataFrame:
    """Q3: conjunction of the active filters (sentinels disable one); the
    predicates reach the parquet scan through Catalyst."""
    preds: list[Column] = []
    if state != ALL_STATES:
        preds.append(F.col("state") == state)
    if muni != ALL_OTHER:
        preds.append(F.col("muni") == muni)
    if legal_good != ALL_OTHER:
        preds.append(F.col("legal_good") == legal_good)
    return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def enrich(df: DataFrame, high: float = R.RISK_HIGH, medium: float = R.RISK_MEDIUM,
           mapping: dict | None = None, year: int = R.DEFAULT_YEAR,
           with_id: bool = True) -> DataFrame:
    """One select deriving every record attribute.
    A record keeps its own year; ``year`` fills in where there is no column."""
    cls = R.crime_class("legal_good", mapping)
    weight = R.class_weight(cls)
    peak = R.peak_month()
    cols = []
    if with_id:
        cols.append(F.xxhash64(*[F.col(k) for k in _key(df, NATURAL_KEY)]).alias("record_id"))
    own_year = F.col("year") if "year" in df.columns else F.lit(year)
    cols += [own_year.alias("year"), "state", "muni_key", "muni", "legal_good", "crime_type",
             "subtype", "modality", "total", "population", "rate_100k",
             R.settlement_class("population").alias("settlement"),
             cls.alias("crime_class"), weight.alias("weight"),
             R.urgency_index(F.col("rate_100k"), weight).alias("urgency"),
             R.risk_level("rate_100k", high, medium).alias("risk"),
             peak.alias("peak_month"), R.month_name(peak).alias("peak_month_name"),
             R.peak_cases().alias("peak_cases"),
             R.half_year_trend().alias("trend"), R.occurrence_pattern().alias("pattern")]
    return df.select(*cols)


def risk_counts(enriched: DataFrame, labels=R.RISK_LABELS) -> DataFrame:
    """Q4: records per risk level, zero-filled over the fixed 3-level domain
    (conditional sums: one partially aggregated pass, no join), plus the
    record count."""
    aggs = [F.sum(F.when(F.col("risk") == lab, 1).otherwise(0)).cast("bigint").alias(f"n_{i}")
            for i, lab in enumerate(labels)]
    one = enriched.agg(*aggs, F.count(F.lit(1)).cast("bigint").alias("records"))
    stacked = ", ".join(f"'{lab}', n_{i}" for i, lab in enumerate(labels))
    return one.selectExpr(f"stack({len(labels)}, {stacked}) as (risk, records_at_level)",
                          "records")


def predominant_month(enriched: DataFrame) -> DataFrame:
    """Q5: most frequent peak month among records whose peak > 0 (earliest
    month on ties); 'Sin incidentes' when none qualifies."""
    counts = (enriched.where(F.col("peak_cases") > 0)
              .groupBy("peak_month").agg(F.count(F.lit(1)).alias("n")))
    best = counts.agg(F.min_by("peak_month", F.struct(-F.col("n"), F.col("peak_month")))
                      .alias("m"), F.max("n").alias("n"))
    return best.select(F.coalesce(R.month_name(F.col("m")), F.lit(NO_INCIDENTS))
                       .alias("predominant_month"),
                       F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("records"))


def record_cards(enriched: DataFrame, n: int = CARDS) -> DataFrame:
    """Q6: the first ``n`` record cards in natural-key order; each card uses
    its own population (the reference used the first row's for all)."""
    title = F.concat_ws("", F.col("muni"), F.lit(" | "), F.col("subtype"), F.lit(" ("),
                        F.col("modality"), F.lit(")"))
    return (enriched.orderBy(*_key(enriched, NATURAL_KEY)).limit(n)
            .select(title.alias("title"), "muni_key", "legal_good", "modality", "subtype", "year",
                    F.col("weight").alias("priority"), "urgency", "settlement", "rate_100k",
                    "risk", "peak_month_name", "peak_cases", "trend", "pattern"))


def kpi_total(df: DataFrame) -> DataFrame:
    """K1: total volume (row count when there is no total column)."""
    if "total" in df.columns:
        return df.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total_cases"))
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total_cases"))


def kpi_municipalities(df: DataFrame, by: str = "muni", approx: bool = False) -> DataFrame:
    """K2: distinct municipality names (homonyms collapse; ``by='muni_key'``
    counts keys). ``approx`` uses HyperLogLog++ for very large inputs."""
    f = F.approx_count_distinct(by) if approx else F.countDistinct(by)
    return df.agg(f.cast("bigint").alias("municipalities"))


def top_by_volume(df: DataFrame, key: str, out: str) -> DataFrame:
    """K3/K4: the key with the largest summed total, ties -> smallest key."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("volume"))
    return g.orderBy(F.col("volume").desc(), F.col(key)).limit(1).select(
        F.col(key).alias(out), "volume")


def month_overflow(long: DataFrame, keys: list[str] = NATURAL_KEY, limit: int = 12) -> DataFrame:
    """R5 guard for long monthly input: records carrying more than ``limit``
    monthly counts (one partially aggregated group-by)."""
    return (long.groupBy(*_key(long, keys)).agg(F.count(F.lit(1)).cast("bigint").alias("n_counts"))
            .where(F.col("n_counts") > limit))


def state_municipalities(muni: DataFrame) -> DataFrame:
    """Each state's distinct municipalities in name order, one row each
    with its place in the state."""
    order = Window.partitionBy("state_key", "state").orderBy("muni", "muni_key")
    return (muni.select("state_key", "state", "muni_key", "muni").distinct()
            .withColumn("position", F.row_number().over(order)))
