"""Exploratory statistics A1-A10 over the municipality roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.functions.records import rate_per_100k
from terrastat.functions.stats import corrected_kurtosis, corrected_skew
from terrastat.operators.common import checkpointed, scalars
from terrastat.operators.scan import DEFAULT_ROWS_PER_RANGE, column_quantiles, global_prefix

STAT_COLUMNS = ("total", "rate_100k", "population")
QUARTILES = (0.25, 0.5, 0.75)
HIST_BINS = 50
TOP_N = 10
MIN_POPULATION_STRICT = 5000  # fixed value: A7/A8 keep population > 5000
BOX_WHISKER = 1.5


def muni_rollup(inc: DataFrame) -> DataFrame:
    """A1 + A2: sum of total by (muni_key, muni, population); a null key,
    including a null population, drops the row (pandas group-by rule); an
    all-null group sums to 0; safe rate per 100k."""
    keys = ["muni_key", "muni", "population"]
    return (inc.select(*keys, "total").dropna(subset=keys).groupBy(*keys)
            .agg(F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"))
            .withColumn("rate_100k", rate_per_100k("total", "population")))


def _moments(columns) -> list:
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 corrected_skew(x).alias(f"{c}__skew"), corrected_kurtosis(x).alias(f"{c}__kurt")]
    return aggs


def _stat_rows(one: DataFrame, columns) -> DataFrame:
    """One row per column from one row with every column's moments and quartiles."""
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"),
                     F.col(f"{c}__q")[1].alias("median"), F.col(f"{c}__std").alias("std"),
                     F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max"),
                     F.col(f"{c}__q")[0].alias("q1"), F.col(f"{c}__q")[2].alias("q3"),
                     F.col(f"{c}__skew").alias("skew"), F.col(f"{c}__kurt").alias("kurtosis"))
            for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def descriptive_stats(rollup: DataFrame, columns=STAT_COLUMNS, key: str = "muni_key") -> DataFrame:
    """A3: mean, median, sample std, min, max, Q1, Q3, bias-corrected skew and
    excess kurtosis for each column, as one row per column.

    One global aggregate computes the moments (partial aggregation per task);
    the quartiles interpolate linearly between distributed ranks.
    """
    rollup = checkpointed(rollup)
    quartiles = column_quantiles(rollup, list(columns), list(QUARTILES), key)
    one = rollup.agg(*_moments(columns)).select("*", *[
        q.alias(f"{c}__q") for c, q in quartiles.items()])
    return _stat_rows(one, columns)


SKETCH_K = 1024


def sketch_rank_error(k: int = SKETCH_K) -> float:
    """How far, as a part of the rows, the rank of a sketch's quantile may be off
    (with 99 % confidence; the sketch family's published fit)."""
    return 2.296 / k ** 0.9021


def sketch_quantiles(rows: DataFrame, columns, qs, k: int = SKETCH_K) -> list:
    """Per column, an aggregate that gives its approximate quantiles: a mergeable
    KLL sketch, built a task at a time and merged, in one pass without a sort. A
    sketch holds about 3 k numbers, whatever the number of rows; null values don't
    count, and a column without values has null quantiles."""
    out = []
    for c in columns:
        sketch = F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(k))
        quantiles = F.kll_sketch_get_quantile_double(sketch, F.array(*[F.lit(float(q)) for q in qs]))
        out.append(F.when(F.count(c) > 0, quantiles).alias(f"{c}__q"))
    return out


def descriptive_stats_sketch(rollup: DataFrame, columns=STAT_COLUMNS, k: int = SKETCH_K) -> DataFrame:
    """A3 in one pass: the same columns as ``descriptive_stats``, with quartiles
    whose rank is off by ``sketch_rank_error(k)`` of the rows at most."""
    return _stat_rows(rollup.agg(*_moments(columns), *sketch_quantiles(rollup, columns, QUARTILES, k)),
                      columns)


# The reference's statistic labels, in its order.
STAT_LABELS = ("Media", "Mediana", "Desv. Est.", "Mínimo", "Máximo", "Q1 (25%)", "Q3 (75%)",
               "Asimetría", "Curtosis")
STAT_FIELDS = ("mean", "median", "std", "min", "max", "q1", "q3", "skew", "kurtosis")
PRESENTATION_DECIMALS = 2


def descriptive_table(stats: DataFrame, columns=STAT_COLUMNS,
                      decimals: int = PRESENTATION_DECIMALS) -> DataFrame:
    """A3 in the reference's presentation: one row per statistic (labelled,
    with its position), one column per input column, rounded to
    ``decimals``. Reshapes the 3-row result of ``descriptive_stats``."""
    cells = F.array(*[F.struct(F.lit(lab).alias("stat"), F.lit(i).alias("position"),
                               F.col(f).alias("value"))
                      for i, (lab, f) in enumerate(zip(STAT_LABELS, STAT_FIELDS))])
    long = stats.select("column", F.explode(cells).alias("c")).select("column", "c.*")
    return long.groupBy("stat", "position").agg(*[
        F.round(F.max(F.when(F.col("column") == c, F.col("value"))), decimals).alias(c)
        for c in columns])


def rate_histogram(rollup: DataFrame, value: str = "rate_100k", bins: int = HIST_BINS) -> DataFrame:
    """A4: ``bins`` equal-width bins over [min, max]; the maximum lands in the
    last bin. Non-empty bins with their edges and counts."""
    rollup = checkpointed(rollup)  # read twice: bounds and bins
    src = rollup.withColumn("_g", scalars(rollup, mn=F.min(value), mx=F.max(value)))
    mn, mx = F.col("_g.mn"), F.col("_g.mx")
    b = F.when(mx > mn, F.least(F.floor((F.col(value) - mn) / (mx - mn) * bins) + 1,
                                F.lit(bins))).otherwise(F.lit(1)).cast("bigint")
    g = src.where(F.col(value).isNotNull()).groupBy(b.alias("bin"), "_g").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))
    width = (mx - mn) / bins
    return g.select("bin", (mn + (F.col("bin") - 1) * width).alias("bin_lo"),
                    (mn + F.col("bin") * width).alias("bin_hi"), "n")


def _with_quartiles(rollup: DataFrame, value: str, key: str) -> DataFrame:
    rollup = checkpointed(rollup)
    return rollup.withColumn("_q", column_quantiles(rollup, [value], list(QUARTILES), key)[value])


def rate_box(rollup: DataFrame, value: str = "rate_100k", k: float = BOX_WHISKER,
             key: str = "muni_key") -> DataFrame:
    """A5: quartiles, 1.5·IQR fences, whiskers and the outlier count."""
    src = _with_quartiles(rollup, value, key)
    q = F.col("_q")
    q1, med, q3 = q[0], q[1], q[2]
    lo, hi = q1 - (q3 - q1) * k, q3 + (q3 - q1) * k
    x = F.col(value)
    return src.agg(
        F.first(q1).alias("q1"), F.first(med).alias("median"), F.first(q3).alias("q3"),
        F.first(q3 - q1).alias("iqr"), F.first(lo).alias("lower_fence"),
        F.first(hi).alias("upper_fence"),
        F.min(F.when(x >= lo, x)).alias("whisker_lo"), F.max(F.when(x <= hi, x)).alias("whisker_hi"),
        F.sum(F.when((x < lo) | (x > hi), 1).otherwise(0)).cast("bigint").alias("n_outliers"))


def rate_outliers(rollup: DataFrame, value: str = "rate_100k", k: float = BOX_WHISKER,
                  key: str = "muni_key") -> DataFrame:
    """A5 outlier rows: beyond the fences."""
    src = _with_quartiles(rollup, value, key)
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    lo, hi = q1 - (q3 - q1) * k, q3 + (q3 - q1) * k
    return src.where((F.col(value) < lo) | (F.col(value) > hi)).drop("_q")


def top_goods(inc: DataFrame, n: int = TOP_N) -> DataFrame:
    """Legal goods by summed volume, top n (ties by name)."""
    g = inc.where(F.col("legal_good").isNotNull()).groupBy("legal_good").agg(
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"))
    return g.orderBy(F.col("total").desc(), "legal_good").limit(n)


def top_rate_munis(rollup: DataFrame, n: int = TOP_N,
                   min_population: int = MIN_POPULATION_STRICT) -> DataFrame:
    """Municipalities with population > 5000 by rate, top n."""
    return (rollup.where(F.col("population") > min_population)
            .orderBy(F.col("rate_100k").desc(), "muni_key").limit(n))


def pop_rate_points(rollup: DataFrame, min_population: int = MIN_POPULATION_STRICT) -> DataFrame:
    """(population, rate) point set for population > 5000."""
    return rollup.where(F.col("population") > min_population).select(
        "muni_key", "muni", "population", "rate_100k")


def _ranked_ascending(rollup: DataFrame, rows_per_range: int) -> DataFrame:
    r = checkpointed(rollup.select("muni_key", "total"))
    return r, global_prefix(r, [("total", True), ("muni_key", True)], "total",
                            cum_col="cum_total", rank_col="rank",
                            rows_per_range=rows_per_range, materialize=False)


def lorenz_curve(rollup: DataFrame, rows_per_range: int = DEFAULT_ROWS_PER_RANGE) -> DataFrame:
    """Ascending cumulative share with a leading (0, 0) point; x evenly
    spaced over 0..100, both axes in percent."""
    r, ranked = _ranked_ascending(rollup, rows_per_range)
    ranked = ranked.withColumn("_g", scalars(r, n=F.count(F.lit(1)), tot=F.sum("total")))
    n, tot = F.col("_g.n"), F.col("_g.tot")
    pts = ranked.select(F.col("rank").alias("point"),
                        (F.col("rank") * 100.0 / n).alias("pop_pct"),
                        F.when(tot != 0, F.col("cum_total") * 100.0 / tot).alias("cases_pct"))
    # a global aggregate yields exactly one row (also on an empty input): the origin
    origin = r.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(0).cast("bigint").alias("point"), F.lit(0.0).alias("pop_pct"),
        F.lit(0.0).alias("cases_pct"))
    return origin.unionByName(pts)


def gini(rollup: DataFrame, rows_per_range: int = DEFAULT_ROWS_PER_RANGE) -> DataFrame:
    """A10: Gini = 2·Σ(i·x_i)/(n·Σx) − (n+1)/n over the ascending rank, which
    equals 1 − 2·trapezoid(Lorenz) with evenly spaced x."""
    _, ranked = _ranked_ascending(rollup, rows_per_range)
    n = F.count(F.lit(1)).cast("double")
    s = F.sum("total").cast("double")
    # whole decimals: rank times total outgrows 64 bits long before the sum does
    weighted = F.sum(F.col("rank").cast("decimal(38,0)") * F.col("total").cast("decimal(38,0)"))
    return ranked.agg(F.when(s != 0, 2.0 * weighted.cast("double") / (n * s)
                             - (n + 1) / n).alias("gini"),
                      F.count(F.lit(1)).cast("bigint").alias("municipalities"))
