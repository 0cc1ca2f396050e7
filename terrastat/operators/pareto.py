"""Pareto concentration P1-P7."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.functions.records import rate_per_100k
from terrastat.operators.common import checkpointed, scalars
from terrastat.operators.scan import DEFAULT_ROWS_PER_RANGE, global_prefix

PARETO_SHARE = 80  # fixed value: the 80/20 cut, in percent


def muni_rollup_pareto(inc: DataFrame) -> DataFrame:
    """P1+P2: one row per (muni_key, muni, state): summed total, max
    population, safe rate. Rows with a null grouping key are dropped (pandas
    group-by semantics); an all-null total sums to 0."""
    keys = ["muni_key", "muni", "state"]
    return (inc.select(*keys, "total", "population").dropna(subset=keys)
            .groupBy(*keys)
            .agg(F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"),
                 F.max("population").alias("population"))
            .withColumn("rate_100k", rate_per_100k("total", "population")))


def pareto_curve(inc: DataFrame, rows_per_range: int = DEFAULT_ROWS_PER_RANGE) -> DataFrame:
    """Rank 1..n in (total desc, muni_key), running total, share and
    cumulative share in percent (null when the grand total is 0)."""
    # the roll-up is read three times (count, grand total, ranking): write it
    # once to the shared checkpoint folder
    r = checkpointed(muni_rollup_pareto(inc))
    ranked = global_prefix(r, [("total", False), ("muni_key", True)], "total",
                           cum_col="cum_total", rank_col="rank",
                           rows_per_range=rows_per_range, materialize=False)
    ranked = ranked.withColumn("_g", scalars(r, grand=F.sum("total")))
    grand = F.col("_g.grand")
    share = F.when(grand != 0, F.col("total") * 100.0 / grand)
    cum = F.when(grand != 0, F.col("cum_total") * 100.0 / grand)
    return ranked.select("rank", "muni_key", "muni", "state", "total", "population",
                         "rate_100k", F.col("cum_total").cast("bigint").alias("cum_total"),
                         share.alias("share_pct"), cum.alias("cum_pct"),
                         (F.col("cum_total") * 100 <= grand * PARETO_SHARE).alias("critical"))


def pareto_critical(curve: DataFrame) -> DataFrame:
    """Rows whose cumulative share is <= 80% (integer comparison; the
    crossing row is excluded)."""
    return curve.where(F.col("critical")).drop("critical")


@dataclass
class ParetoResult:
    curve: DataFrame
    critical: DataFrame
    summary: DataFrame


def pareto_summary(curve: DataFrame) -> DataFrame:
    """P5: critical count, municipality count, % of territory, grand total."""
    crit = F.sum(F.when(F.col("critical"), 1).otherwise(0)).cast("bigint")
    n = F.count(F.lit(1)).cast("bigint")
    return curve.agg(
        crit.alias("critical_count"), n.alias("municipalities"),
        F.when(n > 0, crit * 100.0 / n).alias("territory_pct"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("grand_total"))


def calculate_pareto(inc: DataFrame) -> ParetoResult:
    curve = pareto_curve(inc)
    return ParetoResult(curve=curve, critical=pareto_critical(curve), summary=pareto_summary(curve))


def pareto_top(curve: DataFrame, n: int = 10) -> DataFrame:
    """Top-n by volume with the thousands-separated display string."""
    return (curve.orderBy(F.col("total").desc(), F.col("muni_key")).limit(n)
            .select("rank", "muni_key", "muni", "state", "total",
                    F.format_number(F.col("total"), 0).alias("total_display"),
                    "cum_pct"))
