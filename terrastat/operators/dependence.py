"""Categorical dependence C1-C8: volume-weighted contingency of legal good ×
settlement class, chi-square with Yates at dof 1, Cramér's V, residual
hotspots and column profiles.

Everything after the first group-by runs on the contingency table, whose size
is (#legal goods × 3): the only full-data pass is one partially aggregated
group-by. Zero-filling uses conditional sums over the fixed settlement domain
(one aggregation) and an unpivot back (no cross product).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrastat.functions.records import SETTLEMENT_LABELS, settlement_class
from terrastat.functions.stats import chi2_sf
from terrastat.operators.common import checkpointed

# Strength labels, cut points, hotspot rule and alert text.
STRENGTH_LABELS = ("Débil (El entorno influye poco)",
                   "Moderada (El entorno es un factor importante)",
                   "Fuerte (El entorno determina el crimen)")
STRENGTH_CUTS = (0.1, 0.3)
SIGNIFICANCE = 0.05
HOTSPOT_RESIDUAL = 2.0
HOTSPOT_TOP = 3
ALERT_PREFIX = "🔴 En zona "
ALERT_MIDDLE = ", el delito contra '"
ALERT_SUFFIX = "' es anormalmente alto."
P_FLOOR = 0.001
P_FLOOR_TEXT = "< 0.001"


def contingency(inc: DataFrame, labels=SETTLEMENT_LABELS) -> DataFrame:
    """(legal_good, settlement, observed), zero-filled; rows and columns
    with a zero marginal are removed (the reference's library would fail on
    a zero expected count)."""
    return contingency_of(inc.where(F.col("legal_good").isNotNull()).select(
        "legal_good", settlement_class("population").alias("settlement"), "total"), labels)


def contingency_of(tagged: DataFrame, labels) -> DataFrame:
    """The same for rows (legal_good, settlement, total) of any two categories,
    the second with the levels ``labels``."""
    wide = tagged.groupBy("legal_good").agg(*[
        F.sum(F.when(F.col("settlement") == lab, F.col("total"))).alias(lab) for lab in labels])
    stacked = ", ".join(f"'{lab}', coalesce(`{lab}`, 0L)" for lab in labels)
    long = wide.selectExpr("legal_good", f"stack({len(labels)}, {stacked}) as (settlement, observed)")
    long = long.withColumn("observed", F.col("observed").cast("bigint"))
    marginals = long.select("*", *_marginals())  # #goods x levels rows
    keep = marginals.where((F.col("row_total") > 0) & (F.col("col_total") > 0))
    # the only full-data pass: store the table once, every later step (marginals,
    # expected counts, residuals) reads it
    return checkpointed(keep.select("legal_good", "settlement", "observed"))


def _marginals() -> list[F.Column]:
    """Row and column totals beside every cell of the contingency table."""
    total = F.sum("observed")
    return [total.over(Window.partitionBy("legal_good")).alias("row_total"),
            total.over(Window.partitionBy("settlement")).alias("col_total")]


def expected_cells(table: DataFrame) -> DataFrame:
    """Observed, expected = row·col/N."""
    n = table.select(F.sum("observed").alias("n")).scalar()
    return table.select("*", *_marginals()).withColumn(
        "expected", F.col("row_total").cast("double") * F.col("col_total") / n)


def chi_square(table: DataFrame) -> DataFrame:
    """C2 + C3: statistic (Yates-corrected when dof = 1), dof, p-value, N,
    min(r-1, c-1) and Cramér's V (null when a dimension has one level)."""
    e = expected_cells(table)
    diff = F.abs(F.col("observed") - F.col("expected"))
    yates = F.greatest(diff - 0.5, F.lit(0.0))
    one = e.agg(F.sum(diff * diff / F.col("expected")).alias("_plain"),
                F.sum(yates * yates / F.col("expected")).alias("_yates"),
                F.countDistinct("legal_good").alias("_r"),
                F.countDistinct("settlement").alias("_c"),
                F.sum("observed").cast("bigint").alias("n"))
    dof = ((F.col("_r") - 1) * (F.col("_c") - 1)).cast("int")
    with_dof = one.select("*", dof.alias("dof")).select(
        F.when(F.col("dof") == 1, F.col("_yates")).otherwise(F.col("_plain")).alias("chi2"),
        "dof", "n", F.least(F.col("_r") - 1, F.col("_c") - 1).cast("int").alias("min_dim"))
    v = F.when((F.col("min_dim") > 0) & (F.col("n") > 0),
               F.sqrt(F.col("chi2") / (F.col("n") * F.col("min_dim"))))
    p = chi2_sf(F.col("chi2"), F.col("dof"))
    return with_dof.select("chi2", "dof", p.alias("p_value"),
                           "n", "min_dim", v.alias("cramers_v"))


def strength_label(v) -> F.Column:
    """C4: < 0.1 weak, < 0.3 moderate, else strong."""
    c = F.col(v) if isinstance(v, str) else v
    return (F.when(c < STRENGTH_CUTS[0], F.lit(STRENGTH_LABELS[0]))
            .when(c < STRENGTH_CUTS[1], F.lit(STRENGTH_LABELS[1]))
            .otherwise(F.lit(STRENGTH_LABELS[2])))


def residuals(table: DataFrame) -> DataFrame:
    """Pearson residual (o - e)/sqrt(e) per cell."""
    e = expected_cells(table)
    return e.select("settlement", "legal_good",
                    ((F.col("observed") - F.col("expected")) / F.sqrt("expected")).alias("residual"))


def hotspots(res: DataFrame, threshold: float = HOTSPOT_RESIDUAL, top: int = HOTSPOT_TOP) -> DataFrame:
    """Residual > 2.0, top 3 descending, with the alert text."""
    alert = F.concat(F.lit(ALERT_PREFIX), F.upper("settlement"), F.lit(ALERT_MIDDLE),
                     F.col("legal_good"), F.lit(ALERT_SUFFIX))
    return (res.where(F.col("residual") > threshold)
            .orderBy(F.col("residual").desc(), "settlement", "legal_good").limit(top)
            .select("settlement", "legal_good", "residual", alert.alias("alert")))


def column_profile(table: DataFrame) -> DataFrame:
    """Cell / column sum × 100."""
    cols = table.groupBy("settlement").agg(F.sum("observed").alias("_c"))
    return (table.join(F.broadcast(cols), "settlement")  # <= 3 rows
            .select("legal_good", "settlement",
                    F.when(F.col("_c") != 0, F.col("observed") * 100.0 / F.col("_c")).alias("pct")))


def diagnosis(chi: DataFrame) -> DataFrame:
    """Related (p < 0.05), strength, V rounded to 4, p and its text."""
    p = F.col("p_value")
    v = F.col("cramers_v")
    return chi.select(
        F.coalesce(p < SIGNIFICANCE, F.lit(False)).alias("related"),
        F.when(v.isNotNull(), strength_label(v)).alias("strength"),
        F.round(v, 4).alias("cramers_v"), p.alias("p_value"),
        F.when(p < P_FLOOR, F.lit(P_FLOOR_TEXT)).otherwise(F.format_string("%.4f", p)).alias("p_text"))


@dataclass
class DependenceResult:
    table: DataFrame
    chi: DataFrame
    diagnosis: DataFrame
    residuals: DataFrame
    hotspots: DataFrame
    profile: DataFrame


def calculate_dependence(inc: DataFrame) -> DependenceResult:
    t = contingency(inc)
    chi = chi_square(t)
    res = residuals(t)
    return DependenceResult(t, chi, diagnosis(chi), res, hotspots(res), column_profile(t))
