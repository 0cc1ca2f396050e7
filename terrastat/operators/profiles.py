"""Cluster profiling shared by K-Means (M5-M12) and DBSCAN.

Per-cluster means are one group-by on (label, feature) over the long form with
partial aggregation (K × d rows out); z-scores and names follow from those rows,
profiles fold them back to a K-row table. An outlier's arg-max over features is a
``greatest`` of (z, -position, name) structs: a row-wise expression, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastat.functions.text import feature_label, round_half_even_str
from terrastat.operators.features import Z_EPS, feature_long, zscore_stats

# Cluster-name texts, noise label, DBSCAN type texts.
PACIFIC_NAME = "Perfil Pacifico"
FOCUS_PREFIX = "Foco: "
NOISE = -1
NATURAL_GROUP = "Agrupación Natural"
OUTLIER_TEXT = "Outlier Atípico"
TOP_FEATURES = 3
HEAT_FEATURES = 10
OUTLIER_LIST = 15


def _argmax(values: list[Column], names: list[str]) -> Column:
    """struct(z, pos, feature) of the largest value, first position on ties."""
    cells = [F.struct(v.alias("z"), F.lit(-i).alias("neg_pos"), F.lit(n).alias("feature"))
             for i, (v, n) in enumerate(zip(values, names))]
    return F.greatest(*cells) if len(cells) > 1 else cells[0]


def _long(wide: DataFrame, keys: list[str], features: list[str], value: str) -> DataFrame:
    """Unpivot a small wide table (K rows) to (keys, position, feature, value)."""
    arr = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"),
                             F.col(f).alias(value)) for i, f in enumerate(features)])
    return wide.select(*keys, F.explode(arr).alias("_e")).select(*keys, "_e.*")


def cluster_means(rates: DataFrame, label: str, features: list[str]) -> DataFrame:
    """K rows: members, mean population and the mean of every feature. The
    means come from one group-by on (label, feature) over the long form (one
    aggregate over the big input instead of d), and only the K×d result is
    folded back to one column per feature."""
    sizes = rates.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("members"),
                                     F.avg("population").alias("mean_population"))
    means = feature_long(rates, [label], features).groupBy(label, "position").agg(F.avg("v").alias("m"))
    pos = F.col("position")
    wide = means.groupBy(label).agg(*[F.max(F.when(pos == i, F.col("m"))).alias(f)
                                      for i, f in enumerate(features)])
    return sizes.join(wide, label)


def cluster_summary(rates: DataFrame, label: str = "cluster") -> DataFrame:
    """M5 / D5 core: members and mean population per cluster."""
    return rates.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("members"),
                                    F.avg("population").alias("mean_population"))


def _cluster_cells(rates: DataFrame, label: str, features: list[str]) -> DataFrame:
    """(label, position, members, mean, z): K×d rows, and per cluster the population
    as one more position. One scan and one group-by give the clusters' moments; the
    global mean and sample std follow from them over the small result."""
    per = feature_long(rates, [label], [*features, "population"]).groupBy(label, "position").agg(
        F.count(F.lit(1)).alias("members"), F.count("v").alias("_n"), F.avg("v").alias("mean"),
        F.var_pop("v").alias("_v"))
    every = Window.partitionBy("position")  # K rows
    n = F.sum("_n").over(every)
    placed = per.withColumn("_m", F.sum(F.col("_n") * F.col("mean")).over(every) / n)
    off = F.col("mean") - F.col("_m")
    spread = F.sum(F.col("_n") * (F.col("_v") + off * off)).over(every)
    std = F.when(n > 1, F.sqrt(spread / (n - 1)))
    return placed.select(label, "position", "members", "mean",
                         ((F.col("mean") - F.col("_m")) / (std + Z_EPS)).alias("z"))


def _feature_name(features: list[str]) -> Column:
    return F.array(*[F.lit(f) for f in features])[F.col("position")]


def cluster_zscores(rates: DataFrame, features: list[str], label: str = "cluster") -> DataFrame:
    """M6: (cluster mean - global mean) / (global sample std + 1e-9), long."""
    cells = _cluster_cells(rates, label, features).where(F.col("position") < len(features))
    return cells.select(label, "position", _feature_name(features).alias("feature"), "z")


def cluster_names(rates: DataFrame, features: list[str], label: str = "cluster") -> DataFrame:
    """M7 + M8: specialty (arg-max z, first column on ties) and the name
    'Perfil Pacifico (...)' when the top z < 0, else 'Foco: <feature> (...)',
    with N and the mean population in thousands (half-even, no decimals)."""
    own = F.col("position") < len(features)
    top = F.max(F.when(own, F.struct("z", (-F.col("position")).alias("neg_pos"))))
    t = (_cluster_cells(rates, label, features).groupBy(label)
         .agg(F.max("members").cast("bigint").alias("members"),
              F.max(F.when(~own, F.col("mean"))).alias("mean_population"), top.alias("_top"))
         .withColumn("position", -F.col("_top.neg_pos"))
         .withColumn("specialty", _feature_name(features)))
    tail = F.concat(F.lit(" (N="), F.col("members").cast("string"), F.lit(" | Pob: "),
                    round_half_even_str(F.col("mean_population") / 1000.0), F.lit("k)"))
    name = F.when(F.col("_top.z") < 0, F.concat(F.lit(PACIFIC_NAME), tail)).otherwise(
        F.concat(F.lit(FOCUS_PREFIX), feature_label(F.col("specialty")), tail))
    return t.select(label, "members", "mean_population", "specialty",
                    F.col("_top.z").alias("top_z"), name.alias("cluster_name"))


def members_named(rates: DataFrame, names: DataFrame, label: str = "cluster") -> DataFrame:
    """M9: every member with its cluster name (one row per cluster on the
    build side: bounded by the number of clusters)."""
    return rates.join(F.broadcast(names.select(label, "cluster_name")), label, "inner")


def cluster_profiles(rates: DataFrame, names: DataFrame, features: list[str],
                     label: str = "cluster") -> DataFrame:
    """Mean rate per cluster and feature, keyed by cluster id (two
    clusters with the same name stay apart), long form."""
    means = cluster_means(rates, label, features).drop("members", "mean_population")
    named = means.join(F.broadcast(names.select(label, "cluster_name")), label)
    return _long(named, [label, "cluster_name"], features, "mean_rate")


def cluster_top_features(profiles: DataFrame, n: int = TOP_FEATURES, label: str = "cluster") -> DataFrame:
    """Top-n features per profile, as display text (profiles are
    K × d rows: the window is over a small table)."""
    w = Window.partitionBy(label).orderBy(F.col("mean_rate").desc(), F.col("position"))
    top = profiles.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return top.groupBy(label, "cluster_name").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "feature"))),
                                 lambda s: feature_label(s["feature"])), ", ").alias("top_features"))


def cluster_heat(profiles: DataFrame, n: int = HEAT_FEATURES, label: str = "cluster") -> DataFrame:
    """The n features with the largest sum of profile means, as
    (feature, profile, mean) cells."""
    sums = profiles.groupBy("feature", "position").agg(F.sum("mean_rate").alias("_s"))
    top = sums.orderBy(F.col("_s").desc(), F.col("position")).limit(n).select("feature")
    return profiles.join(F.broadcast(top), "feature", "left_semi").select(
        "feature", label, "cluster_name", "mean_rate")


def outlier_anomaly(rates: DataFrame, labelled: DataFrame, features: list[str],
                    label: str = "cluster", key: str = "muni_key") -> DataFrame:
    """Per outlier, z = (rate - global mean)/(global sample std + 1e-9)
    with the globals over *all* rows; main anomaly = arg-max feature as
    display text."""
    out = labelled.where(F.col(label) == NOISE).withColumn("_g", zscore_stats(rates, features))
    zs = [(F.col(f) - F.col(f"_g.m{i}")) / (F.col(f"_g.s{i}") + Z_EPS) for i, f in enumerate(features)]
    top = _argmax(zs, features)
    ids = [c for c in ("muni_key", "muni", "population", "state") if c in out.columns]
    return out.select(*ids, feature_label(top["feature"]).alias("main_anomaly"),
                      top["z"].alias("max_z"))


def outlier_list(anomaly: DataFrame, n: int | None = OUTLIER_LIST) -> DataFrame:
    """Outliers by population descending (key breaks ties); top n."""
    o = anomaly.orderBy(F.col("population").desc(), F.col("muni_key"))
    return o.limit(n) if n else o


def dbscan_summary(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """Members and mean population per non-noise cluster with the type
    text; empty with the same columns when everything is noise."""
    s = cluster_summary(labelled.where(F.col(label) != NOISE), label)
    return s.withColumn("type", F.lit(NATURAL_GROUP))


def display_label(label: str = "cluster") -> Column:
    """Label as text, -1 -> 'Outlier Atípico'."""
    return F.when(F.col(label) == NOISE, F.lit(OUTLIER_TEXT)).otherwise(F.col(label).cast("string"))
