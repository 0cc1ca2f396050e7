"""K-Means profiling pipeline (M1-M4, M13) on top of F1-F5 and profiles.py.

F1-F5 run once and the PCA scores are checkpointed; all K of the sweep are
fitted together, each Lloyd step being one scan of them (lloyd.py), and the final
fit for the requested K is the sweep's (the reference recomputed everything twice
per page render). Seeding is a fixed sequence, so fits are the same on every run
and SQL can repeat them; labels differ from k-means++ in another library.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.operators import features as FE
from terrastat.operators import lloyd as LL
from terrastat.operators import profiles as PR
from terrastat.operators.common import checkpointed
from terrastat.operators.silhouette import best_k, silhouette_means, silhouette_score

# The sweep range, default K, seed and iteration cap.
SWEEP = range(2, 9)
DEFAULT_K = 4
SEED = 42
MAX_ITER = 300  # Lloyd steps end earlier, once no label changes


@dataclass
class Prepared:
    ids: list[str]
    features: list[str]
    rates: DataFrame          # F1 + F3, ids + rates
    scores: DataFrame         # ids + pc1..pck (checkpointed)
    pca: FE.PcaResult


def prepare(mart: DataFrame, variance: float = FE.PCA_VARIANCE) -> Prepared:
    """F1-F5 once."""
    filtered = FE.filter_population(mart)
    ids, feats = FE.feature_roles(filtered)
    rates = checkpointed(FE.feature_rates(filtered, ids, feats))
    scaled = checkpointed(FE.standardise(rates, ids, feats))
    pca = FE.pca_scores(scaled, ids, feats, variance)
    scores = checkpointed(pca.scores)
    pca.scores = scores
    return Prepared(ids, feats, rates, scores, pca)


def _points(prep: Prepared) -> DataFrame:
    return prep.scores.select(F.col("muni_key").alias("id"), F.array(*[
        F.col(c) for c in FE.pc_columns(prep.pca.n_components)]).alias("x"))


def _fits(prep: Prepared, ks, seed: int) -> tuple[dict[int, LL.Fit], DataFrame]:
    """K -> fit, and (muni_key, x, cluster_K...) of every point."""
    ks = sorted({int(k) for k in ks})
    fits, labelled = LL.sweep(_points(prep), ks, seed, MAX_ITER)
    return fits, labelled.select(F.col("id").alias("muni_key"), "x", *[
        F.col("l")[i].cast("long").alias(f"cluster_{k}") for i, k in enumerate(ks)])


def _of(prep: Prepared, labelled: DataFrame, k: int) -> DataFrame:
    """ids + pcs + cluster of one K."""
    return prep.scores.join(labelled.select("muni_key", F.col(f"cluster_{k}").alias("cluster")),
                            "muni_key").select(*prep.scores.columns, "cluster")


def fit_labels(prep: Prepared, k: int = DEFAULT_K, seed: int = SEED):
    """M4: final fit; (fit, ids + pcs + cluster)."""
    fits, labelled = _fits(prep, [k], seed)
    return fits[k], _of(prep, labelled, k)


def _silhouettes(labelled: DataFrame, ks, method: str) -> dict[int, float]:
    """k -> mean silhouette; the exact one of all K from one pass."""
    ks = sorted(ks)
    if method == "exact":
        got = silhouette_means(labelled, "muni_key", "x", [f"cluster_{k}" for k in ks]).collect()
        return {ks[r.position]: float(r.silhouette or 0.0) for r in got}
    return {k: float(silhouette_score(labelled, "muni_key", "x", f"cluster_{k}", method=method)
                     .first()["silhouette"] or 0.0) for k in ks}


def _evaluation_frame(prep: Prepared, fits: dict, silhouettes: dict) -> DataFrame:
    rows = [(k, v.inertia, silhouettes.get(k)) for k, v in sorted(fits.items())]
    return prep.scores.sparkSession.createDataFrame(rows, "k long, inertia double, silhouette double")


def evaluate_k(prep: Prepared, ks=SWEEP, seed: int = SEED, method: str = "exact") -> DataFrame:
    """M1: (k, inertia, silhouette) for each K in the sweep (7 small rows)."""
    fits, labelled = _fits(prep, ks, seed)
    return _evaluation_frame(prep, fits, _silhouettes(labelled, fits, method))


@dataclass
class KMeansResult:
    members: DataFrame        # ids + rates + cluster + cluster_name + pc1/pc2
    names: DataFrame
    profiles: DataFrame
    evaluation: DataFrame | None  # None without the sweep
    metrics: DataFrame | None


def run_kmeans(mart: DataFrame, k: int = DEFAULT_K, seed: int = SEED, method: str = "exact",
               sweep: bool = True) -> KMeansResult:
    """The whole profiling pipeline: F1-F5, sweep, final fit, naming. Without
    ``sweep`` only the final K is fitted and no silhouette is computed."""
    prep = prepare(mart)
    fits, every = _fits(prep, {k, *SWEEP} if sweep else [k], seed)
    labelled = checkpointed(_of(prep, every, k))  # the same as a fit of its own
    k_pc = prep.pca.n_components
    pcs = [F.col("pc1"), F.col("pc2") if k_pc > 1 else F.lit(None).cast("double").alias("pc2")]
    lab = prep.rates.join(labelled.select("muni_key", "cluster", *pcs), "muni_key")
    names = checkpointed(PR.cluster_names(lab, prep.features))
    members = PR.members_named(lab, names)
    profiles = PR.cluster_profiles(lab, names, prep.features)
    if not sweep:
        return KMeansResult(members, names, profiles, None, None)
    silhouettes = _silhouettes(every, fits, method)
    evaluation = checkpointed(_evaluation_frame(prep, {n: fits[n] for n in SWEEP}, silhouettes))
    metrics = best_k(evaluation).select(
        F.lit(silhouettes[k]).alias("silhouette_final"), "best_k", "best_silhouette",
        F.lit(prep.pca.retained_pct).alias("retained_pct"),
        F.lit(prep.pca.n_components).alias("dims"))
    return KMeansResult(members, names, profiles, evaluation, metrics)
