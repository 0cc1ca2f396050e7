"""Feature preparation F1-F5 shared by K-Means and DBSCAN.

The mart is wide (one column per crime subtype). Rates and scaling are one
``select`` each with d expressions; global means/stds are one aggregate used
as a scalar subquery. PCA is randomised subspace iteration with a tall-skinny QR
by partial blocks: scans that send d×m sums, for a basis of m axes, and a
projection of Arrow batches; no d×d matrix anywhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastat.functions.records import rate_per_100k
from terrastat.operators.blocks import matrices, matrix, packed, summed
from terrastat.operators.common import checkpointed, scalars

# Id columns, excluded aggregate columns, population cut, PCA target.
ID_COLUMNS = ["muni_key", "muni", "population"]
OPTIONAL_ID = "state"
EXCLUDED_AGGREGATES = ["Tasa_Global_100k", "Total_Delitos_Absoluto", "Robos_Totales", "Total"]
MIN_POPULATION = 5000  # inclusive
PCA_VARIANCE = 0.90
Z_EPS = 1e-9
# Subspace iteration: whole space up to so many dimensions; else the first basis,
# its surplus axes, passes at most, and the relative change that ends them.
FULL_DIMS, FIRST_BASIS, OVERSAMPLE = 256, 32, 8
MAX_PASSES, SETTLED = 200, 1e-13
BLOCK_DIMS = 256

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType)


def filter_population(mart: DataFrame, min_population: int = MIN_POPULATION) -> DataFrame:
    """keep population >= 5000; a mart without the column is an error."""
    if "population" not in mart.columns:
        raise KeyError("the mart has no 'population' column")
    return mart.where(F.col("population") >= min_population)


def feature_roles(mart: DataFrame, exclude=EXCLUDED_AGGREGATES) -> tuple[list[str], list[str]]:
    """(id columns, feature columns). Features are every other column that
    is not an excluded aggregate; a non-numeric feature is an error (the
    reference would fail later, inside the rates)."""
    ids = [c for c in ID_COLUMNS if c in mart.columns]
    if OPTIONAL_ID in mart.columns:
        ids.append(OPTIONAL_ID)
    feats = [f for f in mart.schema.fields if f.name not in ids and f.name not in exclude]
    bad = [f.name for f in feats if not isinstance(f.dataType, _NUMERIC)]
    if bad:
        raise TypeError(f"non-numeric feature columns in the mart: {bad}")
    return ids, [f.name for f in feats]


def feature_rates(mart: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """every feature as a rate per 100k inhabitants (one select)."""
    return mart.select(*ids, *[rate_per_100k(F.col(f), F.col("population")).alias(f)
                               for f in features])


def standardise(rates: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """(x - mean) / population std per feature; zero variance -> 0."""
    stats = scalars(rates, **{f"m{i}": F.avg(f) for i, f in enumerate(features)},
                    **{f"s{i}": F.stddev_pop(f) for i, f in enumerate(features)})
    src = rates.withColumn("_g", stats)
    cols = []
    for i, f in enumerate(features):
        m, s = F.col(f"_g.m{i}"), F.col(f"_g.s{i}")
        cols.append(F.when(s > 0, (F.col(f) - m) / s).otherwise(F.lit(0.0)).alias(f))
    return src.select(*ids, *cols)


def feature_long(rates: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, position, v): one row per row and feature (an explode; the
    group-bys that follow combine map-side)."""
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.col(f).cast("double").alias("v"))
                      for i, f in enumerate(features)])
    return rates.select(*keys, F.explode(cells).alias("_e")).select(*keys, "_e.position", "_e.v")


def zscore_stats(rates: DataFrame, features: list[str]):
    """Global mean and *sample* std per feature, as a scalar struct to attach
    once as a column (the naming z-scores of M6/D6 use ddof 1, unlike the
    scaler). One group-by on (feature) over the long form, then d small rows
    are folded back."""
    per = feature_long(rates, [], features).groupBy("position").agg(
        F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    pos = F.col("position")
    return scalars(per, **{f"m{i}": F.max(F.when(pos == i, F.col("m"))) for i in range(len(features))},
                   **{f"s{i}": F.max(F.when(pos == i, F.col("s"))) for i in range(len(features))})


@dataclass
class PcaResult:
    scores: DataFrame           # ids + pc1..pck
    n_components: int
    retained_pct: float
    ratios: list[float]         # explained variance ratios, leading first (all up to FULL_DIMS)
    loadings: np.ndarray        # d x k, sign fixed


def _moments(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of rows and mean."""

    def run(batches):
        total = np.zeros(d + 1)
        for x in matrices(batches):
            total[:d] += x.sum(axis=0)
            total[d] += len(x)
        yield from packed({0: total})

    total = summed(rows, run)[0]
    return int(total[d]), total[:d] / max(1.0, total[d])


def _applied(rows: DataFrame, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Scatter matrix times ``q``, in blocks of features, and its trace. The
    scatter matrix itself is never formed."""
    d, m = q.shape
    shared = rows.sparkSession.sparkContext.broadcast((mean, q))

    def run(batches):
        mean, q = shared.value
        z, trace = np.zeros((d, m)), 0.0
        for x in matrices(batches):
            x = x - mean
            z += x.T @ (x @ q)
            trace += float((x * x).sum())
        yield from packed({-1: np.array([trace]),
                           **{k: z[k * BLOCK_DIMS:(k + 1) * BLOCK_DIMS].ravel()
                              for k in range(-(-d // BLOCK_DIMS))}})

    parts = summed(rows, run)
    trace = float(parts.pop(-1)[0])
    return np.concatenate([parts[k] for k in sorted(parts)]).reshape(d, m), trace


def _triangle(rows: DataFrame, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """R of the QR decomposition of the rows projected on ``q``: every task
    decomposes its slices one on top of the other's R, and the tasks' R are
    decomposed together, so the tall matrix is never formed."""
    m = q.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((mean, q))

    def run(batches):
        mean, q = shared.value
        r = np.zeros((m, m))
        for x in matrices(batches):
            r = np.linalg.qr(np.vstack([r, (x - mean) @ q]), mode="r")
        yield from packed({0: r.ravel()})

    def stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([a.reshape(m, m), b.reshape(m, m)]), mode="r").ravel()

    return summed(rows, run, stacked)[0].reshape(m, m)


def principal_axes(rows: DataFrame, d: int, variance: float, least: int = 1,
                   seed: int = 42) -> tuple[np.ndarray, np.ndarray, int]:
    """(axes as columns, their variance ratios, how many are kept) of the rows'
    array column ``x``, by randomised subspace iteration: a random basis is
    multiplied by the scatter matrix and made orthogonal until its Ritz values
    settle; it grows until its variance exceeds ``variance``. Up to ``FULL_DIMS``
    dimensions the basis is the whole space and nothing is iterated. Every pass
    is one scan; the driver holds d x m numbers, never d x d."""
    n, mean = _moments(rows, d)
    rng = np.random.default_rng(seed)
    m = d if d <= FULL_DIMS else min(d, max(FIRST_BASIS, least + OVERSAMPLE))
    q = np.linalg.qr(rng.normal(size=(d, m)))[0]
    while True:
        z, trace = _applied(rows, mean, q)
        ritz = np.linalg.eigvalsh(q.T @ z)[::-1]
        for _ in range(MAX_PASSES if m < d else 0):
            q = np.linalg.qr(z)[0]
            z, trace = _applied(rows, mean, q)
            new = np.linalg.eigvalsh(q.T @ z)[::-1]
            settled = np.abs(new - ritz)[:max(1, m - OVERSAMPLE)].max() <= SETTLED * new[0]
            ritz = new
            if settled:
                break
        share = np.cumsum(ritz) / trace if trace > 0 else np.ones(m)
        kept = int(np.searchsorted(share, variance, side="right") + 1)
        if m == d or max(kept, least) <= m - OVERSAMPLE:
            break
        m = min(d, 2 * m)
        q = np.linalg.qr(np.hstack([q, rng.normal(size=(d, m - q.shape[1]))]))[0]
    _, s, vt = np.linalg.svd(_triangle(rows, mean, q))
    total = float((s * s).sum()) if m == d else trace
    ratios = s * s / total if total > 0 else np.zeros(m)
    kept = int(np.searchsorted(np.cumsum(ratios), variance, side="right") + 1)
    return q @ vt.T, ratios, max(min(kept, m), min(least, m))


def pca_scores(scaled: DataFrame, ids: list[str], features: list[str],
               variance: float = PCA_VARIANCE, min_components: int = 1) -> PcaResult:
    """fewest components whose cumulative explained variance exceeds
    ``variance``; the sign of each component is fixed so that its
    largest-magnitude loading is positive."""
    d = len(features)
    rows = checkpointed(scaled.select(*ids, F.array(*[F.col(f).cast("double") for f in features])
                                      .alias("_x")))
    axes, ratios, k = principal_axes(rows.select(F.col("_x").alias("x")), d, variance, min_components)
    pc = axes[:, :k].copy()
    for j in range(k):
        if pc[np.argmax(np.abs(pc[:, j])), j] < 0:
            pc[:, j] = -pc[:, j]
    shared = scaled.sparkSession.sparkContext.broadcast(pc)
    schema = T.StructType([*rows.drop("_x").schema.fields,
                           T.StructField("_p", T.ArrayType(T.DoubleType()))])

    def project(batches):
        for batch in batches:
            p = matrix(batch.column("_x")) @ shared.value
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ids), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))],
                names=[*ids, "_p"])

    scores = rows.mapInArrow(project, schema).select(
        *ids, *[F.col("_p")[j].alias(f"pc{j + 1}") for j in range(k)])
    return PcaResult(scores, k, float(ratios[:k].sum() * 100.0), [float(x) for x in ratios], pc)


def pc_columns(k: int) -> list[str]:
    return [f"pc{j + 1}" for j in range(k)]
