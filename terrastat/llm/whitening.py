"""Embedding whitening by principal components.

Entries become integers ``floor(64 * c) + 1000000``, so sums over rows are exact
and do not depend on their order. One pass gives the sums per dimension; a second
sums products of entries less their dimension's nearest whole mean (the half unit
left over is taken off exactly afterwards), which is the centred covariance. Each
task sends one partial sum a matrix entry, added up by a grouped aggregate; only
the d x d result meets the driver. There the leading eigenpairs are found
(``eigen``) and broadcast as a projection of d x ``components`` numbers. A third
pass sums products of whitened rows, to measure how far their covariance is from
the identity, and the last pass returns the rows.

Every pass is a scan of the staged integers without a shuffle of rows, so neither
copies nor a hot label matter.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry
are dropped; null and repeated ids and equal rows stay rows of their own; vectors
of each length make a fit list, with components of their own; components whose
variance is not over ``LEAST`` of the largest one can't be told from zero and are
left out, so vectors that are empty, alone or all alike give no rows; entries
beyond 2**34 in size, or a deviation beyond 63 bits, raise an OverflowError; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.llm.common import staged
from terrastat.llm.eigen import leading

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
LEAST = 1e-11
LARGEST = 1 << 41
BATCH = 2048
FRACTION = 1 << 60  # whitened products are summed as whole multiples of its inverse

SUMS = "d int, i int, j int, s decimal(38,0)"
RESULT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
          "explained double, identity_error double")


def integers(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and whole entries x of the rows that take part."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c)
                      & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return rows.where(v.isNotNull() & finite).select(
        F.col(id_col).cast("bigint").alias("vec_id"),
        # the bounds keep a too large entry within a long; ``_matrices`` raises on it
        F.transform(v, lambda c: F.floor(F.greatest(F.least(
            c.cast("double") * SCALE, F.lit(2.0 * LARGEST)), F.lit(-2.0 * LARGEST)))
            .cast("bigint") + SHIFT).alias("x"))


def _matrices(batches):
    """(length, ids, matrix) of at most ``BATCH`` rows of one length."""
    for batch in batches:
        sizes = np.asarray(pc.list_value_length(batch.column("x")))
        for d in np.unique(sizes):
            same = batch.filter(pa.array(sizes == d)) if (sizes != d).any() else batch
            step = max(1, min(BATCH, (1 << 21) // max(1, int(d))))
            for at in range(0, same.num_rows, step):
                part = same.slice(at, step)
                x = np.asarray(part.column("x").flatten(), np.int64).reshape(part.num_rows, d)
                if np.abs(x).max(initial=0) >= LARGEST:
                    raise OverflowError("an entry exceeds 2**34")
                yield int(d), part.column("vec_id"), x


def _products(c: np.ndarray) -> np.ndarray:
    """Exact sums of products of whole columns, as Python integers."""
    most = float(np.abs(c).max(initial=0)) ** 2 * len(c)
    if most < 2 ** 53:
        f = c.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    if most < 2 ** 63:
        return (c.T @ c).astype(object)
    return c.astype(object).T @ c.astype(object)


def _sums(totals: dict[int, np.ndarray]):
    """Partial sums of a task as rows: the upper triangle of a matrix, or the
    entries of a vector (with j = -1)."""
    for d, total in totals.items():
        flat = total.ndim == 1
        i, j = (np.arange(len(total)), np.full(len(total), -1)) if flat else np.triu_indices(
            len(total))
        s = [int(x) for x in (total if flat else total[i, j])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(s), d), pa.int32()), pa.array(i, pa.int32()),
             pa.array(j, pa.int32()), pa.array(s, pa.decimal128(38, 0))],
            names=["d", "i", "j", "s"])


def _added(parts: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """All partial sums added up: d * d numbers a length at most."""
    out: dict = {}
    for r in parts.groupBy("d", "i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect():
        out.setdefault(r.d, {})[r.i, r.j] = int(r.s)
    return out


def _full(sums: dict[tuple[int, int], int], d: int) -> np.ndarray:
    out = np.empty((d, d), object)
    for (i, j), s in sums.items():
        out[i, j] = out[j, i] = s
    return out


@dataclass
class Fit:
    """Components of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray  # unit eigenvectors as columns
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S, exact, and the rows' whitened components."""
        sums = np.array(self.sums, np.int64)
        y = self.n * x - sums
        return y, (y / float(self.n)) @ (self.axes / np.sqrt(self.values))


def column_sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Rows and sums per dimension, for each length."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for d, _, x in _matrices(batches):  # the last entry counts rows
            part = np.append(x.sum(axis=0), len(x)).astype(object)
            totals[d] = totals.get(d, 0) + part
        yield from _sums(totals)

    return {d: (s[d, -1], [s[i, -1] for i in range(d)])
            for d, s in _added(vectors.mapInArrow(run, SUMS)).items()}


def covariances(vectors: DataFrame, sums: dict[int, tuple[int, list[int]]]
                ) -> dict[int, np.ndarray]:
    """Covariance (divisor n) of the vectors of each length."""
    middle = {d: np.array([(2 * s + n) // (2 * n) for s in total], np.int64)
              for d, (n, total) in sums.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(middle)

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for d, _, x in _matrices(batches):
            totals[d] = totals.get(d, 0) + _products(x - shared.value[d])
        yield from _sums({d: t for d, t in totals.items() if d})

    out = {}
    for d, s in _added(vectors.mapInArrow(run, SUMS)).items():
        n, total = sums[d]
        rest = np.array([t - n * int(m) for t, m in zip(total, middle[d])], object)
        exact = n * _full(s, d) - np.outer(rest, rest)
        out[d] = np.array([[float(v / (n * n)) for v in row] for row in exact])
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The leading components for each length, from all rows."""
    sums = column_sums(vectors)
    fits = {}
    for d, v in covariances(vectors, sums).items():
        values, axes = leading(v, components)
        keep = values > LEAST * max(float(values[0]), 0.0)
        if keep.any():
            fits[d] = Fit(*sums[d], values[keep], axes[:, keep], float(np.trace(v)))
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for d, _, x in _matrices(batches):
            if d in shared.value:
                w = shared.value[d].whitened(x)[1]  # its mean is zero: x was centred
                part = np.vectorize(lambda v: round(v * FRACTION), otypes=[object])(w.T @ w)
                totals[d] = totals.get(d, 0) + part
        yield from _sums(totals)

    if fits:
        for d, s in _added(vectors.mapInArrow(run, SUMS)).items():
            k, scale = len(fits[d].values), fits[d].n * FRACTION
            got = np.array([[float(v / scale) for v in row] for row in _full(s, k)])
            fits[d].identity_error = float(np.abs(got - np.eye(k)).max())
    return fits


def project(vectors: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """Every row's whitened components, one row each."""
    shared = vectors.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        for d, ids, x in _matrices(batches):
            f = shared.value.get(d)
            if f is None:
                continue
            if float(f.n) * float(np.abs(x).max()) >= 2 ** 62:
                raise OverflowError("a deviation exceeds 63 bits")
            y, w = f.whitened(x)
            if float((y.astype(float) ** 2).sum(axis=1).max()) >= 2 ** 62:
                raise OverflowError("a deviation exceeds 63 bits")
            k, rows = len(f.values), len(x)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(rows), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, f.n, np.int64)),
                 pa.array(np.repeat((y * y).sum(axis=1), k)),
                 pa.array(w.reshape(-1)),
                 pa.array(np.tile(f.values / f.trace, rows)),
                 pa.array(np.full(rows * k, f.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])

    return vectors.mapInArrow(run, RESULT)


def whiten(rows: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    vectors = staged(integers(rows, id_col=id_col, vec_col=vec_col), "whitening-vectors")
    return project(vectors, fit(vectors, components))
