"""Sums of keyed arrays over all rows, added up in tasks, and blocks of distances.

A task sends one row of packed doubles for each key that it met; rows of one key
meet in one task, which adds them as they stream by. So what a task holds is one
array, whatever the number of rows and tasks.

Packed tiles of points meet two by two in ``met``: a task reads one part of each
side from where it is kept, so no tile is copied for every tile that it meets, and
what is written grows with the points, not with their pairs. The distances of two
tiles come from one matrix product; where its rounding could matter they are
computed anew from coordinate differences.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

PACKED = "key int, part binary"
ROWS, COLUMNS = 256, 1024  # distances at a time: they stay in a core's cache
PAIR_ELEMENTS = 1 << 20  # coordinates of pairs that are compared anew, at a time
NEAR = 1e10  # a square of so many times its rounding is taken as it is


def packed(parts: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for key, part in parts.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([key], pa.int32()), pa.array([np.ascontiguousarray(part, "<f8").tobytes()])],
            names=["key", "part"])


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long arrays as rows of doubles."""
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def matrices(batches, name: str = "x", rows: int = 1024) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield matrix(batch.column(name).slice(at, rows))


def _folded(fold: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    def run(batches):
        key, total = None, None
        for batch in batches:
            for k, raw in zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()):
                part = np.frombuffer(raw, "<f8")
                if k != key and key is not None:
                    yield from packed({key: total})
                total = part.copy() if k != key else fold(total, part)
                key = k
        if key is not None:
            yield from packed({key: total})

    return run


def added(parts: DataFrame,
          fold: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> dict[int, np.ndarray]:
    """The sum (or another associative ``fold``) of packed rows (key, part) by key."""
    total = parts.repartition("key").sortWithinPartitions("key").mapInArrow(_folded(fold), PACKED)
    return {r.key: np.frombuffer(bytes(r.part), "<f8") for r in total.collect()}


def summed(rows: DataFrame, run: Callable,
           fold: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> dict[int, np.ndarray]:
    """``run`` turns Arrow batches into ``packed`` rows; their sum, one array a key."""
    return added(rows.mapInArrow(run, PACKED), fold)


def parts(df: DataFrame, tiles: int, factor: int, most: int = 32) -> int:
    """Into how many parts a side of ``met`` is cut: its square gives every core
    some tasks, and a part holds ``most`` tiles."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, min(tiles, max(math.ceil(factor * math.sqrt(cores)), math.ceil(tiles / most))))


def met(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """The pairs of packed tiles that ``on`` allows, a task for each pair of
    partitions; the left tiles come one after the other."""
    return left.join(right.hint("shuffle_replicate_nl"), on)


def _products(xl: np.ndarray, xr: np.ndarray):
    """(rows, columns, squared distances, their rounding at most) of blocks."""
    whole = xl[np.isfinite(xl).all(axis=1)], xr[np.isfinite(xr).all(axis=1)]
    if len(whole[0]) and len(whole[1]):
        centre = (whole[0].mean(axis=0) + whole[1].mean(axis=0)) / 2
    else:
        centre = np.zeros(xl.shape[1])
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = xl - centre, xr - centre
        na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
        scale = sum(float(n[np.isfinite(n)].max(initial=0.0)) for n in (na, nb))
        slip = 4 * (xl.shape[1] + 8) * np.finfo(float).eps * scale
        a = np.concatenate([-2 * a, na[:, None], np.ones((len(a), 1))], axis=1)
        b = np.concatenate([b, np.ones((len(b), 1)), nb[:, None]], axis=1)
        for to in range(0, len(b), COLUMNS):
            right = np.ascontiguousarray(b[to:to + COLUMNS].T)
            for at in range(0, len(a), ROWS):
                yield slice(at, at + ROWS), slice(to, to + COLUMNS), a[at:at + ROWS] @ right, slip


def _anew(xl: np.ndarray, xr: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of pairs from coordinate differences."""
    out = np.empty(len(at))
    step = max(1, PAIR_ELEMENTS // max(1, xl.shape[1]))
    for k in range(0, len(at), step):
        diff = xl[at[k:k + step]] - xr[to[k:k + step]]
        out[k:k + step] = np.einsum("ij,ij->i", diff, diff)
    return out


def distances(xl: np.ndarray, xr: np.ndarray):
    """(rows, columns, distances) of blocks of all rows of ``xl`` and ``xr``."""
    for rows, cols, d, slip in _products(xl, xr):
        sure = d > NEAR * slip  # not so for NaN
        if np.count_nonzero(sure) < sure.size:
            at, to = np.nonzero(~sure)
            d[at, to] = _anew(xl[rows], xr[cols], at, to)
        yield rows, cols, np.sqrt(d, out=d)


def within(xl: np.ndarray, xr: np.ndarray, eps: float):
    """(rows, columns, whether at most ``eps`` apart) of blocks, exactly as squares of
    coordinate differences tell."""
    limit = eps * eps
    for rows, cols, d, slip in _products(xl, xr):
        near, far = d <= limit - slip, d > limit + slip
        if np.count_nonzero(near) + np.count_nonzero(far) < near.size:
            at, to = np.nonzero(~(near | far))
            near[at, to] = _anew(xl[rows], xr[cols], at, to) <= limit
        yield rows, cols, near
