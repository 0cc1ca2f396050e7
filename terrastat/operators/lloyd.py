"""K-Means for a whole sweep of K: hash-seeded k-means++, then exact Lloyd steps
with Hamerly's bounds.

* **Seeds.** The j-th draw is ``u_j = frac((seed + j) * golden ratio)``, the same
  for every K, so the K centres of a fit are the first K of one sequence. The first
  centre is the point of rank ``floor(u_0 n)`` by id; each next one is the first
  point, by id, at which the running sum of squared distances to the nearest
  centre passes ``u_j`` times the total. The running sum is global: sums of ranges
  of ids give the range that holds the point, sums of its tiles the tile, and only
  that tile is summed row by row.
* **Steps.** Every point keeps, for each K, its label, an upper bound of the
  distance to its centre and a lower bound of the distance to any other. Centres
  that move widen the bounds; a point whose upper bound stays under the lower one
  (and under half the way from its centre to the next) keeps its label without a
  distance. One pass moves all K together and sends the next sums of every cluster,
  so a step is one scan. Steps end when no label changes: labels are exact nearest
  centres (the smaller number of equals), and centres are the means of their points.
  A cluster that lost all its points keeps its centre.
* **Disk.** Points are stored once, in packed tiles by id, as floats where they came
  as floats. Bounds are stored with them by a step after others that took as many
  distances as a whole assignment, and the table that they replace is removed then. Any
  other step reads them and how far the centres went since, and writes nothing. So the disk holds
  two copies of the points at most, and the shuffle of their sort, whatever the number
  of steps. Labels of the step before, to count changes, follow from the new bounds and
  the last move of the centres.

What reaches the driver is sums: centres x dimensions, and at a seed those of ranges
and of one range's tiles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrastat.operators.blocks import added, matrix, packed, summed
from terrastat.operators.common import removed, stored

GOLDEN = 0.6180339887498949
MAX_ITER = 300
RANGES, RANGE_ROWS = 4096, 25_000  # ranges of ids at most, and the rows aimed at for one
TILE_ELEMENTS = 1 << 15  # coordinates in a tile
SLACK = 1e-12


@dataclass
class Fit:
    """One K: centres in the order of their seeds, and the sum of squared
    distances to them."""

    centres: np.ndarray
    inertia: float
    steps: int

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 (the name of Spark ML's models)
        return list(self.centres)


def _draw(seed: int, j: int) -> float:
    return (seed + j) * GOLDEN % 1.0


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances from coordinate differences."""
    out = np.empty((len(x), len(centres)))
    for k, c in enumerate(centres):
        diff = x - c
        out[:, k] = np.einsum("ij,ij->i", diff, diff)
    return out


# --- tiles of points ----------------------------------------------------------------
TILE = "tile bigint, n int, ids array<{t}>, x binary"
BOUNDS = "l binary, u binary, w binary"  # rows x fits each


@dataclass
class Tiles:
    """Stored points: ``tile`` numbers follow the order of (id, x), the upper half of
    one is its range of ids. ``x`` holds rows of ``kind`` numbers. ``kept``: the
    centres for which the bounds hold; None without bounds."""

    table: DataFrame
    path: str
    id_type: str
    kind: str
    kept: list[np.ndarray] | None = None

    def of(self, raw: pa.Scalar, n: int) -> np.ndarray:
        return np.frombuffer(raw.as_buffer(), self.kind).reshape(n, -1).astype(np.float64)

    def points(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for raw, n in zip(batch.column("x"), batch.column("n").to_pylist()):
            yield self.of(raw, n)

    def bounds(self, batch: pa.RecordBatch) -> Iterator[list[tuple] | Iterator[None]]:
        """Of every tile, for each fit labels, upper and lower bounds, or None."""
        for i, n in enumerate(batch.column("n").to_pylist()):
            yield repeat(None) if self.kept is None else list(zip(*(
                np.frombuffer(batch.column(c)[i].as_buffer(), t).reshape(n, -1).T
                for c, t in zip("luw", ("<i4", "<f4", "<f4")))))

    def read(self, *more: str) -> DataFrame:
        return self.table.select("n", "x", *([] if self.kept is None else "luw"), *more)

    def __getstate__(self):  # what tasks need
        return self.__dict__ | {"table": None}


def tiled(points: DataFrame) -> Tiles:
    """Points (id, x: array of numbers) in the order of (id, x), as stored tiles."""
    kind = "<f4" if points.schema["x"].dataType == T.ArrayType(T.FloatType()) else "<f8"
    id_type = dict(points.dtypes)["id"]
    x = F.col("x") if kind == "<f4" else F.col("x").cast("array<double>").alias("x")
    cores = points.sparkSession.sparkContext.defaultParallelism
    ranges = min(RANGES, max(2 * cores, math.ceil(points.count() / RANGE_ROWS)))
    ordered = (points.select("id", x).repartitionByRange(ranges, "id", "x")
               .sortWithinPartitions("id", "x").withColumn("range", F.spark_partition_id()))

    def seal(batches):
        done = 0
        for batch in batches:
            if batch.column("x").null_count:
                raise ValueError("a point without coordinates")
            at = 0
            while at < batch.num_rows:
                first = len(batch.column("x")[at])
                part = batch.slice(at, max(1, TILE_ELEMENTS // max(1, first)))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part.column("range")[0].as_py() << 32) + done], pa.int64()),
                     pa.array([n], pa.int32()),
                     pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), part.column("id")),
                     pa.array([matrix(part.column("x")).astype(kind).tobytes()], pa.binary())],
                    names=["tile", "n", "ids", "x"])
                at, done = at + n, done + 1

    table, path = stored(ordered.mapInArrow(seal, TILE.format(t=id_type)), "points")
    return Tiles(table, path, id_type, kind)


# --- seeds --------------------------------------------------------------------------
def _passes(weights: np.ndarray, wanted: float) -> tuple[int, float]:
    """The place at which the running sum passes ``wanted``, and what is left of it
    there; by rounding at the end, the last weight over 0."""
    upto = np.cumsum(weights)
    at = int(np.searchsorted(upto, wanted, side="right"))
    if at == len(upto):
        at = int(np.flatnonzero(weights)[-1])
    return at, wanted - (upto[at - 1] if at else 0.0)


def _drawn(tiles: Tiles, weigh: Callable[[np.ndarray], np.ndarray], u: float,
           whole: bool = False) -> np.ndarray | None:
    """The first point at which the running sum of ``weigh`` passes ``u`` times its
    total, in ``whole`` numbers if asked; None if the total is 0."""

    def sums(batches):
        for batch in batches:
            s = [float(weigh(x).sum()) for x in tiles.points(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("tile"), pa.array(s, pa.float64())],
                                             names=["tile", "s"])

    def weights(table: DataFrame) -> DataFrame:
        return table.select("n", "x", "tile").mapInArrow(sums, "tile bigint, s double")

    ranges = sorted((r.range, r.s) for r in weights(tiles.table).groupBy(
        F.shiftright("tile", 32).alias("range")).agg(F.sum("s").alias("s")).collect())
    total = math.fsum(s for _, s in ranges)
    if not math.isfinite(total):
        raise ValueError("a coordinate that is no finite number, or too large to square")
    if total <= 0:
        return None
    at, rest = _passes(np.array([s for _, s in ranges]), math.floor(u * total) if whole else u * total)
    low = ranges[at][0] << 32
    own = tiles.table.where(F.col("tile").between(low, low + (1 << 32) - 1))
    sums_of = sorted(tuple(r) for r in weights(own).collect())  # a range's tiles
    at, rest = _passes(np.array([s for _, s in sums_of]), rest)
    row = tiles.table.where(F.col("tile") == sums_of[at][0]).select("n", "x").first()
    x = np.frombuffer(bytes(row.x), tiles.kind).reshape(row.n, -1).astype(np.float64)
    return x[_passes(weigh(x), rest)[0]]


def _seeds(tiles: Tiles, k: int, seed: int) -> np.ndarray:
    def at(j: int) -> np.ndarray | None:
        return _drawn(tiles, lambda x: np.ones(len(x)), _draw(seed, j), whole=True)

    chosen = [at(0)]
    if chosen[0] is None:
        return np.zeros((0, 0))
    for j in range(1, k):
        centres = np.array(chosen)
        new = _drawn(tiles, lambda x: _squares(x, centres).min(axis=1), _draw(seed, j))
        chosen.append(at(j) if new is None else new)  # None: every point is a centre already
    return np.array(chosen)


def seeds(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first ``k`` centres for points (id, x); fewer points than ``k`` repeat."""
    return _seeds(tiled(points), k, seed)


# --- steps --------------------------------------------------------------------------
def _gaps(centres: np.ndarray) -> np.ndarray:
    """Half the distance from each centre to the nearest other."""
    if len(centres) < 2:
        return np.full(len(centres), np.inf)
    d = np.sqrt(_squares(centres, centres))
    np.fill_diagonal(d, np.inf)
    return d.min(axis=1) / 2


def _assigned(x: np.ndarray, centres: np.ndarray):
    """Label, distance to its centre, and to the next nearest."""
    d = _squares(x, centres)
    label = d.argmin(axis=1)
    rows = np.arange(len(x))
    upper = np.sqrt(d[rows, label])
    d[rows, label] = np.inf
    return label, upper, np.sqrt(d.min(axis=1))


def _since(fits: list[np.ndarray], kept: list[np.ndarray] | None) -> list[tuple]:
    """For each fit its centres and, with bounds for the centres ``kept``, how far each
    went since, how far any other did at most, and half the way to the next centre."""
    if kept is None:
        return [(c,) for c in fits]
    out = []
    for centres, old in zip(fits, kept):
        moved = np.sqrt(((centres - old) ** 2).sum(axis=1))
        others = np.array([max([0.0, *np.delete(moved, c)]) for c in range(len(moved))])
        out.append((centres, moved, others, _gaps(centres)))
    return out


def _labels(x: np.ndarray, bounds: tuple | None, centres: np.ndarray, *since):
    """Labels, bounds of the distance to the own centre and to the next, and the
    number of distances computed; ``bounds`` are such labels and bounds from before."""
    if bounds is None:
        return *_assigned(x, centres), len(x) * len(centres)
    moved, others, gaps = since
    label = bounds[0].copy()
    upper = bounds[1] + moved[label]
    lower = bounds[2] - others[label]
    bound = np.maximum(lower, gaps[label])
    unsure = np.flatnonzero(~(upper * (1 + SLACK) < bound * (1 - SLACK)))
    looked = len(unsure)
    if len(unsure):  # the distance itself may settle it
        diff = x[unsure] - centres[label[unsure]]
        upper[unsure] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        unsure = unsure[~(upper[unsure] * (1 + SLACK) < bound[unsure] * (1 - SLACK))]
    if len(unsure):
        label[unsure], upper[unsure], lower[unsure] = _assigned(x[unsure], centres)
        looked += len(unsure) * len(centres)
    return label, upper, lower, looked


def _tally(now: list[tuple], before: list[tuple] | None):
    """``take`` labels a tile, (label, upper, lower) for each fit, and adds it up;
    ``whole`` gives the sums of all clusters, label changes and distances computed."""
    d = now[0][0].shape[1]
    sums = [np.zeros((len(c[0]), d + 1)) for c in now]
    changes, looked = np.zeros(len(now)), np.zeros(1)

    def take(x, bounds):
        found = []
        for k, (since, own) in enumerate(zip(now, bounds)):
            *new, n = _labels(x, own, *since)
            looked[0] += n
            if before is None:
                changes[k] += len(x)
            else:  # the new bounds tell nearly all labels of a step ago
                old, _, _, n = _labels(x, new, *before[k])
                looked[0] += n
                changes[k] += np.count_nonzero(old != new[0])
            members = (new[0] == np.arange(len(sums[k]))[:, None]).astype(np.float64)
            sums[k][:, :d] += members @ x
            sums[k][:, d] += members.sum(axis=1)
            found.append(new)
        return found

    return take, lambda: np.concatenate([s.ravel() for s in sums] + [changes, looked])


def _step(tiles: Tiles, fits: list[np.ndarray], before: list[np.ndarray] | None, keep: bool):
    """(tiles, sums of each fit's clusters, label changes of each fit since the centres
    ``before``, distances computed). With ``keep`` the new tiles have the bounds for
    ``fits``, and the old table is removed."""
    spark, d = tiles.table.sparkSession, fits[0].shape[1]
    shared = spark.sparkContext.broadcast((_since(fits, tiles.kept), before and _since(before, fits)))

    def run(batches):
        take, whole = _tally(*shared.value)
        for batch in batches:
            for x, bounds in zip(tiles.points(batch), tiles.bounds(batch)):
                take(x, bounds)
        yield from packed({0: whole()})

    def kept(batches):
        for batch in batches:
            take, whole = _tally(*shared.value)
            out = [], [], []
            for x, bounds in zip(tiles.points(batch), tiles.bounds(batch)):
                label, upper, lower = (np.stack(f, axis=1) for f in zip(*take(x, bounds)))
                for column, values in zip(out, (  # outwards, whatever the rounding
                        label.astype("<i4"), np.nextafter(upper.astype("<f4"), np.float32(np.inf)),
                        np.nextafter(lower.astype("<f4"), np.float32(-np.inf)))):
                    column.append(values.tobytes())
            part = [whole().tobytes(), *[None] * (batch.num_rows - 1)][:batch.num_rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("tile", "n", "ids", "x")),
                 *(pa.array(column, pa.binary()) for column in (*out, part))],
                names=["tile", "n", "ids", "x", *"luw", "part"])

    if keep:
        table, path = stored(tiles.read("tile", "ids").mapInArrow(
            kept, f"{TILE.format(t=tiles.id_type)}, {BOUNDS}, part binary"), "bounds")
        removed(spark, tiles.path)
        tiles = Tiles(table, path, tiles.id_type, tiles.kind, fits)
        total = added(table.where("part is not null").select(F.lit(0).alias("key"), "part"))[0]
    else:
        total = summed(tiles.read(), run)[0]  # a row a task
    sums, at = [], 0
    for c in fits:
        sums.append(total[at:at + len(c) * (d + 1)].reshape(len(c), d + 1))
        at += len(c) * (d + 1)
    return tiles, sums, total[at:at + len(fits)], total[-1]


def _inertia(tiles: Tiles, at: list[np.ndarray], fits: list[np.ndarray]) -> np.ndarray:
    """Sums of squared distances to ``fits`` of points with the labels for ``at``."""
    shared = tiles.table.sparkSession.sparkContext.broadcast((_since(at, tiles.kept), fits))

    def run(batches):
        at, fits = shared.value
        total = np.zeros(len(fits))
        for batch in batches:
            for x, bounds in zip(tiles.points(batch), tiles.bounds(batch)):
                for k, (c, own) in enumerate(zip(fits, bounds)):
                    total[k] += ((x - c[_labels(x, own, *at[k])[0]]) ** 2).sum()
        yield from packed({0: total})

    return summed(tiles.read(), run)[0]


def _labelled(tiles: Tiles, at: list[np.ndarray]) -> DataFrame:
    """(id, x, l) of every point."""
    shared = tiles.table.sparkSession.sparkContext.broadcast(_since(at, tiles.kept))

    def run(batches):
        for batch in batches:
            for i, (x, bounds) in enumerate(zip(tiles.points(batch), tiles.bounds(batch))):
                label = np.stack([_labels(x, own, *c)[0] for c, own in zip(shared.value, bounds)], axis=1)
                lists = (pa.ListArray.from_arrays(
                    pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                    for v in (x, label.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, *lists],
                                                 names=["id", "x", "l"])

    return tiles.read("ids").mapInArrow(run, f"id {tiles.id_type}, x array<double>, l array<int>")


def sweep(points: DataFrame, ks: list[int], seed: int = 42, max_iter: int = MAX_ITER,
          looked: list | None = None) -> tuple[dict[int, Fit], DataFrame]:
    """Fits for every K in ``ks`` of points (id, x: array of numbers), and the points
    with ``l``, their label for each K in order. ``looked`` gets the number of
    distances that each step computed. No point gives no centres."""
    ks = [int(k) for k in ks]
    tiles = tiled(points)
    first = _seeds(tiles, max(ks), seed)
    if not len(first):
        return ({k: Fit(np.zeros((0, 0)), 0.0, 0) for k in ks},
                points.select("id", F.col("x").cast("array<double>").alias("x"))
                .withColumn("l", F.array().cast("array<int>")))
    fits = [first[:k].copy() for k in ks]
    at, before = fits, None
    steps, spent, every = np.zeros(len(ks), int), 0, 0
    for _ in range(max_iter):
        keep = before is not None and spent >= every
        tiles, sums, changes, n = _step(tiles, fits, before, keep)
        if looked is not None:
            looked.append(int(n))
        every = every or n  # the first step looks at all
        spent = 0 if keep or before is None else spent + n
        at = fits
        if not changes.any():
            break
        steps += changes > 0
        fits = [np.where(s[:, -1:] > 0, s[:, :-1] / np.maximum(s[:, -1:], 1), c)
                for s, c in zip(sums, fits)]
        before = at
    total = _inertia(tiles, at, fits)
    return ({k: Fit(c, float(t), int(s)) for k, c, t, s in zip(ks, fits, total, steps)},
            _labelled(tiles, at))
