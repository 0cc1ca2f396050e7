"""Mean silhouette (M2), Euclidean and exact, without materialising pairs.

Points are hashed into T tiles of ``tile_rows`` rows or more, and each tile is
packed into one row of arrays. Tile pairs (a, b) with a <= b meet without a shuffle
(``blocks.met``): a task reads one part of the tiles and another one, computes each
|a|×|b| distance block once in NumPy, for any number of labelings at the same time,
and adds up, for each point and each cluster, the distances to the other side. It
sends one packed row a tile that it met. So what is written is the tiles and their
sums, some P times (P parts, about three times the root of the number of cores), not
the T²/2 pairs, and a tile is bounded whatever the skew of labels.
Points on a line (one coordinate) need no pairs: tiles are ranges of the line, a
tile sends the sums of distances to its two ends, and running sums over gaps between
neighbours give every point's distances to every cluster, so the work is a sort.
A single labeling needs fewer blocks: ``silhouette_samples`` skips the clusters
that a bound rules out.
``method='squared'`` is Spark ML's ClusteringEvaluator (squared Euclidean),
a different quantity, offered under its own name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.operators.blocks import PACKED, distances, matrix, met, packed, parts, summed
from terrastat.operators.common import checkpointed

DEFAULT_TILE_ROWS = 4096
TILES = 64  # smaller tiles are made larger until so many are left
LINE_TILES, LINE_SUMS = 4096, 1 << 22  # tiles of a line, and their sums (tiles x clusters), at most
CHUNK_ELEMENTS = 1 << 22  # ~32 MB of float64 differences per chunk


def _distances(xl: np.ndarray, xr: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance block from coordinate differences (no Gram
    shortcut, which loses precision for near-duplicates), in row chunks so
    the difference tensor stays small."""
    out = np.empty((len(xl), len(xr)))
    step = max(1, CHUNK_ELEMENTS // max(1, len(xr) * xl.shape[1]))
    for i in range(0, len(xl), step):
        diff = xl[i:i + step, None, :] - xr[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _tile_rows(n: int, tile_rows: int) -> int:
    return max(tile_rows, min(DEFAULT_TILE_ROWS, math.ceil(n / TILES)))


def _one_hot(labels: np.ndarray, domains: list[list[int]]) -> np.ndarray:
    """rows × (clusters of all labelings): which clusters a row is in."""
    parts = [labels[:, [k]] == np.array(d)[None, :] for k, d in enumerate(domains)]
    return np.concatenate(parts, axis=1).astype(np.float64)


def _tiles(df: DataFrame, id_col: str, x_col: str, label_cols: list[str], tiles: int,
           line: bool = False) -> DataFrame:
    """(tile, ids, labels, xs): one row a tile, its points in id order. On a ``line``
    tiles are ranges of the coordinate; equal ones are split by id."""
    point = F.struct(F.col(id_col).alias("id"),
                     F.array(*[F.col(c).cast("long") for c in label_cols]).alias("l"),
                     F.col(x_col).cast("array<double>").alias("x"))
    if line:
        df = df.repartitionByRange(tiles, F.col(x_col)[0], F.xxhash64(id_col))
    tile = F.spark_partition_id() if line else F.pmod(F.xxhash64(id_col), F.lit(tiles))
    packed = df.select(tile.alias("tile"), point.alias("p")).groupBy("tile").agg(
        F.array_sort(F.collect_list("p")).alias("p"))  # about tile_rows points
    return checkpointed(packed.select(
        "tile", F.transform("p", lambda q: q["id"]).alias("ids"),
        F.flatten(F.transform("p", lambda q: q["l"])).alias("labels"),
        F.flatten(F.transform("p", lambda q: q["x"])).alias("xs")))


def _scored(ids: pa.Array, labels: np.ndarray, sums: np.ndarray, domains: list[list[int]],
            cluster_n: np.ndarray):
    """A batch for each labeling from the points' distance sums to every cluster."""
    starts = np.cumsum([0] + [len(d) for d in domains])
    for k, domain in enumerate(domains):
        s, size = sums[:, starts[k]:starts[k + 1]], cluster_n[starts[k]:starts[k + 1]]
        own = np.searchsorted(domain, labels[:, k])
        rows = np.arange(len(labels))
        alone = size[own] <= 1
        a = s[rows, own] / np.maximum(size[own] - 1, 1)
        mean = s / size[None, :]
        mean[rows, own] = np.inf
        b = mean.min(axis=1)
        high = np.maximum(a, b)
        ok = ~alone & np.isfinite(b) & (high > 0)
        v = np.where(ok, (np.where(ok, b, 0) - a) / np.where(ok, high, 1), 0.0)
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.full(len(rows), k), pa.int64()), pa.array(labels[:, k]), pa.array(v)],
            names=["id", "position", "label", "silhouette"])


def _carried(ends: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Tile -> (points before, their distances to the tile's first point, points
    after, their distances to its last) by cluster, from each tile's (first, last,
    points, distances to the last, to the first). Only sums of what is not negative,
    so nothing cancels."""
    order = sorted(ends, key=lambda t: (ends[t][0], ends[t][1], t))
    first, last = (np.array([ends[t][i] for t in order]) for i in (0, 1))
    n, below, above = np.array([ends[t][2:].reshape(3, -1) for t in order]).transpose(1, 0, 2)
    out = np.zeros((len(order), 4, n.shape[1]))
    for i in range(1, len(order)):
        out[i, 0] = out[i - 1, 0] + n[i - 1]
        out[i, 1] = (out[i - 1, 1] + out[i - 1, 0] * (last[i - 1] - first[i - 1]) + below[i - 1]
                     + out[i, 0] * (first[i] - last[i - 1]))
    for i in range(len(order) - 2, -1, -1):
        out[i, 2] = out[i + 1, 2] + n[i + 1]
        out[i, 3] = (out[i + 1, 3] + out[i + 1, 2] * (last[i + 1] - first[i + 1]) + above[i + 1]
                     + out[i, 2] * (first[i + 1] - last[i]))
    return dict(zip(order, out))


def _on_line(tiles: DataFrame, domains: list[list[int]], cluster_n: np.ndarray,
             schema: str) -> DataFrame:
    """Scores of points with one coordinate, whose ``tiles`` are ranges of it."""
    count = len(domains)

    def columns(batch):
        return zip(batch.column("tile").to_pylist(), _lists(batch.column("labels")),
                   _lists(batch.column("xs")))

    def ends(batches):
        for batch in batches:
            for tile, labels, x in columns(batch):
                hot = _one_hot(labels.reshape(-1, count), domains)
                yield from packed({tile: np.concatenate([
                    [x.min(), x.max()], hot.sum(axis=0), (x.max() - x) @ hot, (x - x.min()) @ hot])})

    sent = tiles.select("tile", "labels", "xs").mapInArrow(ends, PACKED).collect()  # a row a tile
    shared = tiles.sparkSession.sparkContext.broadcast(
        _carried({r.key: np.frombuffer(bytes(r.part), "<f8") for r in sent}))

    def scores(batches):
        for batch in batches:
            for i, (tile, labels, x) in enumerate(columns(batch)):
                order = np.argsort(x, kind="stable")
                labels, gaps = labels.reshape(-1, count)[order], np.diff(x[order])[:, None]
                hot = _one_hot(labels, domains)
                n_before, before, n_after, after = shared.value[tile]
                sums = np.tile(before + after, (len(x), 1))
                upto = np.cumsum(hot, axis=0)
                sums[1:] += np.cumsum(gaps * (n_before + upto[:-1]), axis=0)
                back = gaps * (n_after + (upto[-1] - upto[:-1]))
                sums[:-1] += np.cumsum(back[::-1], axis=0)[::-1]
                yield from _scored(batch.column("ids")[i].values.take(pa.array(order)), labels, sums,
                                   domains, cluster_n)

    return tiles.select("tile", "ids", "labels", "xs").mapInArrow(scores, schema)


def silhouette_many(df: DataFrame, id_col: str, x_col: str, label_cols: list[str],
                    tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """Per point and labeling: id, position of the label column, label,
    silhouette s(i) = (b - a)/max(a, b); a singleton cluster's point scores 0.
    ``x_col`` is an array<double|float> column."""
    on_line = (F.size(x_col) == 1) & (F.abs(F.get(x_col, F.lit(0))) < math.inf)  # not so for NaN
    for c in label_cols:
        on_line &= F.col(c).cast("long").isNotNull()
    found = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(on_line, 1)).alias("line")).first()
    n, line = found.n, 0 < found.n == found.line
    number = max(1, math.ceil(n / _tile_rows(n, tile_rows)))
    count = len(label_cols)
    sizes = df.select(F.posexplode(F.array(*[F.col(c).cast("long") for c in label_cols]))
                      .alias("k", "label")).groupBy("k", "label").agg(
        F.count(F.lit(1)).alias("n")).orderBy("k", "label").collect()  # one row a cluster
    domains = [[r.label for r in sizes if r.k == k] for k in range(count)]
    cluster_n = np.array([r.n for r in sizes], np.float64)
    schema = f"id {dict(df.dtypes)[id_col]}, position long, label long, silhouette double"
    if line:
        number = min(number, LINE_TILES, max(1, LINE_SUMS // max(1, len(sizes))))
        tiles = _tiles(df, id_col, x_col, label_cols, number, line=True)
        return _on_line(tiles, domains, cluster_n, schema)

    tiles = _tiles(df, id_col, x_col, label_cols, number)
    cut = parts(df, number, 3)
    left = tiles.select(F.col("tile").cast("long").alias("a"), F.col("labels").alias("la"),
                        F.col("xs").alias("xa")).repartitionByRange(cut, "a")
    right = tiles.select(F.col("tile").cast("long").alias("b"), F.col("labels").alias("lb"),
                         F.col("xs").alias("xb")).repartitionByRange(cut, "b")
    pairs = met(left, right, F.col("a") <= F.col("b"))

    def blocks(batches):
        """A row for each left tile that comes, and one for each right tile."""
        at, total, others = None, None, {}
        for batch in batches:
            tiles_of = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                           *(_lists(batch.column(c)) for c in ("la", "lb", "xa", "xb")))
            for a, b, la, lb, xa, xb in tiles_of:
                la, lb = la.reshape(-1, count), lb.reshape(-1, count)
                ha, hb = _one_hot(la, domains), _one_hot(lb, domains)
                if a != at:
                    if at is not None:
                        yield _packed(at, total)
                    at, total = a, np.zeros(ha.shape)
                other = None if a == b else others.setdefault(b, np.zeros(hb.shape))
                for rows, cols, d in distances(xa.reshape(len(la), -1), xb.reshape(len(lb), -1)):
                    total[rows] += d @ hb[cols]
                    if other is not None:
                        other[cols] += d.T @ ha[rows]
        if at is not None:
            yield _packed(at, total)
        for b, other in others.items():
            yield _packed(b, other)

    def add(batches):  # sorted by tile
        tile, total = None, None
        for batch in batches:
            for t, m in zip(batch.column("tile").to_pylist(), batch.column("sums").to_pylist()):
                part = np.frombuffer(m, np.float64)
                if t != tile:
                    if tile is not None:
                        yield _packed(tile, total)
                    tile, total = t, part.copy()
                else:
                    total += part
        if tile is not None:
            yield _packed(tile, total)

    def _packed(tile, total):
        return pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()),
                                           pa.array([total.tobytes()], pa.binary())],
                                          names=["tile", "sums"])

    def scores(batches):
        for batch in batches:
            ids_of = batch.column("ids")
            for i, (labels, raw) in enumerate(zip(_lists(batch.column("labels")),
                                                  batch.column("sums").to_pylist())):
                labels = labels.reshape(-1, count)
                yield from _scored(ids_of[i].values, labels,
                                   np.frombuffer(raw, np.float64).reshape(len(labels), -1),
                                   domains, cluster_n)

    summed = (pairs.select("a", "b", "la", "lb", "xa", "xb").mapInArrow(blocks, "tile long, sums binary")
              .repartition("tile").sortWithinPartitions("tile").mapInArrow(add, "tile long, sums binary"))
    return (tiles.select(F.col("tile").cast("long").alias("tile"), "ids", "labels").join(summed, "tile")
            .select("ids", "labels", "sums")
            .mapInArrow(scores, schema))


def _packs(rows: DataFrame, key: str, tiles) -> DataFrame:
    """(key, tile, ids, xs): rows (id, key, x) packed by key into ``tiles`` parts
    (a number or a column)."""
    points = F.array_sort(F.collect_list(F.struct("id", "x")))  # about tile_rows points
    packed = rows.withColumn("tile", F.pmod(F.xxhash64("id"), tiles).cast("int"))
    return packed.groupBy(key, "tile").agg(points.alias("p")).select(
        key, "tile", F.transform("p", lambda q: q["id"]).alias("ids"),
        F.flatten(F.transform("p", lambda q: q["x"])).alias("xs"))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column as arrays, read from its buffer."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
    return [flat[a - ends[0]:b - ends[0]] for a, b in zip(ends, ends[1:])]


def _distance_sums(queries: DataFrame, targets: DataFrame, tiles: int) -> DataFrame:
    """(id, c, s): the sum of distances of each query (id, c, x) to the points of
    cluster ``c``, whose tiles are in ``targets``. ``tiles`` cuts the queries to a
    cluster, which are all points at most."""
    id_type = dict(queries.dtypes)["id"]
    met_parts = parts(queries, max(1, targets.count()), 1)
    left = _packs(queries, "c", F.lit(tiles)).select(
        "c", "tile", "ids", F.size("ids").alias("n"), F.col("xs").alias("xa")).repartition(
        parts(queries, 1 << 30, 4, 1 << 30), "c", "tile")
    right = targets.select(F.col("c").alias("tc"), F.size("ids").alias("m"),
                           F.col("xs").alias("xb")).repartition(met_parts, F.xxhash64("tc", "xb"))
    pairs = met(left, right, F.col("c") == F.col("tc"))

    def blocks(batches):
        """A row for each query tile: its sums to the target tiles of this task."""
        at, ids, total = None, None, None
        for batch in batches:
            n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
            keys = zip(batch.column("c").to_pylist(), batch.column("tile").to_pylist())
            for k, (key, xa, xb) in enumerate(zip(keys, _lists(batch.column("xa")),
                                                  _lists(batch.column("xb")))):
                if key != at:
                    if at is not None:
                        yield part(at, ids, total)
                    at, ids, total = key, batch.column("ids")[k].values, np.zeros(n[k])
                for rows, _, d in distances(xa.reshape(n[k], -1), xb.reshape(m[k], -1)):
                    total[rows] += d.sum(axis=1)
        if at is not None:
            yield part(at, ids, total)

    def part(key, ids, total):
        offsets = pa.array([0, len(ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()),
             pa.ListArray.from_arrays(offsets, ids), pa.array([total.tobytes()], pa.binary())],
            names=["c", "tile", "ids", "sums"])

    def add(batches):  # sorted by tile
        key, ids, total = None, None, None
        for batch in batches:
            keys = zip(batch.column("c").to_pylist(), batch.column("tile").to_pylist())
            for k, (at, raw) in enumerate(zip(keys, batch.column("sums").to_pylist())):
                part = np.frombuffer(raw, np.float64)
                if at != key:
                    if key is not None:
                        yield one(key, ids, total)
                    key, ids, total = at, batch.column("ids")[k].values, np.zeros(len(part))
                total += part
        if key is not None:
            yield one(key, ids, total)

    def one(key, ids, total):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(np.full(len(total), key[0], np.int32)), pa.array(total)],
            names=["id", "c", "s"])

    return (pairs.mapInArrow(blocks, f"c int, tile int, ids array<{id_type}>, sums binary")
            .repartition("c", "tile").sortWithinPartitions("c", "tile")
            .mapInArrow(add, f"id {id_type}, c int, s double"))


def silhouette_samples(df: DataFrame, id_col: str, x_col: str, label_col: str,
                       tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """id, label, silhouette of one labeling, with as few distances as it needs: a
    point's mean distance to a cluster is at least its distance to the cluster's
    mean (Jensen), so with the distances to its own cluster and to the one of the
    nearest mean known, clusters whose mean lies beyond the best so far can't be
    the nearest and are skipped. The others are summed in a second round."""
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("long").alias("l"),
                     F.col(x_col).cast("array<double>").alias("x"))
    sizes = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()  # one a cluster
    labels = np.array([r.l for r in sizes], np.int64)
    id_type, label_type = dict(rows.dtypes)["id"], dict(df.dtypes)[label_col]
    if len(labels) < 2:  # no other cluster
        return rows.select(F.col("id").alias(id_col), F.col("l").cast(label_type).alias(label_col),
                           F.lit(0.0).alias("silhouette"))

    def totals(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            x = matrix(batch.column("x"))
            at = np.searchsorted(labels, np.asarray(batch.column("l")))
            for c in np.unique(at):
                parts[int(c)] = parts.get(int(c), 0) + x[at == c].sum(axis=0)
        yield from packed(parts)

    sums = summed(rows, totals)
    means = np.array([sums[c] / r.n for c, r in enumerate(sizes)])
    shared = rows.sparkSession.sparkContext.broadcast((labels, means))

    def place(batches):
        """(id, own, x, near): the cluster and the one of the nearest other mean."""
        labels, means = shared.value
        for batch in batches:
            own = np.searchsorted(labels, np.asarray(batch.column("l"))).astype(np.int32)
            far = _distances(matrix(batch.column("x")), means)
            far[np.arange(len(own)), own] = np.inf
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(own), batch.column("x"),
                 pa.array(far.argmin(axis=1).astype(np.int32))], names=["id", "own", "x", "near"])

    placed = checkpointed(rows.mapInArrow(place, f"id {id_type}, own int, x array<double>, near int"))
    n_rows = sum(r.n for r in sizes)
    tile_rows = _tile_rows(n_rows, tile_rows)
    cuts = F.array(*[F.lit(math.ceil(r.n / tile_rows)) for r in sizes])
    targets = checkpointed(_packs(placed.select("id", F.col("own").alias("c"), "x"), "c",
                                  cuts[F.col("c")]))
    tiles = math.ceil(n_rows / tile_rows)
    count = F.array(*[F.lit(int(r.n)).cast("double") for r in sizes])

    def mean_to(sums: DataFrame) -> DataFrame:
        return sums.select("id", "c", "s", (F.col("s") / count[F.col("c")]).alias("mean"))

    first = placed.select("id", "x", F.explode(F.array("own", "near")).alias("c"))
    known = checkpointed(
        mean_to(_distance_sums(first, targets, tiles))
        .join(placed.select("id", "own", "near"), "id").groupBy("id", "own", "near")
        .agg(F.max(F.when(F.col("c") == F.col("own"), F.col("s"))).alias("inside"),
             F.max(F.when(F.col("c") == F.col("near"), F.col("mean"))).alias("b")))

    def beyond(batches):
        """(id, c, x): the clusters that may still be nearer than ``b``."""
        labels, means = shared.value
        for batch in batches:
            far = _distances(matrix(batch.column("x")), means)
            rows_of = np.arange(len(far))
            for c in ("own", "near"):
                far[rows_of, np.asarray(batch.column(c))] = np.inf
            at, c = np.nonzero(far < np.asarray(batch.column("b"))[:, None] * (1 + 1e-9))
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), pa.array(c.astype(np.int32)),
                 batch.column("x").take(take)], names=["id", "c", "x"])

    open_ = placed.join(known.select("id", "b"), "id").mapInArrow(
        beyond, f"id {id_type}, c int, x array<double>")
    more = (mean_to(_distance_sums(open_, targets, tiles)).groupBy("id")
            .agg(F.min("mean").alias("other")))
    n = count[F.col("own")]
    a, b = F.col("inside") / (n - 1), F.least("b", "other")
    high = F.greatest(F.col("a"), F.col("b"))
    scored = known.join(more, "id", "left").select(
        "id", "own", F.when(n > 1, a).alias("a"), b.alias("b")).select(
        "id", "own", F.when(F.col("a").isNotNull() & (high > 0), (F.col("b") - F.col("a")) / high)
        .otherwise(F.lit(0.0)).alias("silhouette"))
    names = F.array(*[F.lit(int(x)) for x in labels])
    return scored.select(F.col("id").alias(id_col),
                         names[F.col("own")].cast(label_type).alias(label_col), "silhouette")


def silhouette_means(df: DataFrame, id_col: str, x_col: str, label_cols: list[str],
                     tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """(position, silhouette): the mean of each labeling, from one pass over
    the distance blocks."""
    return silhouette_many(df, id_col, x_col, label_cols, tile_rows).groupBy("position").agg(
        F.avg("silhouette").alias("silhouette"))


def silhouette_score(df: DataFrame, id_col: str, x_col: str, label_col: str,
                     method: str = "exact", tile_rows: int = DEFAULT_TILE_ROWS) -> DataFrame:
    """One-row mean silhouette. ``exact``: Euclidean (the reference's
    metric); ``squared``: Spark ML's squared-Euclidean evaluator."""
    if method == "squared":
        from pyspark.ml.evaluation import ClusteringEvaluator
        from pyspark.ml.functions import array_to_vector
        v = df.select(array_to_vector(F.col(x_col).cast("array<double>")).alias("features"),
                      F.col(label_col).cast("int").alias("prediction"))
        val = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(v)
        return df.sparkSession.range(1).select(F.lit(val).alias("silhouette"))
    s = silhouette_samples(df, id_col, x_col, label_col, tile_rows)
    return s.agg(F.avg("silhouette").alias("silhouette"))


def best_k(evaluation: DataFrame) -> DataFrame:
    """M3: highest silhouette; strict comparison, so the smallest K wins a tie."""
    return evaluation.orderBy(F.col("silhouette").desc(), F.col("k")).limit(1).select(
        F.col("k").alias("best_k"), F.col("silhouette").alias("best_silhouette"))
