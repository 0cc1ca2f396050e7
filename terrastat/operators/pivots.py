"""Epsilon-neighbourhoods in many dimensions, partitioned around pivots.

Grids fail above three coordinates: the neighbour cells of one cell grow
exponentially. A metric partition does not depend on coordinates:

* **Pivots**: up to ``PIVOTS`` points of a bounded sample, each the farthest from
  those before. A point belongs to the cell of its nearest pivot, and the points of a
  cell are packed into tiles of about ``BLOCK`` rows, one row each.
* **Tiles** keep their mean and radius: two tiles meet (``blocks.met``, without a
  copied row) only if the means are at most both radii and eps apart. In a meeting
  the points are sorted along the line between the means; two of them can be
  neighbours only if their places on it differ by at most eps, so each slice is
  compared with the slice that this leaves.
* **Balls**: points that have many neighbours in the sample lead balls of radius
  eps/2. Two points of one ball are neighbours, so a ball of ``min_samples``
  points is *dense*: all are cores and one vertex, and no pair within is looked
  at. A ball with fewer points than a tile saves nothing and is left alone. A point
  outside counts a dense ball's members within ``eps - D`` of a leader at distance D
  as neighbours without a look, and else compares itself with the members that
  ``r >= D - eps`` leaves, until it has seen ``min_samples``.

The sample chooses pivots and balls only: it changes the work, never a result.
A cell or ball with a third of all rows is many tasks of bounded size. No pair
becomes a row: a task adds up the counts of its points; cores are joined within a
tile first, and a task sends an edge only where it joins two such groups that it has
not joined before, and the core neighbours of points that are none (fewer than
``min_samples`` each). Where only cores are asked for (``enough``), points that have
enough neighbours, within their tile or so far in the task, are not counted further.
What is written grows with the points, not with the pairs of tiles.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.operators.blocks import met, parts, within
from terrastat.operators.common import checkpointed

SAMPLE = 4096
PIVOTS, ROWS_PER_PIVOT = 256, 2048
BALLS, LEAST_IN_SAMPLE = 512, 2
BLOCK, SLICE = 2048, 256
CHUNK_ELEMENTS = 1 << 21  # of a difference tensor
SLACK = 1e-9  # pruning bounds are widened by this part, against rounding


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances from coordinate differences, in chunks."""
    out = np.empty((len(a), len(b)))
    step = max(1, CHUNK_ELEMENTS // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        diff = a[i:i + step, None, :] - b[None, :, :]
        out[i:i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


@dataclass
class Layout:
    """What a task needs to place points: bounded by the constants above."""

    eps: float
    pivots: np.ndarray     # p x d
    leaders: np.ndarray    # b x d


def layout(points: DataFrame, n: int, eps: float, min_samples: int, balls: bool) -> Layout:
    """Pivots and ball leaders from about ``SAMPLE`` points of smallest hash."""
    share = min(1.0, SAMPLE / max(1, n))
    picked = points.where(F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = picked.select("x").limit(2 * SAMPLE).collect()
    s = np.array(sorted(r.x for r in rows), float)
    if not len(s):
        s = np.array([points.select("x").first().x], float)
    count = max(1, min(PIVOTS, -(-n // ROWS_PER_PIVOT), len(s)))
    chosen, near = [0], distances(s, s[:1])[:, 0]
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(s, s[chosen[-1]:chosen[-1] + 1])[:, 0])
    leaders = []
    if balls:
        within = np.zeros(len(s), np.int64)
        close = []
        for i in range(0, len(s), 256):
            d = distances(s[i:i + 256], s) <= eps / 2
            within[i:i + 256] = d.sum(axis=1)
            close.append(np.packbits(d, axis=1))
        close = np.concatenate(close)
        free = np.ones(len(s), bool)
        for k in np.argsort(-within, kind="stable"):
            if len(leaders) == BALLS or within[k] < LEAST_IN_SAMPLE:
                break
            if free[k]:
                leaders.append(s[k])
                free &= ~np.unpackbits(close[k], count=len(s)).astype(bool)
    return Layout(eps, s[chosen], np.array(leaders, float).reshape(-1, s.shape[1]))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


PLACED = "id {t}, w long, x array<double>, cell int, ball int, ball_r double"


def place(points: DataFrame, plan: Layout) -> DataFrame:
    """Points (id, w, x) with their cell, and the ball they lie in (-1: none) with the
    distance to its leader. One pass."""
    shared = points.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        p = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _matrix(part.column("x"))
                own = distances(x, p.pivots).argmin(axis=1)
                rows = np.arange(len(x))
                ball, ball_r = np.full(len(x), -1, np.int32), np.full(len(x), np.nan)
                if len(p.leaders):
                    to = distances(x, p.leaders)
                    ball = to.argmin(axis=1).astype(np.int32)
                    ball_r = to[rows, ball]
                    ball[ball_r > p.eps / 2 * (1 - SLACK)] = -1
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("w"), part.column("x"),
                     pa.array(own.astype(np.int32)), pa.array(ball), pa.array(ball_r)],
                    names=["id", "w", "x", "cell", "ball", "ball_r"])

    return points.select("id", "w", "x").mapInArrow(
        run, PLACED.format(t=dict(points.dtypes)["id"]))


def _grouped(rows: DataFrame, *key: str) -> DataFrame:
    return rows.repartition(*key).sortWithinPartitions(*key)


def _groups(batches, key: tuple[str, ...]):
    """One table a group of rows sorted by ``key``; a group is two blocks at most."""
    last, held = None, []
    for batch in batches:
        marks = list(zip(*(batch.column(c).to_pylist() for c in key)))
        edges = [0, *(k for k in range(1, len(marks)) if marks[k] != marks[k - 1]), len(marks)]
        for at, to in zip(edges, edges[1:]):
            if at == to:
                continue
            if held and marks[at] != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            last = marks[at]
            held.append(batch.slice(at, to - at))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def _col(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _points(table: pa.Table) -> np.ndarray:
    column = table.column("x").combine_chunks()
    column = column if isinstance(column, pa.ListArray) else column.chunk(0)
    return _matrix(column)


def _near(xa: np.ndarray, xb: np.ndarray, eps: float):
    """(rows of a, rows of b, which are near) of slices that the line between the
    means leaves: points whose places on it are farther apart are no neighbours."""
    if not len(xa) or not len(xb):
        return
    a, b, wide = np.arange(len(xa)), np.arange(len(xb)), None
    line = xb.mean(axis=0) - xa.mean(axis=0)
    length = np.sqrt(line @ line)
    if not length > 0:  # one set, or no numbers
        line = np.zeros(xa.shape[1])
        line[np.argmax(np.ptp(xa, axis=0))] = 1.0
        length = 1.0
    at_a, at_b = xa @ (line / length), xb @ (line / length)
    if np.isfinite(at_a).all() and np.isfinite(at_b).all():
        wide = eps * (1 + SLACK) + SLACK * max(np.abs(at_a).max(), np.abs(at_b).max())
        a = a[(at_a >= at_b.min() - wide) & (at_a <= at_b.max() + wide)]
        b = b[(at_b >= at_a.min() - wide) & (at_b <= at_a.max() + wide)]
        a, b = a[np.argsort(at_a[a])], b[np.argsort(at_b[b])]
    for at in range(0, len(a), SLICE):
        i, j = a[at:at + SLICE], b
        if wide is not None:
            j = b[np.searchsorted(at_b[b], at_a[i[0]] - wide):
                  np.searchsorted(at_b[b], at_a[i[-1]] + wide, "right")]
        if len(j):
            for rows, cols, near in within(xa[i], xb[j], eps):
                yield i[rows], j[cols], near


def _added(near: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of each row, the weight of its near columns (exact below 2^53)."""
    return near.astype(np.float64) @ w


TILE = "t long, ids array<{t}>, x binary, mean array<double>, radius double"


def _tiles(loose: DataFrame, columns: list[str], own, more: str) -> DataFrame:
    """Packed tiles of loose points: ``TILE``, and the columns ``more`` as ``own`` makes
    them of the coordinates and ``columns`` of a tile."""
    cells = {r.cell: r["count"] for r in loose.groupBy("cell").count().collect()}  # PIVOTS at most
    cuts = F.array(*[F.lit(max(1, -(-cells.get(c, 0) // BLOCK)))
                     for c in range(max(cells, default=0) + 1)])
    tile = F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id"), cuts[F.col("cell")])
    schema = f"{TILE.format(t=dict(loose.dtypes)['id'])}, {more}"
    names = [c.split()[0] for c in schema.replace("array<", "").split(", ")]

    def seal(batches):
        for (t,), table in _groups(batches, ("t",)):
            x = _points(table)
            ids = table.column("id").combine_chunks()
            ids = ids if not isinstance(ids, pa.ChunkedArray) else pa.concat_arrays(ids.chunks)
            mean = x.mean(axis=0)
            far = np.sqrt(((x - mean) ** 2).sum(axis=1).max()) * (1 + SLACK) + SLACK * np.abs(x).max()
            yield pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), ids),
                 pa.array([x.tobytes()], pa.binary()), pa.array([mean.tolist()], pa.list_(pa.float64())),
                 pa.array([float(far)]), *own(x, *(_col(table, c) for c in columns))], names=names)

    numbered = loose.withColumn("t", tile).select("t", "id", "x", *columns)
    return checkpointed(_grouped(numbered, "t").mapInArrow(seal, schema))


def _meetings(left: DataFrame, right: DataFrame | None, eps: float, columns: list[str],
              others: list[str] | None = None, asked: str | None = None) -> DataFrame:
    """Pairs of tiles of two sides, or (``right`` None) of one, that may hold
    neighbours; with ``asked`` only those of which one has that column above 0.
    Columns end in _a and _b."""
    def side(tiles: DataFrame, name: str, wanted: list[str]) -> DataFrame:
        some = {"t", "mean", "radius", *wanted} | ({asked} if asked else set())
        cut = parts(tiles, max(1, tiles.count()), 2, 64)
        return tiles.select(*[F.col(c).alias(f"{c}_{name}") for c in tiles.columns if c in some]
                            ).repartition(cut, f"t_{name}")

    others = columns if others is None else others
    gap = F.sqrt(F.aggregate(F.zip_with("mean_a", "mean_b", lambda p, q: (p - q) * (p - q)),
                             F.lit(0.0), lambda s, v: s + v))
    reach = (F.col("radius_a") + F.col("radius_b") + F.lit(float(eps))) * F.lit(1 + 1e-6)
    on = gap <= reach
    if right is None:
        on = on & (F.col("t_a") < F.col("t_b"))
    if asked:
        on = on & ((F.col(f"{asked}_a") > 0) | (F.col(f"{asked}_b") > 0))
    return met(side(left, "a", columns), side(left if right is None else right, "b", others), on).select(
        "t_a", "t_b", *[f"{c}_a" for c in columns], *[f"{c}_b" for c in others])


def _sides(batch: pa.RecordBatch, k: int, kinds: dict[str, str], others: dict[str, str] | None = None):
    """The two tiles of a meeting, as (t, columns by name); ``x`` in rows."""
    out = []
    for side, kinds in (("a", kinds), ("b", others or kinds)):
        tile = {c: np.frombuffer(batch.column(f"{c}_{side}")[k].as_buffer(), kind)
                for c, kind in kinds.items()}
        tile["ids"] = batch.column(f"ids_{side}")[k].values
        tile["x"] = tile["x"].reshape(len(tile["ids"]), -1)
        out.append((batch.column(f"t_{side}")[k].as_py(), tile))
    return out


def count_neighbours(loose: DataFrame, eps: float, enough: int | None = None) -> DataFrame:
    """(id, n, looked): weight of the neighbours of each loose point among loose
    points, itself included, and how many points it was compared with. With
    ``enough``, a point that has so many is not counted to its end: n below ``enough``
    is the whole count, n from there on is not."""
    id_type = dict(loose.dtypes)["id"]

    def own(x, w):
        w, n, looked = w.astype(np.float64), np.zeros(len(x)), np.zeros(len(x))
        for i, j, near in _near(x, x, eps):
            n[i] += _added(near, w[j])
            looked[i] += len(j)
        asked = len(x) if enough is None else int((n < enough).sum())
        return [*(pa.array([v.astype("<i8").tobytes()], pa.binary()) for v in (w, n, looked)),
                pa.array([asked], pa.int64())]

    tiles = _tiles(loose, ["w"], own, "w binary, n binary, looked binary, asked long")

    def told(ids, n, looked):
        some = np.flatnonzero(looked)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(some)), pa.array(n[some].astype(np.int64)),
             pa.array(looked[some].astype(np.int64))], names=["id", "n", "looked"])

    def alone(batches):
        for batch in batches:
            for ids, n, looked in zip(*(batch.column(c) for c in ("ids", "n", "looked"))):
                yield told(ids.values, *(np.frombuffer(c.as_buffer(), "<i8") for c in (n, looked)))

    def meet(batches):
        sums: dict[int, list] = {}  # of the tiles of this task

        def state(t, tile):
            if t not in sums:
                sums[t] = [tile["ids"], tile["n"].astype(np.float64), *np.zeros((2, len(tile["ids"])))]
            return sums[t]

        for batch in batches:
            for k in range(batch.num_rows):
                (ta, a), (tb, b) = _sides(batch, k, {"x": "<f8", "w": "<i8", "n": "<i8"})
                (_, na, ma, la), (_, nb, mb, lb) = state(ta, a), state(tb, b)
                wa, wb = a["w"].astype(np.float64), b["w"].astype(np.float64)
                rest, every = np.arange(len(na)), np.arange(len(nb))
                if enough is not None:  # the open rows of a with b, and of b with the rest of a
                    rest, every = np.flatnonzero(na + ma < enough), np.flatnonzero(nb + mb < enough)
                    closed = np.flatnonzero(na + ma >= enough)
                    for i, j, near in _near(b["x"][every], a["x"][closed], eps):
                        i, j = every[i], closed[j]
                        mb[i] += _added(near, wa[j])
                        lb[i] += len(j)
                for i, j, near in _near(a["x"][rest], b["x"], eps):
                    i = rest[i]
                    ma[i] += _added(near, wb[j])
                    mb[j] += _added(near.T, wa[i])
                    la[i] += len(j)
                    lb[j] += len(i)
        for ids, _, m, looked in sums.values():
            yield told(ids, m, looked)

    schema = f"id {id_type}, n long, looked long"
    crossed = _meetings(tiles, None, eps, ["ids", "x", "w", "n"], asked="asked").mapInArrow(meet, schema)
    return (tiles.select("ids", "n", "looked").mapInArrow(alone, schema).unionByName(crossed)
            .groupBy("id").agg(F.sum("n").alias("n"), F.sum("looked").alias("looked")))


class _Groups:
    """Groups of numbered nodes that edges have joined so far."""

    def __init__(self):
        self.parent: list[int] = []

    def new(self, count: int) -> np.ndarray:
        at = len(self.parent)
        self.parent.extend(range(at, at + count))
        return np.arange(at, at + count)

    def root(self, k: int) -> int:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return k

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        some, back = np.unique(nodes, return_inverse=True)
        return np.array([self.root(int(k)) for k in some], np.int64)[back]

    def joins(self, xa, xb, na, nb, eps):
        """(row of a, row of b) of neighbours that join two groups; ``na`` and ``nb``
        are the nodes of the rows. Rows that have nothing to join are not compared."""
        la, lb = self.roots(na), self.roots(nb)
        ua, ub = np.unique(la), np.unique(lb)
        ia = np.flatnonzero(la != ub[0]) if len(ub) == 1 else np.arange(len(la))
        ib = np.flatnonzero(lb != ua[0]) if len(ua) == 1 else np.arange(len(lb))
        for i, j, near in _near(xa[ia], xb[ib], eps):
            i, j = ia[i], ib[j]
            apart = near & (la[i][:, None] != lb[j][None, :])
            joined = False
            for k in np.flatnonzero(apart.any(axis=1)):
                hits = j[apart[k]]
                _, first = np.unique(lb[hits], return_index=True)
                for h in hits[first]:
                    p, q = self.root(int(na[i[k]])), self.root(int(nb[h]))
                    if p != q:
                        self.parent[p] = q
                        joined = True
                        yield int(i[k]), int(h)
            if joined:
                la, lb = self.roots(na), self.roots(nb)
                if (la == la[0]).all() and (lb == la[0]).all():
                    return


def _hits(xa, xb, eps):
    """(rows of a, rows of b): all neighbours, of points that have few."""
    found = [(i[at], j[to]) for i, j, near in _near(xa, xb, eps) for at, to in (np.nonzero(near),)]
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *(f[s] for f in found)]) for s in (0, 1))


def loose_links(loose: DataFrame, eps: float) -> DataFrame:
    """(id, core): neighbours of loose points that are cores (column ``is_core``).
    Of cores only as many as join them to components: within a tile, and then the
    groups of its cores to those of other tiles. Of another point all, which are
    fewer than ``min_samples``."""
    id_type = dict(loose.dtypes)["id"]

    def own(x, core):
        core = core.astype(bool)
        cores, others = np.flatnonzero(core), np.flatnonzero(~core)
        groups = _Groups()
        nodes = groups.new(len(cores))
        for _ in groups.joins(x[cores], x[cores], nodes, nodes, eps) if len(cores) else ():
            pass
        group = np.full(len(x), -1)
        group[cores] = cores[groups.roots(nodes)] if len(cores) else nodes  # its row of the tile
        a, b = _hits(x[others], x[cores], eps)
        links = [np.append(cores[group[cores] != cores], others[a]),
                 np.append(group[cores[group[cores] != cores]], cores[b])]
        return [*(pa.array([v.astype("<i4").tobytes()], pa.binary()) for v in (group, *links)),
                pa.array([len(others)], pa.int64())]

    tiles = _tiles(loose, ["is_core"], own, "groups binary, src binary, dst binary, others long")

    def linked(ids, src, dst, cores):
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(src, pa.int64())), cores.take(pa.array(dst, pa.int64()))],
            names=["id", "core"])

    def alone(batches):
        for batch in batches:
            for ids, *links in zip(*(batch.column(c) for c in ("ids", "src", "dst"))):
                src, dst = (np.frombuffer(c.as_buffer(), "<i4") for c in links)
                yield linked(ids.values, src, dst, ids.values)

    def meet(batches):
        groups, nodes = _Groups(), {}  # of the tiles of this task

        def nodes_of(t, group):
            """The node of each core of a tile."""
            if t not in nodes:
                some, back = np.unique(group[group >= 0], return_inverse=True)
                nodes[t] = groups.new(len(some))[back]
            return nodes[t]

        for batch in batches:
            for k in range(batch.num_rows):
                (ta, a), (tb, b) = _sides(batch, k, {"x": "<f8", "groups": "<i4"})
                ca, cb = (np.flatnonzero(t["groups"] >= 0) for t in (a, b))
                oa, ob = (np.flatnonzero(t["groups"] < 0) for t in (a, b))
                na, nb = nodes_of(ta, a["groups"]), nodes_of(tb, b["groups"])
                if len(ca) and len(cb):
                    pairs = list(groups.joins(a["x"][ca], b["x"][cb], na, nb, eps))
                    if pairs:
                        src, dst = np.array(pairs).T
                        yield linked(a["ids"], ca[src], cb[dst], b["ids"])
                for one, o, other, c in ((a, oa, b, cb), (b, ob, a, ca)):
                    src, dst = _hits(one["x"][o], other["x"][c], eps)
                    if len(src):
                        yield linked(one["ids"], o[src], c[dst], other["ids"])

    schema = f"id {id_type}, core {id_type}"
    return (tiles.select("ids", "src", "dst").mapInArrow(alone, schema)
            .unionByName(_meetings(tiles, None, eps, ["ids", "x", "groups"]).mapInArrow(meet, schema)))


def _ball_tiles(members: DataFrame) -> DataFrame:
    """Members of each ball in tiles, sorted by their distance to the leader."""
    def own(x, ball_r, w):
        order = np.argsort(ball_r, kind="stable")
        return [*(pa.array([v[order].tobytes()], pa.binary()) for v in (ball_r, w.astype("<i8"), x)),
                pa.array([len(x)], pa.int64())]

    return _tiles(members.withColumn("cell", F.col("ball")), ["ball_r", "w"], own,
                  "r binary, w binary, sorted binary, size long").drop("x").withColumnRenamed("sorted", "x")


def near_balls(loose: DataFrame, members: DataFrame, plan: Layout, min_samples: int) -> DataFrame:
    """(id, ball, n, looked): dense balls with a member within eps of a loose
    point, and the weight of such members, counted up to ``min_samples``."""
    eps = plan.eps
    id_type = dict(loose.dtypes)["id"]
    shared = loose.sparkSession.sparkContext.broadcast(plan.leaders)
    asked = _tiles(loose, [], lambda x: [pa.array([len(x)], pa.int64())], "size long")
    offered = _ball_tiles(members)
    wide = eps * (1 + SLACK)

    def counted(x, far, tile):
        """n and looked of points at distance ``far`` from the leader of a tile's ball."""
        y, r, w = tile["x"], tile["r"], tile["w"]
        upto = np.append(0, np.cumsum(w))
        sure = np.searchsorted(r, eps * (1 - SLACK) - far - SLACK * r[-1], "right")
        n, looked = upto[sure], np.zeros(len(x), np.int64)
        for at in range(len(r), 0, -256):  # nearest to the rim first
            first = max(0, at - 256)
            left = np.flatnonzero((n < min_samples) & (r[at - 1] >= far - wide - SLACK) & (sure < at))
            if not len(left):
                continue
            beyond = np.arange(first, at)[None, :] >= sure[left][:, None]
            for rows, cols, near in within(x[left], y[first:at], eps):
                near &= beyond[rows, cols]
                n[left[rows]] += _added(near, w[first:at][cols]).astype(np.int64)
            looked[left] += at - first
        return n, looked

    def meet(batches):
        leaders, sums = shared.value, {}  # of the tiles and balls of this task
        at = None
        for batch in batches:
            for k in range(batch.num_rows):
                (ta, a), (tb, b) = _sides(batch, k, {"x": "<f8"}, {"x": "<f8", "r": "<f8", "w": "<i8"})
                ball = tb >> 32
                if ta != at:
                    yield from told(sums)
                    at, sums = ta, {}
                far = distances(a["x"], leaders[ball:ball + 1])[:, 0]
                some = np.flatnonzero(far <= 1.5 * wide)
                n, looked = counted(a["x"][some], far[some], b)
                _, n_all, looked_all = sums.setdefault(
                    ball, (a["ids"], *np.zeros((2, len(far)), np.int64)))
                n_all[some] += n
                looked_all[some] += looked
        yield from told(sums)

    def told(sums):
        for ball, (ids, n, looked) in sums.items():
            hit = np.flatnonzero((n > 0) | (looked > 0))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(hit)), pa.array(np.full(len(hit), ball, np.int32)),
                 pa.array(n[hit]), pa.array(looked[hit])], names=["id", "ball", "n", "looked"])

    return (_meetings(asked, offered, eps, ["ids", "x"], ["ids", "x", "r", "w"])
            .mapInArrow(meet, f"id {id_type}, ball int, n long, looked long")
            .groupBy("id", "ball").agg(F.sum("n").alias("n"), F.sum("looked").alias("looked")))


def ball_links(members: DataFrame, plan: Layout, dense: list[int]) -> DataFrame:
    """(a, b) dense balls with two members within eps, as many as join them. Leaders
    are points, so balls whose leaders are neighbours are linked; the others meet in
    tiles, unless the balls are joined already in the task."""
    eps, spark = plan.eps, members.sparkSession
    apart = distances(plan.leaders[dense], plan.leaders[dense]) if dense else np.zeros((0, 0))
    known = [(dense[k], dense[m]) for k, row in enumerate(apart) for m in range(k + 1, len(row))
             if row[m] <= eps * (1 - SLACK)]
    shared = spark.sparkContext.broadcast((known, len(plan.leaders)))
    tiles = _ball_tiles(members)

    def meet(batches):
        known, count = shared.value
        groups = _Groups()
        groups.new(count)
        for a, b in known:
            groups.parent[groups.root(a)] = groups.root(b)
        for batch in batches:
            for k in range(batch.num_rows):
                (ta, a), (tb, b) = _sides(batch, k, {"x": "<f8"})
                of_a, of_b = ta >> 32, tb >> 32
                if of_a == of_b or groups.root(of_a) == groups.root(of_b):
                    continue
                nodes = (np.full(len(t["x"]), of) for t, of in ((a, of_a), (b, of_b)))
                if any(True for _ in groups.joins(a["x"], b["x"], *nodes, eps)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([of_a], pa.int32()), pa.array([of_b], pa.int32())], names=["a", "b"])

    links = _meetings(tiles, None, eps, ["ids", "x"]).mapInArrow(meet, "a int, b int")
    return spark.createDataFrame(known, "a int, b int").unionByName(links).distinct()
