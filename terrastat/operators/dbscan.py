"""DBSCAN (D1-D2) as DataFrame work, and the DBSCAN result frames.

0. Exact duplicates collapse into one weighted point per distinct
   coordinate (the smallest id represents it); a group of copies holding a
   third of the rows is one row from here on, and every copy takes its
   representative's result through one equi-join at the end.

For d <= 3 coordinates (the usual case after PCA, or planar points):

1. Fine grid of side eps/sqrt(d) (shrunk by 1e-12 against rounding): two
   points of one cell are always within eps. A cell whose weighted count
   reaches min_samples is *dense*: all its points are cores, no pair needed.
2. Pairs are enumerated only from points of *sparse* cells (fewer than
   min_samples each) to points of other cells: the sparse side is
   replicated to the neighbour-cell offsets that can hold a point within eps
   (an equi-join on cell keys, never a cross join) and filtered on the exact
   squared distance. Core = cell count + cross-cell neighbours >= min_samples
   (a point is its own neighbour, as in the reference's library).
3. Two adjacent dense cells are linked by a bounded witness test on
   sub-cells (``dense_cell_links``), never by enumerating their pairs.
4. Components run on the cell graph (one vertex per cell's smallest core,
   one edge per linked cell pair; components.py). Cluster ids are the rank
   of each component's smallest core key, minus 1: the library numbers
   clusters in the order their first core point is met, and keys follow
   row order.
5. A border point (always in a sparse cell) takes the smallest cluster id
   among the cores of its own cell and its cross-cell core neighbours;
   everything else is noise (-1).

For d > 3 the neighbour-offset count of the fine grid explodes. There points are
partitioned around pivots into tiles with means and radii, which prune, and dense
balls of radius eps/2 (pivots.py); steps 4 and 5 are the same.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastat.operators import pivots as PV
from terrastat.operators.common import checkpointed
from terrastat.operators.components import connected_components
from terrastat.operators.scan import global_prefix

FINE_GRID_MAX_DIMS = 3
GRID_DIMS = 3
DEFAULT_EPS = 1.5
DEFAULT_MIN_SAMPLES = 5
LEGACY_AUTO_MIN_SAMPLES = 5  # fixed value: the reference treats 5 as "auto"


def effective_min_samples(min_samples: int | None, dims: int, legacy_auto: bool = False) -> int:
    """``None`` -> max(4, 2·dims); with ``legacy_auto`` the value 5 also
    means automatic (the reference's behaviour)."""
    if min_samples is None or (legacy_auto and min_samples == LEGACY_AUTO_MIN_SAMPLES):
        return max(4, 2 * dims)
    return int(min_samples)


def neighbour_pairs(points: DataFrame, id_col: str, coords: list[str], eps: float,
                    grid_dims: int = GRID_DIMS) -> DataFrame:
    """All (id, nid) with Euclidean distance <= eps, self pairs included."""
    m = min(grid_dims, len(coords))
    cells = [F.floor(F.col(c) / F.lit(eps)).cast("long") for c in coords[:m]]
    base = points.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(coords)],
                         *[cell.alias(f"g{i}") for i, cell in enumerate(cells)])
    offsets = F.array(*[F.array(*[F.lit(o) for o in combo])
                        for combo in itertools.product((-1, 0, 1), repeat=m)])
    shifted = base.select(F.col("id").alias("nid"),
                          *[F.col(f"x{i}").alias(f"y{i}") for i in range(len(coords))],
                          *[F.col(f"g{i}").alias(f"h{i}") for i in range(m)],
                          F.explode(offsets).alias("_o"))
    shifted = shifted.select("nid", *[f"y{i}" for i in range(len(coords))],
                             *[(F.col(f"h{i}") + F.col("_o")[i]).alias(f"g{i}") for i in range(m)])
    j = base.join(shifted, [f"g{i}" for i in range(m)])
    d2 = None
    for i in range(len(coords)):
        t = (F.col(f"x{i}") - F.col(f"y{i}")) * (F.col(f"x{i}") - F.col(f"y{i}"))
        d2 = t if d2 is None else d2 + t
    return j.where(d2 <= F.lit(eps * eps)).select("id", "nid")


# the fine grid is shrunk by this factor so that two points of one cell are
# within eps even after floating-point rounding of the cell index
SIDE_SHRINK = 1.0 - 1e-12
# sub-cell levels (2^L sub-cells per axis) for the dense-cell witness test
SUB_LEVELS = {1: 6, 2: 3, 3: 2}
# further cuts of undecided sub-cells: how many, and by 2^step per axis each
REFINE = 3
SUB_STEP = {1: 3, 2: 2, 3: 1}
GEOM_TOL = 1e-9


def fine_side(eps: float, d: int) -> float:
    return eps / math.sqrt(d) * SIDE_SHRINK


def fine_cell_offsets(d: int, eps: float = 1.0) -> list[tuple[int, ...]]:
    """Non-zero offsets between fine cells whose closest points can be within
    eps: side^2 * sum over axes of max(|o|-1, 0)^2 <= eps^2."""
    side = fine_side(eps, d)
    r = math.ceil(eps / side) + 1
    lim = (eps / side) ** 2 * (1 + GEOM_TOL)
    return [o for o in itertools.product(range(-r, r + 1), repeat=d)
            if any(o) and sum(max(abs(v) - 1, 0) ** 2 for v in o) <= lim]


def _grid_points(points: DataFrame, id_col: str, coords: list[str], eps: float,
                 weight: str | None) -> DataFrame:
    d = len(coords)
    side = fine_side(eps, d)
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    base = points.select(F.col(id_col).alias("id"), w.alias("w"),
                         *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(coords)],
                         *[F.floor(F.col(c) / F.lit(side)).cast("long").alias(f"g{i}")
                           for i, c in enumerate(coords)])
    keys = [f"g{i}" for i in range(d)]
    counts = base.groupBy(*keys).agg(F.sum("w").alias("cell_n"))
    return checkpointed(base.join(counts, keys))


def _sq_dist(d: int, a: str = "x", b: str = "y"):
    d2 = None
    for i in range(d):
        t = (F.col(f"{a}{i}") - F.col(f"{b}{i}")) * (F.col(f"{a}{i}") - F.col(f"{b}{i}"))
        d2 = t if d2 is None else d2 + t
    return d2


def cross_pairs(left: DataFrame, cells: DataFrame, d: int, eps: float) -> DataFrame:
    """(id, nid, nw): points of ``left`` paired with every point of
    ``cells`` in another fine cell within eps (equi-join on the replicated
    neighbour-cell offsets, never a cross join)."""
    keys = [f"g{i}" for i in range(d)]
    offsets = F.array(*[F.array(*[F.lit(v) for v in o]) for o in fine_cell_offsets(d, eps)])
    # replicate the (smaller) left side to its neighbour cells
    shifted = left.select("id", *[f"x{i}" for i in range(d)], *keys, F.explode(offsets).alias("_o"))
    shifted = shifted.select("id", *[f"x{i}" for i in range(d)],
                             *[(F.col(f"g{i}") + F.col("_o")[i]).alias(f"g{i}") for i in range(d)])
    right = cells.select(F.col("id").alias("nid"), F.col("w").alias("nw"),
                         *[F.col(f"x{i}").alias(f"y{i}") for i in range(d)], *keys)
    j = shifted.join(right, keys)
    return j.where(_sq_dist(d) <= F.lit(eps * eps)).select("id", "nid", "nw")


def fine_grid(points: DataFrame, id_col: str, coords: list[str], eps: float,
              weight: str | None = None):
    """(cells, cross_pairs): every point with its fine cell and the cell's
    (weighted) point count, and all (id, nid, nw) pairs within eps lying in
    different cells (``nw`` = weight of ``nid``, 1 when unweighted)."""
    cells = _grid_points(points, id_col, coords, eps, weight)
    return cells, cross_pairs(cells, cells, len(coords), eps)


def _bounds(d: int, sub: float, eps: float):
    """(sure, maybe) of a sub-cell pair from the offsets of au* and bu*: the
    far corners are within eps; the facing sides are."""
    gap2 = span2 = None
    for i in range(d):
        du = F.abs(F.col(f"bu{i}") - F.col(f"au{i}"))
        g = F.greatest(du - 1, F.lit(0)).cast("double")
        t1, t2 = g * g, (du + 1).cast("double") * (du + 1).cast("double")
        gap2 = t1 if gap2 is None else gap2 + t1
        span2 = t2 if span2 is None else span2 + t2
    lim = (eps / sub) ** 2
    return span2 <= lim * (1 - GEOM_TOL), gap2 <= lim * (1 + GEOM_TOL)


def dense_cell_links(dense: DataFrame, d: int, eps: float) -> DataFrame:
    """Pairs of dense fine cells (every point a core) holding at least one
    point pair within eps, decided without enumerating their point pairs.

    Each dense cell is cut into 2^L sub-cells per axis. For two sub-cells the
    integer offset bounds every point distance from below (facing faces) and
    above (far corners): a sub-cell pair whose far corners are within eps is
    a witness; one whose faces are farther apart is irrelevant. The "maybe"
    pairs of cell pairs that still lack a witness are cut again, ``REFINE``
    times; what is left lies within a few thousandths of a cell of the exact
    distance eps, and only there points are compared.
    """
    keys = [f"g{i}" for i in range(d)]
    ak, bk = [f"a{i}" for i in range(d)], [f"b{i}" for i in range(d)]
    au, bu = [f"au{i}" for i in range(d)], [f"bu{i}" for i in range(d)]
    levels = [SUB_LEVELS[d] + i * SUB_STEP[d] for i in range(REFINE + 1)]
    side = fine_side(eps, d)
    finest = side / (2 ** levels[-1])
    pts = checkpointed(dense.select(
        "id", *[f"x{i}" for i in range(d)], *keys,
        *[F.floor(F.col(f"x{i}") / F.lit(finest)).cast("long").alias(f"u{i}") for i in range(d)]))

    def at(level: int, name: str):
        return [F.shiftright(f"u{i}", levels[-1] - level).alias(f"{name}{i}") for i in range(d)]

    def judged(pairs: DataFrame, level: int) -> DataFrame:
        sure, maybe = _bounds(d, side / (2 ** level), eps)
        return checkpointed(pairs.select(*ak, *bk, *au, *bu, sure.alias("sure"), maybe.alias("maybe"))
                            .where("maybe"))

    # each unordered cell pair once: offsets that are lexicographically positive
    pos = [o for o in fine_cell_offsets(d, eps) if o > tuple([0] * d)]
    if not pos:
        return dense.sparkSession.createDataFrame([], ", ".join(f"{c} long" for c in ak + bk))
    offsets = F.array(*[F.array(*[F.lit(v) for v in o]) for o in pos])
    subs = pts.select(*keys, *at(levels[0], "u")).distinct()
    a = subs.select(*[F.col(k).alias(n) for k, n in zip(keys, ak)],
                    *[F.col(f"u{i}").alias(n) for i, n in enumerate(au)], F.explode(offsets).alias("_o"))
    a = a.select("*", *[(F.col(f"a{i}") + F.col("_o")[i]).alias(f"b{i}") for i in range(d)]).drop("_o")
    b = subs.select(*[F.col(k).alias(n) for k, n in zip(keys, bk)],
                    *[F.col(f"u{i}").alias(n) for i, n in enumerate(bu)])
    sp = judged(a.join(b, bk), levels[0])
    sure = sp.where("sure").select(*ak, *bk).distinct()
    maybe = sp.where("not sure").join(sure, ak + bk, "left_anti")
    last = levels[0]
    for before, level in zip(levels, levels[1:]):
        if maybe.limit(1).count() == 0:
            break
        fine = pts.select(*keys, *at(before, "p"), *at(level, "c")).distinct()
        fa = fine.select(*[F.col(k).alias(n) for k, n in zip(keys, ak)],
                         *[F.col(f"p{i}").alias(n) for i, n in enumerate(au)],
                         *[F.col(f"c{i}").alias(f"ac{i}") for i in range(d)])
        fb = fine.select(*[F.col(k).alias(n) for k, n in zip(keys, bk)],
                         *[F.col(f"p{i}").alias(n) for i, n in enumerate(bu)],
                         *[F.col(f"c{i}").alias(f"bc{i}") for i in range(d)])
        cut = maybe.select(*ak, *bk, *au, *bu).join(fa, ak + au).join(fb, bk + bu).select(
            *ak, *bk, *[F.col(f"ac{i}").alias(n) for i, n in enumerate(au)],
            *[F.col(f"bc{i}").alias(n) for i, n in enumerate(bu)])
        sp = judged(cut, level)
        found = sp.where("sure").select(*ak, *bk).distinct()
        sure = checkpointed(sure.unionByName(found))
        maybe = sp.where("not sure").join(found, ak + bk, "left_anti")
        last = level
    pa = pts.select(*[F.col(k).alias(n) for k, n in zip(keys, ak)],
                    *[c.alias(n) for c, n in zip(at(last, "u"), au)], *[f"x{i}" for i in range(d)])
    pb = pts.select(*[F.col(k).alias(n) for k, n in zip(keys, bk)],
                    *[c.alias(n) for c, n in zip(at(last, "u"), bu)],
                    *[F.col(f"x{i}").alias(f"y{i}") for i in range(d)])
    checked = (maybe.join(pa, ak + au).join(pb, bk + bu)
               .where(_sq_dist(d) <= F.lit(eps * eps)).select(*ak, *bk).distinct())
    return sure.unionByName(checked).distinct()


def _label_components(core: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) for core points: rank of the component's smallest key - 1."""
    comps = connected_components(core, edges, "id", "src", "dst")
    roots = comps.select("comp").distinct()
    ranked = global_prefix(roots, [("comp", True)], None, rank_col="_rk")
    return checkpointed(comps.join(ranked, "comp").select("id", (F.col("_rk") - 1).alias("label")))


def dbscan_labels(points: DataFrame, id_col: str, coords: list[str], eps: float = DEFAULT_EPS,
                  min_samples: int = DEFAULT_MIN_SAMPLES, count_all: bool = True) -> DataFrame:
    """(id, label, is_core, neighbours); label -1 is noise.

    Exact duplicates are collapsed first (one representative per distinct
    coordinate, the smallest id, with its multiplicity as weight): copies
    share neighbours, core status and label, so a group of copies holding a
    third of the rows becomes one weighted point. ``neighbours`` is the number
    of points within eps, the point included, where it was counted, and null
    elsewhere: in a dense cell (count >= min_samples, all cores), where no pairs
    are enumerated, and for a point without a place. Above three coordinates
    every count is exact unless ``count_all`` is off: then dense balls spare
    their points' pairs, cores are counted only as far as it takes to know them,
    and counts of cores and in and beside such a ball are null. A point
    with a null or NaN coordinate has no place: it is noise.
    """
    lost = F.lit(False)
    for c in coords:
        lost = lost | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    placeless = points.where(lost).select(
        id_col, F.lit(-1).cast("long").alias("label"), F.lit(False).alias("is_core"),
        F.lit(None).cast("long").alias("neighbours"))
    placed = points.where(~lost)
    if len(coords) > FINE_GRID_MAX_DIMS:
        found = _dbscan_labels_pivots(placed, id_col, coords, eps, min_samples, count_all)
    else:
        found = _dbscan_labels_fine(placed, id_col, coords, eps, min_samples)
    return found.unionByName(placeless)


def _dbscan_labels_fine(points: DataFrame, id_col: str, coords: list[str], eps: float,
                        min_samples: int) -> DataFrame:
    d = len(coords)
    keys = [f"g{i}" for i in range(d)]
    xs = [f"x{i}" for i in range(d)]
    src = points.select(F.col(id_col).alias("_pid"),
                        *[F.col(c).cast("double").alias(x) for c, x in zip(coords, xs)])
    uniq = src.groupBy(*xs).agg(F.min("_pid").alias("id"), F.count(F.lit(1)).alias("mult"))
    cells = _grid_points(uniq, "id", xs, eps, "mult").withColumn(
        "dense", F.col("cell_n") >= min_samples)
    # pairs only from points of sparse cells (fewer than min_samples each)
    cross = checkpointed(cross_pairs(cells.where(~F.col("dense")), cells, d, eps))
    ccount = cross.groupBy("id").agg(F.sum("nw").alias("_cx"))
    pts = checkpointed(cells.join(ccount, "id", "left").select(
        "id", *xs, *keys, "dense",
        (F.col("cell_n") + F.coalesce(F.col("_cx"), F.lit(0))).alias("neighbours"))
        .withColumn("is_core", F.col("dense") | (F.col("neighbours") >= min_samples)))
    core = pts.where("is_core").select("id", *keys)
    rep = core.groupBy(*keys).agg(F.min("id").alias("rep"))
    # the cores of a cell are one connected group, so the component graph
    # needs only the cells: vertex = the cell's smallest core, edge = a pair
    # of cells with at least one core-core pair within eps
    core_rep = checkpointed(core.join(rep, keys).select("id", "rep"))
    sparse_edges = (cross.join(core_rep, "id")
                    .join(core_rep.select(F.col("id").alias("nid"), F.col("rep").alias("nrep")), "nid")
                    .where(F.col("rep") != F.col("nrep"))
                    .select(F.least("rep", "nrep").alias("src"), F.greatest("rep", "nrep").alias("dst")))
    links = dense_cell_links(pts.where("dense"), d, eps)
    rep_a = rep.select(*[F.col(f"g{i}").alias(f"a{i}") for i in range(d)], F.col("rep").alias("ra"))
    rep_b = rep.select(*[F.col(f"g{i}").alias(f"b{i}") for i in range(d)], F.col("rep").alias("rb"))
    dense_edges = (links.join(rep_a, [f"a{i}" for i in range(d)])
                   .join(rep_b, [f"b{i}" for i in range(d)])
                   .select(F.least("ra", "rb").alias("src"), F.greatest("ra", "rb").alias("dst")))
    cell_edges = sparse_edges.unionByName(dense_edges).distinct()
    rep_lab = _label_components(rep.select(F.col("rep").alias("id")), cell_edges)
    core_lab = checkpointed(core_rep.join(rep_lab.select(F.col("id").alias("rep"), "label"), "rep")
                            .select("id", "label"))
    # border points lie in sparse cells: candidates are the cores of the own
    # cell (one label per cell) and cross-cell core neighbours
    cell_lab = rep.join(core_lab.select(F.col("id").alias("rep"), "label"), "rep").select(*keys, "label")
    own = pts.where(~F.col("is_core")).join(cell_lab, keys).select("id", "label")
    nbr = cross.join(core_lab.select(F.col("id").alias("nid"), "label"), "nid").select("id", "label")
    border = own.unionByName(nbr).groupBy("id").agg(F.min("label").alias("blabel"))
    per_point = pts.join(core_lab, "id", "left").join(border, "id", "left").select(
        *xs, F.coalesce("label", "blabel", F.lit(-1)).cast("long").alias("label"),
        F.col("label").isNotNull().alias("is_core"),
        F.when(~F.col("dense"), F.col("neighbours")).cast("long").alias("neighbours"))
    # every copy takes its representative's result (equi-join on coordinates;
    # a heavy coordinate is one row on the build side)
    out = src.join(per_point, xs)
    return out.select(F.col("_pid").alias(id_col), "label", "is_core", "neighbours")


def _dbscan_labels_pivots(points: DataFrame, id_col: str, coords: list[str], eps: float,
                          min_samples: int, count_all: bool) -> DataFrame:
    """More than three coordinates: cells around pivots, dense balls, blocks
    (``pivots``). Exact duplicates are one weighted point, as in the fine grid."""
    src = points.select(F.col(id_col).alias("_pid"),
                        F.array(*[F.col(c).cast("double") for c in coords]).alias("x"))
    uniq = checkpointed(src.groupBy("x").agg(F.min("_pid").alias("id"),
                                             F.count(F.lit(1)).alias("w")))
    n = uniq.count()
    if n == 0:
        return points.select(id_col, F.lit(-1).cast("long").alias("label"),
                             F.lit(False).alias("is_core"), F.lit(None).cast("long").alias("neighbours"))
    plan = PV.layout(uniq, n, eps, min_samples, not count_all)
    placed = checkpointed(PV.place(uniq, plan))
    weights = placed.where("ball >= 0").groupBy("ball").agg(F.sum("w").alias("bw"),
                                                            F.count(F.lit(1)).alias("points"),
                                                            F.min("id").alias("rep"))
    dense = checkpointed(weights.where((F.col("bw") >= min_samples) & (F.col("points") >= PV.BLOCK)))
    balls = sorted(r.ball for r in dense.collect())  # at most PV.BALLS
    inside = F.col("ball").isin(balls) if balls else F.lit(False)
    loose, members = placed.where(~inside), placed.where(inside)
    counts = PV.count_neighbours(loose, eps, None if count_all else min_samples)
    whole = F.lit(True) if count_all else F.col("n") < min_samples
    hits = None
    if balls:
        hits = checkpointed(PV.near_balls(loose, members, plan, min_samples).where("n > 0"))
        more = hits.groupBy("id").agg(F.sum("n").alias("m"))
        counts = counts.join(more, "id", "left").select(
            "id", (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), (F.col("m").isNull() & whole).alias("exact"))
    else:
        counts = counts.select("id", "n", whole.alias("exact"))
    judged = checkpointed(loose.join(counts, "id").withColumn("is_core", F.col("n") >= min_samples))
    links = checkpointed(PV.loose_links(judged, eps))
    status = judged.select("id", "is_core")
    cores = status.where("is_core").select("id")
    edges = links.join(cores, "id", "left_semi").select(F.col("id").alias("src"),
                                                        F.col("core").alias("dst"))
    border = links.join(cores, "id", "left_anti")
    if balls:
        reps = dense.select("ball", "rep")
        touched = hits.join(reps, "ball").select("id", F.col("rep").alias("core"))
        edges = (edges.unionByName(touched.join(cores, "id", "left_semi").select(
                     F.col("id").alias("src"), F.col("core").alias("dst")))
                 .unionByName(PV.ball_links(members, plan, balls)
                              .join(reps.toDF("a", "src"), "a").join(reps.toDF("b", "dst"), "b")
                              .select("src", "dst")))
        border = border.unionByName(touched.join(cores, "id", "left_anti"))
        cores = cores.unionByName(reps.select(F.col("rep").alias("id")))
    labels = _label_components(cores, checkpointed(edges))
    near = (border.join(labels.select(F.col("id").alias("core"), "label"), "core")
            .groupBy("id").agg(F.min("label").alias("near")))
    out = (judged.select("x", "id", "is_core", F.when(F.col("exact"), F.col("n")).alias("neighbours"))
           .join(labels, "id", "left").join(near, "id", "left")
           .select("x", F.coalesce("label", "near", F.lit(-1)).cast("long").alias("label"), "is_core",
                   F.col("neighbours").cast("long").alias("neighbours")))
    if balls:
        of_ball = reps.join(labels.withColumnRenamed("id", "rep"), "rep").select("ball", "label")
        out = out.unionByName(members.join(of_ball, "ball").select(
            "x", F.col("label").cast("long").alias("label"), F.lit(True).alias("is_core"),
            F.lit(None).cast("long").alias("neighbours")))
    return src.join(out, "x").select(F.col("_pid").alias(id_col), "label", "is_core", "neighbours")


@dataclass
class DbscanResult:
    members: DataFrame   # ids + rates + label + pc1/pc2
    metrics: DataFrame   # one row


def dbscan_metrics(labelled: DataFrame, eps: float, min_samples: int, dims: int | None,
                   retained_pct: float | None, label: str = "cluster") -> DataFrame:
    """Cluster count (noise excluded), outliers, noise % (0 when empty),
    eps, min_samples, dims, retained variance %."""
    n = F.count(F.lit(1))
    noise = F.sum(F.when(F.col(label) == -1, 1).otherwise(0))
    return labelled.agg(
        F.countDistinct(F.when(F.col(label) != -1, F.col(label))).cast("bigint").alias("n_clusters"),
        F.coalesce(noise, F.lit(0)).cast("bigint").alias("n_outliers"),
        F.when(n > 0, F.round(noise * 100.0 / n, 2)).otherwise(F.lit(0.0)).alias("noise_pct"),
        F.lit(float(eps)).alias("eps"), F.lit(int(min_samples)).alias("min_samples"),
        F.lit(dims).cast("int").alias("dims"),
        F.lit(None if retained_pct is None else round(retained_pct, 2)).cast("double").alias("retained_pct"))


def run_dbscan(mart: DataFrame, eps: float = DEFAULT_EPS, min_samples: int | None = DEFAULT_MIN_SAMPLES,
               legacy_auto: bool = True) -> DbscanResult:
    """F1-F5, then D1-D4 on the PCA scores: ids + rates + label + PC1/PC2,
    and the one-row metrics. ``legacy_auto`` keeps the reference's rule
    that min_samples = 5 means max(4, 2·dims)."""
    from terrastat.operators import features as FE
    from terrastat.operators.kmeans import prepare
    prep = prepare(mart)
    k = prep.pca.n_components
    ms = effective_min_samples(min_samples, k, legacy_auto)
    labels = dbscan_labels(prep.scores, "muni_key", FE.pc_columns(k), eps, ms, count_all=False)
    pcs = [F.col("pc1")] + ([F.col("pc2")] if k > 1 else [F.lit(None).cast("double").alias("pc2")])
    members = (prep.rates.join(labels.select("muni_key", F.col("label").alias("cluster")), "muni_key")
               .join(prep.scores.select("muni_key", *pcs), "muni_key"))
    members = checkpointed(members)
    return DbscanResult(members, dbscan_metrics(members, eps, ms, k, prep.pca.retained_pct))
