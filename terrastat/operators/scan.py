"""Global prefix sum and rank without a single-partition window (§4.3).

A window with ``orderBy`` and no ``partitionBy`` moves every row into one task.
Instead the total order is cut into B contiguous ranges with literal bounds
taken from a seeded sample of the *full* order key (leading column plus the
tie-break), so a value shared by a third of the rows is still split across
ranges by the tie-break. Each range gets its offset (sum and count of all
earlier ranges, a B-row frame broadcast back), and a ROWS window partitioned
by range finishes the job. The bucket is a deterministic expression over
literals, so a recomputed task after executor loss lands rows in the same
range. The same path runs at every size: at least ``MIN_RANGES`` ranges, and at
most ``MAX_RANGES``, which bounds the sample and the offsets on the driver.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastat.operators.common import checkpointed

# Rows aimed at for one range.
DEFAULT_ROWS_PER_RANGE = 1_000_000
MIN_RANGES, MAX_RANGES = 8, 4096
SAMPLE_PER_RANGE = 64


def _sort_col(name: str, asc: bool) -> Column:
    return F.col(name).asc() if asc else F.col(name).desc()


def _at_or_after(order: list[tuple[str, bool]], bound: tuple) -> Column:
    """Row key >= bound in the lexicographic order (non-null keys)."""
    expr = None
    # build from the last key backwards: (k1 beyond b1) or (k1 == b1 and rest)
    for (name, asc), b in reversed(list(zip(order, bound))):
        c = F.col(name)
        lit = F.lit(b)
        beyond = (c > lit) if asc else (c < lit)
        if expr is None:
            expr = beyond | (c == lit)
        else:
            expr = beyond | ((c == lit) & expr)
    return expr


def _bucket_expr(order, bounds: list[tuple]) -> Column:
    """Binary-search CASE tree: number of bounds at or before the row key."""
    def build(lo: int, hi: int) -> Column:
        if lo >= hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_at_or_after(order, bounds[mid]), build(mid + 1, hi)).otherwise(build(lo, mid))
    return build(0, len(bounds))


def _sample_bounds(df: DataFrame, order, n: int, ranges: int, seed: int) -> list[tuple]:
    names = [c for c, _ in order]
    frac = min(1.0, ranges * SAMPLE_PER_RANGE / max(n, 1))
    # bounded: about SAMPLE_PER_RANGE * ranges rows reach the driver
    rows = [tuple(r) for r in df.select(*names).sample(False, frac, seed).collect()]

    def cmp(a, b):
        for (name, asc), x, y in zip(order, a, b):
            if x != y:
                return (-1 if x < y else 1) * (1 if asc else -1)
        return 0
    rows.sort(key=functools.cmp_to_key(cmp))
    if len(rows) < 2:
        return []
    out = []
    for i in range(1, ranges):
        r = rows[min(len(rows) - 1, i * len(rows) // ranges)]
        if not out or cmp(out[-1], r) < 0:
            out.append(r)
    return out


def global_prefix(df: DataFrame, order: list[tuple[str, bool]], value: str | None = None,
                  *, cum_col: str = "cum", rank_col: str = "rank",
                  rows_per_range: int = DEFAULT_ROWS_PER_RANGE, seed: int = 42,
                  materialize: bool = True) -> DataFrame:
    """Add a 1-based global ``rank`` and (if ``value``) the running sum
    ``cum`` of ``value`` in the total order ``order`` = [(col, ascending)].

    ``order`` must be a total order (end it with a unique key); ROWS frames
    are used so ties never share a running total. Null order keys are not
    supported (drop them first).
    """
    src = checkpointed(df) if materialize else df
    n = src.count()
    ranges = min(MAX_RANGES, max(MIN_RANGES, math.ceil(n / max(1, rows_per_range))))
    keyed = src.withColumn("_rng", _bucket_expr(order, _sample_bounds(src, order, n, ranges, seed)))
    w = Window.partitionBy("_rng").orderBy(*[_sort_col(c, a) for c, a in order])
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = [F.col(c) for c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rn")]
    if value is not None:
        aggs.append(F.sum(F.col(value)).alias("_rs"))
    per = keyed.groupBy("_rng").agg(*aggs)
    before = Window.orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    off_cols = [F.col("_rng"), F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_no")]
    if value is not None:
        off_cols.append(F.coalesce(F.sum("_rs").over(before), F.lit(0)).alias("_so"))
    # at most `ranges` rows: a bounded broadcast
    offsets = per.select(*off_cols)

    j = keyed.join(F.broadcast(offsets), "_rng")
    out.append((F.row_number().over(w) + F.col("_no")).cast("bigint").alias(rank_col))
    if value is not None:
        out.append((F.sum(F.col(value)).over(running) + F.col("_so")).alias(cum_col))
    return j.select(*out)


def rank_quantiles(df: DataFrame, value: str, qs: list[float], key: str,
                   rows_per_range: int = DEFAULT_ROWS_PER_RANGE) -> Column:
    """Exact quantiles of one column, see ``column_quantiles``; a scalar
    subquery Column holding ``array<double>`` (null when no row)."""
    return column_quantiles(df, [value], qs, key, rows_per_range)[value]


def column_quantiles(df: DataFrame, columns: list[str], qs: list[float], key: str,
                     rows_per_range: int = DEFAULT_ROWS_PER_RANGE) -> dict[str, Column]:
    """Exact linear-interpolation quantiles (pandas / ``percentile``
    semantics) of several columns by ranks.

    The columns' non-null values are stacked and ranked in (column, value,
    key) order by one ``global_prefix``; quantile q of a column of n values
    sits at h = (n - 1)·q and interpolates between its ranks floor(h) + 1 and
    ceil(h) + 1, so only 2·len(qs) rows a column are read back.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x"))
                      for i, c in enumerate(columns)])
    # the key only splits a value that many rows share; any number will do
    tie = F.col(key) if key in df.columns else F.monotonically_increasing_id()
    src = checkpointed(df.select(tie.alias("_k"), F.explode(cells).alias("_e"))
                       .select("_k", F.col("_e.c").alias("_c"), F.col("_e.x").alias("_x"))
                       .where(F.col("_x").isNotNull()))
    counts = {r["_c"]: r["n"] for r in src.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = global_prefix(src, [("_c", True), ("_x", True), ("_k", True)], None, rank_col="_rk",
                           rows_per_range=rows_per_range, materialize=False)
    picks, needed, before = {}, set(), 0
    for i, c in enumerate(columns):
        n = counts.get(i, 0)
        picks[c] = [] if n else None
        for q in qs if n else []:
            h = (n - 1) * float(q)
            lo, hi = before + math.floor(h) + 1, before + math.ceil(h) + 1
            needed.update((lo, hi))
            picks[c].append((lo, hi, h - math.floor(h)))
        before += n
    chosen = checkpointed(ranked.where(F.col("_rk").isin(*sorted(needed))).select("_rk", "_x"))
    out = {}
    for c, p in picks.items():
        vals = [F.max(F.when(F.col("_rk") == lo, F.col("_x"))) * (1.0 - frac)
                + F.max(F.when(F.col("_rk") == hi, F.col("_x"))) * frac for lo, hi, frac in p or []]
        out[c] = (chosen.select(F.array(*vals).alias("q")).scalar() if p
                  else F.lit(None).cast("array<double>"))
    return out
