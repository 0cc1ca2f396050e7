"""Exact top-k inner products by distributed histogram selection.

Vectors become integers ``floor(256 * x)``. Queries go in blocks of
``BLOCK`` rows (a bounded broadcast each) against all rows. Every task scores a
batch with one matrix product and counts, per query, its scores in ``BINS``
equal bins of the query's current score range; the counts are summed over tasks
and the bin that holds the k-th largest score becomes the next range, until the
range is one value. A task sends only the bins from its own k-th score up: a
lower bin can't hold the global one. With every k-th value known, a last pass
keeps the scores above it and, of those equal to it, the ``k`` smallest ids a
task, so ties of any number stay bounded; a window over at most ``k`` rows a
task and query then ranks by score and id.

Defined cases: vectors that are null or hold a null or non-finite component take
no part, nor do null ids; a query meets the vectors of its own length only. Rows
are told apart by a number, not by their id: every row but the query's own is a
candidate, so rows that repeat an id meet each other, and each of them that is a
query has an answer of its own under that id. Empty input gives no rows; scores
beyond 62 bits raise an OverflowError; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrastat.llm.common import staged

BLOCK = 512
BINS = 2048
BATCH = 4096


def quantised(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding",
              scale: float = 256.0) -> DataFrame:
    """row (a number), vec_id and integer components of the rows that take part."""
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (rows.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
            .select(F.col(id_col).cast("bigint").alias("vec_id"),
                    F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
                    .alias("v")).withColumn("row", F.monotonically_increasing_id()))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles while sums stay under 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2 ** 53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    if most < 2 ** 63:
        return q @ c.T
    raise OverflowError("scores exceed 64 bits")


def _batches(batches, width: int):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield (np.asarray(part.column("row"), np.int64), np.asarray(part.column("vec_id"), np.int64),
                   _matrix(part.column("v"), width))


def _kth(rows: DataFrame, ids: np.ndarray, vecs: np.ndarray, reach: np.ndarray, k: int):
    """The k-th largest score of every query, or its least one where it has
    fewer candidates; ``reach`` bounds the scores' size."""
    spark = rows.sparkSession
    lo, hi = -reach, reach.copy()
    rank = np.full(len(ids), k, np.int64)  # still to find within [lo, hi]
    live = hi > lo
    while live.any():
        step = np.maximum(1, -((lo - hi - 1) // BINS))
        shared = spark.sparkContext.broadcast((ids, vecs, lo, hi, step, live))

        def count(batches):
            ids, vecs, lo, hi, step, live = shared.value
            at = np.flatnonzero(live)
            tally = np.zeros((len(at), BINS), np.int64)
            for cand, _, mat in _batches(batches, vecs.shape[1]):
                s = _scores(vecs[at], mat)
                ok = (s >= lo[at, None]) & (s <= hi[at, None]) & (cand[None, :] != ids[at, None])
                bins = (s - lo[at, None]) // step[at, None]
                flat = (bins + np.arange(len(at))[:, None] * BINS)[ok]
                tally += np.bincount(flat, minlength=tally.size).reshape(tally.shape)
            # from the task's own k-th score up
            above = tally[:, ::-1].cumsum(axis=1)[:, ::-1] - tally
            q, b = np.nonzero((tally > 0) & (above < k))
            yield pa.RecordBatch.from_arrays([pa.array(at[q]), pa.array(b), pa.array(tally[q, b])],
                                             names=["q", "bin", "n"])

        down = Window.partitionBy("q").orderBy(F.col("bin").desc())
        found = (rows.mapInArrow(count, "q bigint, bin bigint, n bigint")
                 .groupBy("q", "bin").agg(F.sum("n").alias("n"))
                 .withColumn("upto", F.sum("n").over(down))
                 .where(F.col("upto") - F.col("n") < k).collect())  # at most k a query
        crossing = {r.q: r for r in found if r.upto - r.n < rank[r.q] <= r.upto}
        for q in np.flatnonzero(live):
            hit = crossing.get(int(q))
            if hit is None:  # fewer than k candidates in all: everything qualifies
                hi[q] = lo[q]
            else:
                first = lo[q] + hit.bin * step[q]
                rank[q] -= hit.upto - hit.n
                lo[q], hi[q] = first, min(hi[q], first + step[q] - 1)
        live = hi > lo
    return lo


def top_k(rows: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id",
          vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of every query row's ``k`` best others."""
    spark = rows.sparkSession
    vectors = staged(quantised(rows, id_col=id_col, vec_col=vec_col), "topk-vectors")
    size = F.size("v")
    most = vectors.groupBy(size.alias("d")).agg(
        F.max(F.aggregate("v", F.lit(0).cast("bigint"),
                          lambda m, x: F.greatest(m, F.abs(x)))).alias("m")).collect()
    asked = staged(vectors.withColumnRenamed("vec_id", id_col).where(is_query)
                   .select(F.col("row").alias("q_row"), F.col(id_col).alias("qid"), "v"),
                   "topk-queries")
    counts = {r["d"]: r["n"] for r in
              asked.groupBy(size.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    answers = []
    for d, m in sorted((r["d"], r["m"]) for r in most if r["d"] in counts):
        same = vectors.where(size == d)
        n_blocks = max(1, -(-counts[d] // block))
        for b in range(n_blocks):
            held = sorted(asked.where((size == d) & (F.pmod(
                F.xxhash64("q_row"), F.lit(n_blocks)) == b)).collect())  # about ``block`` rows
            if held:
                answers.append(_answer(same, held, int(m), k))
    if not answers:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id")
    return (out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _answer(vectors: DataFrame, held: list, most: int, k: int) -> DataFrame:
    """Scores that can be among the ``k`` best of a block of queries."""
    ids = np.array([r.q_row for r in held], np.int64)
    names = np.array([r.qid for r in held], np.int64)
    vecs = np.array([r.v for r in held], np.int64).reshape(len(held), -1)
    widest = max(sum(map(abs, r.v)) for r in held) * most + 1
    if widest >= 2 ** 62:
        raise OverflowError("scores exceed 64 bits")
    reach = np.abs(vecs).sum(axis=1) * most + 1
    floor = _kth(vectors, ids, vecs, reach, k)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, names, vecs, floor))

    def keep(batches):
        ids, names, vecs, floor = shared.value
        over: list[tuple] = []
        ties: dict[int, np.ndarray] = {}
        for cand, of, mat in _batches(batches, vecs.shape[1]):
            s = _scores(vecs, mat)
            ok = cand[None, :] != ids[:, None]
            q, c = np.nonzero((s > floor[:, None]) & ok)
            over += zip(ids[q].tolist(), names[q].tolist(), of[c].tolist(), s[q, c].tolist())
            even = (s == floor[:, None]) & ok
            for i in np.flatnonzero(even.any(axis=1)):
                ties[i] = np.sort(np.concatenate([ties.get(i, of[:0]), of[even[i]]]))[:k]
        over += [(int(ids[i]), int(names[i]), int(x), int(floor[i]))
                 for i, xs in ties.items() for x in xs]
        cols = list(zip(*over)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols],
                                         names=["q_row", "query_id", "vec_id", "score"])

    return vectors.mapInArrow(keep, "q_row bigint, query_id bigint, vec_id bigint, score bigint")
