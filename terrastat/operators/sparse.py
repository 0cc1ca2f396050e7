"""E14 and F3-F5 for thousands of features: sparse rows.

The dense mart is one conditional sum and one column a feature, which generated
code can't hold beyond some hundreds. Here a municipality is one row with
``cells``: (position, value) of its non-zero features in order, built by two
grouped aggregates whatever the number of features. Statistics are grouped by
position, and absent cells count as zeros. Rows become dense arrays only inside a
batch, for scaling.

Defined cases: a feature outside the given list is dropped, a municipality without
a listed feature keeps an empty row; null values are zeros; a population that is
null or not over 0 gives rates of 0; a feature without variance is scaled to 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = "array<struct<position:int,value:{}>>"


def sparse_matrix(long: DataFrame, ids: list[str], pivot_col: str, value: str,
                  values: list[str]) -> DataFrame:
    """Ids and ``cells``: the sums of ``value`` by ``pivot_col``, as its place in
    ``values``."""
    places = long.sparkSession.createDataFrame(
        [(v, i) for i, v in enumerate(values)], "_name string, position int")
    placed = long.join(F.broadcast(places), F.col(pivot_col) == F.col("_name"), "left")
    cells = placed.groupBy(*ids, "position").agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("value"))
    cell = F.when(F.col("position").isNotNull() & (F.col("value") != 0), F.struct("position", "value"))
    return cells.groupBy(*ids).agg(  # at most one cell a feature
        F.array_sort(F.collect_list(cell)).cast(CELLS.format("bigint")).alias("cells"))


def sparse_rates(mart: DataFrame, population: str = "population") -> DataFrame:
    """every cell as a rate per 100k inhabitants."""
    safe = F.col(population) > 0
    return mart.withColumn("cells", F.transform("cells", lambda c: F.struct(
        c["position"].alias("position"),
        F.when(safe, c["value"].cast("double") / F.col(population) * 100000.0).otherwise(F.lit(0.0))
        .alias("value"))))


@dataclass
class Stats:
    """Mean and population standard deviation of every feature, zeros included."""

    rows: int
    mean: np.ndarray
    std: np.ndarray


def sparse_stats(mart: DataFrame, d: int) -> Stats:
    """One grouped aggregate over the cells; at most ``d`` rows reach the driver.
    The non-zero cells' mean and variance and the share of zeros give the whole
    feature's without a difference of large sums."""
    n = mart.count()
    per = (mart.select(F.explode("cells").alias("c")).groupBy("c.position")
           .agg(F.count(F.lit(1)).alias("k"), F.avg("c.value").alias("m"),
                F.var_pop("c.value").alias("v")).collect())
    mean, std = np.zeros(d), np.zeros(d)
    for r in per:
        part = r.k / n
        mean[r.position] = part * r.m
        std[r.position] = np.sqrt(part * r.v + part * (1 - part) * r.m * r.m)
    return Stats(n, mean, std)


def scaled_rows(mart: DataFrame, ids: list[str], stats: Stats) -> DataFrame:
    """ids and ``x``, the dense scaled features, (value - mean) / std."""
    d = len(stats.mean)
    inverse = np.where(stats.std > 0, 1 / np.where(stats.std > 0, stats.std, 1), 0.0)
    shared = mart.sparkSession.sparkContext.broadcast((-stats.mean * inverse, inverse))
    step = max(1, (1 << 20) // max(1, d))

    def run(batches):
        empty, inverse = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cells = part.column("cells")
                x = np.tile(empty, (len(cells), 1))
                row = np.repeat(np.arange(len(cells)), np.asarray(pc.list_value_length(cells)))
                flat = cells.flatten()
                position = np.asarray(flat.field("position"))
                x[row, position] += np.asarray(flat.field("value"), np.float64) * inverse[position]
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * d)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ids),
                     pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=[*ids, "x"])

    schema = T.StructType([*mart.select(*ids).schema.fields,
                           T.StructField("x", T.ArrayType(T.DoubleType()))])
    return mart.select(*ids, "cells").mapInArrow(run, schema)


def sparse_profile(mart: DataFrame, label: str) -> DataFrame:
    """M10 in long form: (label, position, mean) of the features that a cluster has
    at all; the mean counts absent cells as zeros."""
    sizes = mart.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    sums = (mart.select(label, F.explode("cells").alias("c")).groupBy(label, "c.position")
            .agg(F.sum("c.value").alias("_s")))
    return sums.join(sizes, label).select(label, "position", (F.col("_s") / F.col("_n")).alias("mean"))
