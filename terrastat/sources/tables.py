"""Base-table access for the driver's parquet layout (one file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``spark.read.parquet`` of ``<sf_dir>/<name>.parquet``.

    Column pruning and filter pushdown reach the scan through Catalyst, so
    callers select only what they use.
    """
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
