"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastat.session import scratch_path


def scalars(df: DataFrame, **aggs: Column) -> Column:
    """Global aggregates of ``df`` as one struct-valued scalar subquery.

    ``x = scalars(df, mean=F.avg('v'))`` then ``x['mean']`` inside another
    DataFrame's expressions. Spark runs the subquery once (identical
    subqueries are reused) and inlines the value: no join, no cross product,
    no driver round trip of data.

    Attach the result once (``df.withColumn('_g', scalars(...))``) and read
    its fields from that column: every textual reference to the subquery
    would otherwise carry another copy of its plan.
    """
    return df.select(F.struct(*[c.alias(k) for k, c in aggs.items()]).alias("s")).scalar()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as Parquet under the shared checkpoint folder, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored`` that nothing reads any more."""
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet under the shared checkpoint folder (it
    survives executor loss) and cut its lineage; later reads prune columns and
    know the size. For frames that are read at least twice."""
    return stored(df, "table")[0]
