"""The municipality roll-up (P1 totals) and the total-volume KPI (K1) kept
current while new lineitem files land in a folder.

Source: ``readStream.parquet`` with the batch schema and a file glob; the
year filter is the same pushed range as the batch view. Each micro-batch is
joined to the static ``part`` and ``muni`` dimensions (stream-static joins)
and aggregated; the state store keeps one running sum per municipality.
The sink writes the complete roll-up per batch through ``foreachBatch`` and
the query's progress lives under the shared checkpoint folder, so a restart
resumes without double counting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrastat.session import scratch_path
from terrastat.sources import fixtures as fx
from terrastat.sources.tables import read_table


def lineitem_stream(spark: SparkSession, source_dir: str, glob: str = "lineitem*.parquet",
                    max_files_per_trigger: int = 1) -> DataFrame:
    schema = read_table(spark, source_dir, "lineitem").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir))


def rollup_stream(spark: SparkSession, lineitems: DataFrame, dim_dir: str) -> DataFrame:
    """Streaming roll-up: (muni_key, muni, state, total)."""
    li = lineitems.select(
        F.col("l_suppkey").cast("bigint").alias("muni_key"), "l_partkey",
        F.col("l_quantity").cast("bigint").alias("cases"))
    part = read_table(spark, dim_dir, "part").select("p_partkey")
    m = fx.muni(spark, dim_dir).select("muni_key", "muni", "state")
    j = li.join(part, li.l_partkey == part.p_partkey).join(m, "muni_key", "left")
    return (j.dropna(subset=["muni_key", "muni", "state"]).groupBy("muni_key", "muni", "state")
            .agg(F.sum("cases").cast("bigint").alias("total")))


def start_rollup(spark: SparkSession, source_dir: str, out_path: str,
                 checkpoint_location: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Run the roll-up; every micro-batch rewrites ``out_path`` with the
    complete current table (exactly-once with the checkpointed offsets)."""
    ckpt = checkpoint_location or scratch_path(spark, "rollup-stream")
    agg = rollup_stream(spark, lineitem_stream(spark, source_dir), source_dir)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    w = agg.writeStream.outputMode("complete").option("checkpointLocation", ckpt).foreachBatch(sink)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def total_volume(rollup: DataFrame) -> DataFrame:
    """K1 over the materialised streaming roll-up."""
    return rollup.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total_cases"))


__all__ = ["lineitem_stream", "rollup_stream", "start_rollup", "total_volume"]
