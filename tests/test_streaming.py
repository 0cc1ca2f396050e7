
from terrastat.operators import pareto as P
from terrastat.session import scratch_path
from terrastat.sources import fixtures as fx
from terrastat.streaming.incremental import start_rollup, total_volume
from tests.conftest import SF001


def test_stream_rollup_matches_batch(spark):
    out = scratch_path(spark, "t-stream-out")
    q = start_rollup(spark, SF001, out)
    q.awaitTermination(300)
    got = {r.muni_key: r.total for r in spark.read.parquet(out).collect()}
    batch = P.muni_rollup_pareto(fx.incidence(spark, SF001))
    want = {r.muni_key: r.total for r in batch.collect()}
    assert got == want
    assert total_volume(spark.read.parquet(out)).first().total_cases == sum(want.values())


def test_stream_restart_does_not_double_count(spark):
    out = scratch_path(spark, "t-stream-out2")
    ckpt = scratch_path(spark, "t-stream-ckpt")
    start_rollup(spark, SF001, out, checkpoint_location=ckpt).awaitTermination(300)
    first = {r.muni_key: r.total for r in spark.read.parquet(out).collect()}
    # a restart on the same checkpoint finds no new files: state and output unchanged
    start_rollup(spark, SF001, out, checkpoint_location=ckpt).awaitTermination(300)
    again = {r.muni_key: r.total for r in spark.read.parquet(out).collect()}
    assert again == first and len(first) > 0
