"""A streaming job that is started again goes on with the new rows."""

from urlrisk.plans.lineage import scratch_path
from urlrisk.streaming import jobs


def test_restart_reads_new_rows(spark):
    given, table = scratch_path(spark, "given"), scratch_path(spark, "table")
    for first in (0, 5):
        spark.range(first, first + 5).write.mode("append").parquet(given)
        stream = spark.readStream.schema("id bigint").parquet(given)
        jobs.append_stream(stream, table).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(table).collect()) == list(range(first + 5))
