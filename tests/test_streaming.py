import os

import pytest
from pyspark.sql import functions as F

from faultscope.canonical import METRICS
from faultscope.streaming.windows import deviation_scores, windowed_profile


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="given tables not present")
def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.select(F.lit("c").alias("case_id"), F.col("event_type").alias("service"), F.col("ts").cast("timestamp").alias("time"),
                         *[(F.col("value") * (k + 1)).alias(m) for k, m in enumerate(METRICS)])
    rows.orderBy("time").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    batch = windowed_profile(spark.read.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = (windowed_profile(stream).writeStream.outputMode("complete").format("memory").queryName("windowed")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.table("windowed")
    keys = ["case_id", "service", "start", "points"]
    assert got.count() > 0
    assert got.select(*keys).exceptAll(batch.select(*keys)).isEmpty() and batch.select(*keys).exceptAll(got.select(*keys)).isEmpty()
    base = spark.createDataFrame([("click", 10.0, 2.0)], "service string, base_mean double, base_std double")
    assert deviation_scores(batch, base).filter("score < 0").isEmpty()
