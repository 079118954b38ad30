from pyspark.sql import functions as F

from tidemark.streaming import windows


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 600)).alias("ts"), (F.col("id") % 5).alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = windows.tumbling(windows.read_events(spark, f"{tmp_path}/in", 1), late="30 days")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.n) for r in spark.table("tumbled").collect()}
    assert got == {(r.start, r.n) for r in windows.tumbling(rows).collect()}
    once = windows.run_once(windows.first_seen(windows.read_events(spark, f"{tmp_path}/in", 1), late="30 days"), f"{tmp_path}/out", f"{tmp_path}/ckpt")
    once.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 500
