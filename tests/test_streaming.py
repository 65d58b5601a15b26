"""The stream counts what a batch counts."""

from pyspark.sql import functions as F

from marquee.streaming import views

SF = "/root/testdata/sf0.001/events.parquet"


def test_windowed_counts(spark, tmp_path):
    batch = spark.read.parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = views.windowed(stream, size="1 day", late="60 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.sql("select * from w").collect()}
    want = {(r.start, r.event_type): r.n for r in views.windowed(batch, size="1 day").collect()}
    assert got == want and got


def test_dedup(spark):
    rows = spark.createDataFrame([(1, 1, "2024-01-01 10:01:00"), (1, 1, "2024-01-01 10:59:00"), (1, 1, "2024-01-01 11:00:00")], "user_id long, event_id long, t string").withColumn("ts", F.to_timestamp("t"))
    assert rows.withColumn("hour", F.date_trunc("hour", "ts")).dropDuplicates(["user_id", "event_id", "hour"]).count() == 2
