from pyspark.sql import functions as F

from spoolwise.streaming import live

SCHEMA = "recording_id long, ts timestamp, text string"


def test_live_blocks_match_a_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:00:{s:02d}", "two words") for s in (1, 5, 29, 31, 59)] + [(2, "2024-01-01 00:10:00", "one")]
    df = spark.createDataFrame(rows, "recording_id long, ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    q = live.live_blocks(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("blocks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.recording_id, r.cues, r.words) for r in spark.table("blocks").collect())
    assert got == [(1, 2, 4), (1, 3, 6), (2, 1, 1)]
