"""Streams give what tables give."""

from pyspark.sql import functions as F

from foliant.operators.store import rate_limit
from foliant.sources.tables import table
from foliant.streaming import events

SF = "/root/testdata/sf0.001"


def stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    source.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), source


def run(spark, df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_windows(spark, tmp_path):
    live, source = stream(spark, tmp_path)
    got = run(spark, events.windowed(live), "complete", tmp_path, "w")
    assert sorted(got.collect()) == sorted(events.windowed(source).collect())


def test_rate_limited(spark, tmp_path):
    live, source = stream(spark, tmp_path)
    got = run(spark, events.rate_limited(live, "user_id", 3, 86400), "append", tmp_path, "r")
    want = rate_limit(source, "user_id", "ts", 3, 86400)
    assert sorted((r["event_id"], r["accepted"]) for r in got.collect()) == sorted((r["event_id"], r["accepted"]) for r in want.collect())
