"""Topics read from offsets, and a stream whose process dies between a write and its commit."""

import os
import signal
import subprocess
import sys
import time
from pathlib import Path

from pyspark.sql import functions as F

from clicklake.sources import topic_log
from clicklake.storage import shared_folder
from clicklake.streaming import sinks


def records(spark, first, n):
    return spark.range(first, first + n).selectExpr("cast(id % 7 as string) as key", "timestamp_seconds(id) as timestamp", "cast(id as string) as value")


def drain(spark, topic, folder, checkpoint, most=0, starting="earliest"):
    """One run to the end of what the source offers; rows it read."""
    s = topic_log.topic_stream(spark, topic, checkpoint, most, starting)
    q = s.writeStream.foreachBatch(sinks.batch_folder(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return sum(p["numInputRows"] for p in q.recentProgress)


def test_offsets_are_gapless_over_segments_and_runs(spark):
    topic, folder, checkpoint = (shared_folder(spark, n) for n in ("topic", "read", "check"))
    assert topic_log.append(records(spark, 0, 50), topic, 4) == 0
    read = [drain(spark, topic, folder, checkpoint, 9)]
    assert topic_log.append(records(spark, 50, 30), topic, 6) == 1  # two partitions more
    while read[-1]:
        read.append(drain(spark, topic, folder, checkpoint, 9))
    assert sum(read) == 80 and max(read) <= 9 * 6 and read[0] <= 9 * 4 < 50
    rows = spark.read.parquet(folder)
    assert sorted(int(r["value"]) for r in rows.collect()) == list(range(80))
    for r in rows.groupBy("partition").agg(F.min("offset").alias("a"), F.max("offset").alias("b"), F.count_distinct("offset").alias("n"), F.count("*").alias("m")).collect():
        assert (r["a"], r["b"], r["m"]) == (0, r["n"] - 1, r["n"])
    assert all(r["n"] == 1 for r in rows.filter("value < 50").groupBy("key").agg(F.count_distinct("partition").alias("n")).collect())


def test_newest_offsets_and_unfinished_segments(spark):
    topic, folder, checkpoint = (shared_folder(spark, n) for n in ("topic", "read", "check"))
    topic_log.append(records(spark, 0, 20), topic, 2)
    records(spark, 100, 5).selectExpr("0 as offset", "*", "0 as partition").write.partitionBy("partition").parquet(f"{topic}/segments/00000001")  # no index: a write that failed
    ends = topic_log.TopicReader({"path": topic}).latestOffset()
    assert sum(ends.values()) == 20 and topic_log.TopicReader({"path": topic, "starting_offsets": "latest"}).initialOffset() == ends
    assert set(topic_log.TopicReader({"path": topic}).initialOffset().values()) == {0}
    topic_log.append(records(spark, 20, 10), topic, 2)  # takes its place
    assert drain(spark, topic, folder, checkpoint) == 30
    assert sorted(int(r["value"]) for r in spark.read.parquet(folder).collect()) == list(range(30))


CHILD = """
import sys, time
from pyspark.sql import SparkSession
from clicklake.sources import topic_log
from clicklake.streaming import sinks

topic, folder, checkpoint = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
write = sinks.batch_folder(folder)

def sink(batch, batch_id):
    write(batch, batch_id)
    if batch_id == 1:
        print("written", flush=True)
        time.sleep(600)

for _ in range(3):
    s = topic_log.topic_stream(spark, topic, checkpoint, 8)
    s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
"""


def test_a_killed_process_loses_and_repeats_nothing(spark):
    topic, folder, checkpoint = (shared_folder(spark, n) for n in ("topic", "read", "check"))
    topic_log.append(records(spark, 0, 60), topic, 2)
    root = str(Path(__file__).resolve().parents[1])
    child = subprocess.Popen([sys.executable, "-c", CHILD, topic, folder, checkpoint], stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env=os.environ | {"PYTHONPATH": root}, start_new_session=True)
    try:
        began = time.time()
        while "written" not in (line := child.stdout.readline()):
            assert line and time.time() - began < 120
    finally:
        os.killpg(child.pid, signal.SIGKILL)  # the child and its JVM: the second batch is written, its commit is not
        child.wait()
    assert (Path(checkpoint) / "offsets" / "1").exists() and not (Path(checkpoint) / "commits" / "1").exists()
    before = sorted(int(r["value"]) for r in spark.read.parquet(folder).collect())
    assert 0 < len(before) < 60
    while drain(spark, topic, folder, checkpoint, 8):
        pass
    rows = spark.read.parquet(folder)
    assert sorted(int(r["value"]) for r in rows.collect()) == list(range(60))
    assert rows.select("batch").distinct().count() >= 3
