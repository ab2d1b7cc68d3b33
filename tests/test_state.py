"""Keyed state over several micro-batches: late rows, timers, time to live."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clicklake.storage import shared_folder
from clicklake.streaming import features as stream
from clicklake.streaming import state

START = datetime(2024, 1, 10)


def arriving(spark, folder, rows):
    """A stream of one micro-batch more: rows of (user_id, seconds since START, event_type, price)."""
    made = [(u, START + timedelta(seconds=s), kind, price) for u, s, kind, price in rows]
    kind = "user_id long, row_time timestamp, event_type string, price double"
    spark.createDataFrame(made, kind).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(kind).parquet(folder)


def test_late_rows_have_what_came_before_them(spark):
    draw = random.Random(3)
    folder, sink, check = (shared_folder(spark, n) for n in ("files", "sink", "check"))
    batches, newest, want = [], 0, []
    for b in range(4):  # times of a batch spread over forty minutes, batches fifteen minutes apart
        batches.append([(draw.randrange(3), b * 900 + draw.randrange(2400), draw.choice(["view", "cart", "purchase"]), draw.choice([1.25, None, 3.5])) for _ in range(60)])
    come, admitted_from = [], -1
    for batch in batches:
        batch = [r for r in batch if r[1] > admitted_from]
        come += batch
        for u, s, _, _ in batch:
            seen = [r for r in come if r[0] == u and s - 900 <= r[1] < s]
            count = [sum(r[2] == k for r in seen) for k in ("view", "cart", "purchase")]
            want.append((u, s, *count, sum(round((r[3] or 0) * 100) for r in seen if r[2] == "purchase") / 100))
        newest = max([newest, *(r[1] for r in batch)])
        admitted_from = newest - 900
    with state.rocksdb_state(spark):
        for batch in batches:
            rows = stream.event_time_watermark(arriving(spark, folder, batch))
            stream.run_to_end(state.running_user_state(rows), sink, check)
    got = [((r["row_time"] - START).total_seconds(), *r) for r in spark.read.parquet(sink).collect()]
    assert sorted((u, int(s), *rest) for s, u, _, *rest in got) == sorted(want)
    assert sum(b[1] < a[1] for a, b in zip(come, come[1:])) > 50  # many rows are late


def test_a_users_state_goes_with_the_watermark(spark):
    folder, sink, check = (shared_folder(spark, n) for n in ("files", "sink", "check"))
    held = []
    with state.rocksdb_state(spark):
        for batch in ([(1, 0, "view", None), (2, 60, "view", None)], [(3, 7200, "view", None)], [(3, 7260, "cart", None)]):
            q = stream.run_to_end(state.running_user_state(stream.event_time_watermark(arriving(spark, folder, batch))), sink, check)
            held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = spark.read.format("statestore").option("stateVarName", "minutes").load(check)
    assert {r["key"]["user_id"] for r in rows.select("key").collect()} == {3}


def test_idle_keys_are_forgotten(spark):
    def run(ttl, pause):
        folder, sink, check = (shared_folder(spark, n) for n in ("files", "sink", "check"))
        for _ in range(2):
            rows = arriving(spark, folder, [(1, 5, "view", None), (1, 5, "view", None), (2, 5, None, None)])
            stream.run_to_end(state.state_ttl(rows, ["user_id", "event_type"], ttl=ttl), sink, check)
            time.sleep(pause)
        return {r["user_id"]: r["n"] for r in spark.read.parquet(sink).groupBy("user_id").agg(F.count("*").alias("n")).collect()}

    with state.rocksdb_state(spark, False):
        assert run("1 hour", 0) == {1: 1, 2: 1}
        assert run("1 second", 3) == {1: 2, 2: 2}
