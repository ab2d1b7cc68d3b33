"""State for groups of users and keys: its entries do not follow users, events or keys, and results stay those of each one."""

from datetime import timedelta

from pyspark.sql import functions as F

from clicklake.storage import shared_folder
from clicklake.streaming import features as stream
from clicklake.streaming import state

from .test_state import START, arriving


def entries(spark, name, check):
    return spark.read.format("statestore").option("stateVarName", name).load(check).count()


def test_running_state_is_kept_by_group(spark):
    folder, sink, check = (shared_folder(spark, n) for n in ("files", "sink", "check"))
    rows = [(u, s + u % 7, "view", None) for u in range(600) for s in (0, 300, 1_100)]
    with state.rocksdb_state(spark, False):
        stream.run_to_end(state.running_user_state(stream.event_time_watermark(arriving(spark, folder, rows)), 5), sink, check)
    got = {(r["user_id"], r["row_time"]): r["f_views_15m"] for r in spark.read.parquet(sink).collect()}
    assert got == {(u, START + timedelta(seconds=s + u % 7)): n for u in range(600) for s, n in ((0, 0), (300, 1), (1_100, 1))}
    assert entries(spark, "minutes", check) <= 5  # an entry for each user's minute before: 1,800


def test_seen_keys_are_kept_by_cell(spark):
    folder, sink, check = (shared_folder(spark, n) for n in ("files", "sink", "check"))
    rows = [(2**60 + u if u % 10 else None, u, "view", None) for u in range(800)]
    with state.rocksdb_state(spark, False):
        for part in (rows[:500], rows[300:]):
            stream.run_to_end(state.state_ttl(arriving(spark, folder, part), ["user_id", "row_time"], groups=2), sink, check)
    got = spark.read.parquet(sink).select("user_id", F.unix_seconds("row_time").alias("s")).collect()
    assert sorted((r["s"] - int(START.timestamp()), r["user_id"]) for r in got) == sorted((s, u) for u, s, _, _ in rows)
    assert entries(spark, "seen", check) <= 64  # an entry for each key before: 800
