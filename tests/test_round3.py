"""Findings of the third round: edges and sizes that the registered queries' small tables do not have."""

import random
import shutil
from datetime import datetime, timedelta

import pytest
from clicklake.operators import features, layout, model
from clicklake.plans.queries import QUERIES
from clicklake.plans import stream_queries  # noqa: F401  registers its queries
from pyspark.sql import functions as F

from .conftest import DATA, TABLES, canonical, run_sql


@pytest.fixture
def agree(spark, tmp_path):
    """A query and its SQL over other events (id, time, user, kind, value): the same rows."""

    def run(name, rows):
        for t in TABLES:
            shutil.copy(f"{DATA}/{t}.parquet", tmp_path)
        made = [(i, at, user, kind, value, '{"k": %d}' % (i % 5 + 1)) for i, (at, user, kind, value) in enumerate(rows)]
        (tmp_path / "events.parquet").unlink()
        spark.createDataFrame(made, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/made")
        spark.read.parquet(f"{tmp_path}/made").coalesce(1).write.parquet(f"{tmp_path}/one")
        next((tmp_path / "one").glob("*.parquet")).rename(tmp_path / "events.parquet")
        query, sql = QUERIES[name]
        got, want = query(spark, str(tmp_path)).toPandas(), run_sql(sql, str(tmp_path))
        assert len(want) and canonical(got) == canonical(want)

    return run


def test_outcome_whose_hour_ends_at_the_watermark(agree):
    day = datetime(2024, 1, 29)
    views = [(day.replace(hour=h, minute=m), user, "view", 1.0) for user, (h, m) in enumerate([(12, 0), (10, 44), (10, 45), (10, 46)])]
    agree("stream_prediction_outcome", views + [(day.replace(hour=13), 9, "purchase", 2.0), (day.replace(hour=11, minute=40), 3, "purchase", 2.0)])


def test_sketches_of_few_values_lose_none(spark):
    events = spark.range(20_000 * 31).select((F.col("id") % 20_000).alias("user_id"), F.col("id").cast("string").alias("user_session"))
    assert features.user_activity_error(events).filter("not within").count() == 0
    many = spark.range(200_000).select(F.lit(1).alias("user_id"), F.col("id").cast("string").alias("user_session"))
    assert features.user_activity_error(many).first()["within"]


def test_hops_of_dense_users_over_midnights(agree):
    draw, start = random.Random(5), datetime(2024, 1, 9, 22)
    kinds = ["view", "click", "purchase", "error"]
    rows = [(start + timedelta(seconds=draw.randrange(4 * 86_400)), None if n % 40 == 0 else n % 3, draw.choice(kinds), draw.choice([None, 0.1, 2.35])) for n in range(900)]
    edges = [(datetime(2024, 1, 10) + timedelta(seconds=s), 7, "purchase", 1.0) for s in (-901, -900, -61, -60, -1, 0, 59, 60)]
    agree("user_features_15m_batch", rows + edges)


@pytest.mark.parametrize("name", ["hopping_features_15m", "stream_batch_parity", "features_topic_sink", "micro_batch_push", "tumbling_features_15m"])
def test_streams_of_several_batches(agree, monkeypatch, name):
    """Bounded micro-batches in order of time: state of earlier ones goes, and no row is late or lost."""
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 60)
    monkeypatch.setattr(stream_queries, "BATCH_FILES", 2)
    draw, start = random.Random(8), datetime(2024, 1, 9, 22)
    kinds = ["view", "click", "purchase", "error"]
    agree(name, [(start + timedelta(seconds=draw.randrange(20_000)), n % 5, draw.choice(kinds), draw.choice([None, 0.1, 2.35])) for n in range(500)])


def test_events_meet_the_versions_of_their_slot_alone(spark):
    n = 3_000
    dim = spark.range(n).select(F.lit(1).alias("product_id"), F.col("id").alias("v"), F.timestamp_seconds(F.col("id") * 7).alias("valid_from_ts"), F.when(F.col("id") < n - 1, F.timestamp_seconds((F.col("id") + 1) * 7)).alias("valid_to_ts"))
    dim = dim.unionByName(dim.limit(1).selectExpr("2 as product_id", "v", "valid_from_ts", "valid_to_ts"))
    events = spark.range(-50, 7 * n + 100).select(F.when(F.col("id") % 11 > 0, 1).otherwise(2).alias("product_id"), F.timestamp_seconds("id").alias("event_timestamp"), "id")
    joined = model.scd2_range_join(events, dim, ["v"])
    own = F.when(F.col("id") >= 0, F.when(F.col("product_id") == 1, F.least(F.floor(F.col("id") / 7), F.lit(n - 1))).when(F.col("id") < 7, 0))
    assert joined.count() == 7 * n + 150 and joined.filter(~F.col("v").eqNullSafe(own)).count() == 0
    assert "_slot" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_compaction_shuffles_nothing(spark, tmp_path):
    spark.range(0, 100_000, 1, 20).withColumn("x", F.rand(1)).write.parquet(f"{tmp_path}/a")
    size = layout.file_layout_report(spark.read.parquet(f"{tmp_path}/a")).agg(F.sum("file_size")).first()[0]
    files = layout.compact_files(spark, f"{tmp_path}/a", f"{tmp_path}/b", size // 4 + 1)
    made = layout.file_layout_report(spark.read.parquet(f"{tmp_path}/b"))
    assert 4 <= files <= 6 and made.count() == files
    assert spark.read.parquet(f"{tmp_path}/b").agg(F.count("*"), F.sum("id")).first()[:] == (100_000, 100_000 * 99_999 // 2)
    assert layout.compact_files(spark, f"{tmp_path}/a", f"{tmp_path}/one") == 1
    # An output file has the rows of a few source files; a shuffle gave each rows of all twenty.
    sources = spark.read.parquet(f"{tmp_path}/b").groupBy("_metadata.file_path").agg(F.count_distinct(F.floor(F.col("id") / 5_000)).alias("n"))
    assert sources.agg(F.max("n")).first()[0] <= 6
