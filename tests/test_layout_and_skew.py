"""What executed plans show: files that lookups open, and joins that adaptive execution splits."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clicklake.operators import layout, skew
from clicklake.storage import shared_folder, stored


@pytest.fixture(scope="module")
def visits(spark):
    return spark.range(4_000).selectExpr("cast(id * 7919 % 200 as bigint) as user_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as t", "id as x")


def test_lookups_open_few_files_and_find_all(spark, visits):
    root = shared_folder(spark, "layouts")
    layout.write_clustered(visits, f"{root}/both", ["user_id", "t"], 16)
    visits.repartition(16).write.parquet(f"{root}/plain/rows")
    layout.write_statistics(spark, f"{root}/plain", ["user_id", "t"])
    start = datetime(2024, 1, 20)
    wanted = {"user": {"user_id": (7, 7)}, "time": {"t": (start, start + timedelta(days=1))}, "both": {"user_id": (7, 9), "t": (start, start + timedelta(days=9))}, "none": {"user_id": (900, 901)}}
    got = {(r["layout"], r["lookup"]): r for r in layout.lookup_report(spark, {"both": f"{root}/both", "plain": f"{root}/plain"}, wanted).collect()}
    for name, ranges in wanted.items():
        rows = visits
        for key, (low, high) in ranges.items():
            rows = rows.filter(F.col(key).between(F.lit(low), F.lit(high)))
        assert got["both", name]["rows"] == got["plain", name]["rows"] == rows.count()
        found = layout.read_matching(spark, f"{root}/both", **ranges)
        assert found.exceptAll(rows).isEmpty() and rows.exceptAll(found).isEmpty()
    assert got["plain", "user"]["files_read"] == got["plain", "time"]["files_read"] == 16
    assert got["both", "user"]["files_read"] <= 8 and got["both", "time"]["files_read"] <= 8 and got["both", "both"]["files_read"] <= 4
    assert got["both", "user"]["rows_read"] < got["plain", "user"]["rows_read"] == 4_000


def test_the_curve_interleaves_and_takes_nulls(spark):
    df = spark.createDataFrame([(a, b) for a in (None, 1, 2, 3, 4) for b in (1.0, 2.0, 3.0, 4.0)], "a long, b double")
    places = {(r["a"], r["b"]): r["p"] for r in df.withColumn("p", layout.interleaved(df, ["a", "b"], 2)).collect()}
    assert places[None, 1.0] == min(places.values()) and places[4, 4.0] == max(places.values()) == 15
    assert layout.interleaved(df.limit(0), ["a", "b"], 2) is not None


def largest(joined):
    """Rows of the fullest task; the price comes along, so that a partition has a size."""
    return joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("price")).agg(F.max("n")).first()[0]


def test_only_the_adaptive_join_is_split(spark):
    rows = spark.range(0, 20_000, 1, 8).selectExpr("if(id % 3 = 0, 1, id % 500) as user_id", "cast(id as string) as event_time", "id as product_id", "'view' as event_type", "id * 1.37D as price")
    got = {(r["way"], r["tier"]): (r["events"], r["split"]) for r in skew.skew_splits(rows, 0.02, partition_bytes=2 << 10).collect()}
    assert {w for w, _ in got} == {"merge", "adaptive", "salted"}
    assert all(split == (way == "adaptive") for (way, _), (_, split) in got.items())
    assert len({got[w, "VIP"][0] for w in ("merge", "adaptive", "salted")}) == 1
    # The same join without splitting has one task with the hot key's rows.
    users = stored(spark, rows.select("user_id").distinct(), "users")
    with skew.adaptive_skew(spark, False, 2 << 10):
        joined = skew.user_join(rows, users, "merge")
        most = largest(joined)
    assert most > 6_000


def test_a_failed_replacement_leaves_the_old_table(spark):
    path = shared_folder(spark, "table")
    with pytest.raises(FileNotFoundError):
        layout.published(spark, path)
    assert layout.publish(spark.range(5), path) == 0
    old = layout.published(spark, path)
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("stopped")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="stopped"):
        layout.publish(broken, path)
    assert layout.published(spark, path).count() == 5
    assert layout.publish(spark.range(7).withColumn("more", F.lit("x")), path) == 1
    assert layout.published(spark, path).columns == ["id", "more"] and old.count() == 5  # the one before can still be read
    layout.publish(spark.range(2), path)
    assert layout.versions(spark, path) == [1, 2]
