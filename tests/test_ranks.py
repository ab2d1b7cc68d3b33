"""Exact percentiles by rank, and how their work is dealt out."""

import random

from pyspark.sql import functions as F

from clicklake.operators import audit, training
from clicklake.storage import shared_folder


def test_percentiles_equal_the_built_in_function(spark):
    draw = random.Random(5)
    for values in ([], [None], [7], [1, 2], [3] * 50 + [4], [draw.randrange(-50, 50) for _ in range(301)], [draw.choice([None, 0.5, 2.25, -1.0]) for _ in range(40)]):
        kind = "double" if any(isinstance(v, float) for v in values) else "long"
        df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
        got = audit.exact_percentiles(df, "x", a=0.0, b=0.15, c=0.5, d=0.85, e=1.0).first()
        want = df.agg(*(F.percentile("x", F.lit(p)) for p in (0.0, 0.15, 0.5, 0.85, 1.0))).first()
        assert [None if v is None else round(v, 9) for v in got] == [None if v is None else round(v, 9) for v in want]


def test_no_task_has_all_values(spark):
    rows = spark.range(40_000).selectExpr("id * 7919 % 40009 as x")
    wanted = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        out = shared_folder(spark, "spread")
        audit.ranked_values(rows, "x").withColumn("p", F.spark_partition_id()).write.parquet(out)
        spread = [r["count"] for r in spark.read.parquet(out).groupBy("p").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(spread) == 40_000 and max(spread) < 10_000


def test_delays_of_no_rows_and_nulls(spark):
    df = spark.createDataFrame([(None,), (2,), (5,), (None,)], "lateness_seconds long")
    assert tuple(audit.delay_distribution(df).first()) == (2, 2, 3.5, 5, 3.5)
    assert tuple(audit.delay_distribution(df.limit(0)).first()) == (0, None, None, None, None)


def test_split_keeps_equal_times_together(spark):
    df = spark.createDataFrame([(t,) for t in [1] * 70 + [2] * 15 + [3] * 15], "s long").withColumn("t", F.timestamp_seconds("s"))
    got = {(r["s"], r["split"]): r["n"] for r in training.chronological_split(df, "t").groupBy("s", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(1, "train"): 70, (2, "validation"): 15, (3, "test"): 15}
