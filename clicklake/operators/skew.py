"""Joins and aggregates on keys of which a few are very hot."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import bucket, money
from ..storage import stored
from .audit import hot_keys


def user_tier_dim(events: DataFrame, hot: DataFrame) -> DataFrame:
    """Distinct users; the hot ones are VIP."""
    users = events.filter("user_id is not null").select("user_id").distinct()
    h = hot.select("user_id", F.lit("VIP").alias("_tier"))
    return users.join(F.broadcast(h), "user_id", "left").select("user_id", F.coalesce("_tier", F.lit("STANDARD")).alias("tier"))


def user_join(events: DataFrame, dim: DataFrame, hint: str | None = None) -> DataFrame:
    """Plain equality join; adaptive execution splits skewed partitions of it."""
    return events.join(dim.hint(hint) if hint else dim, "user_id")


def user_join_salted(events: DataFrame, dim: DataFrame, hot: DataFrame, salts: int, row_key: list[str]) -> DataFrame:
    """Join on (user, salt) for hot users only: their rows are dealt by the hash of the row's own columns.

    `hot` has fewer rows than one over the share that makes a key hot, so it is broadcast; dimension rows of hot users are
    repeated once per salt, all others stay single with salt 0. No row is repeated on the large side.
    """
    mark = F.broadcast(hot.select("user_id", F.lit(True).alias("_hot")))
    e = events.join(mark, "user_id", "left").withColumn("_salt", F.when(F.col("_hot"), bucket(salts, *row_key)).otherwise(0)).drop("_hot")
    d = dim.join(mark, "user_id", "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return e.join(d.withColumn("_salt", F.col("_salt").cast("bigint")), ["user_id", "_salt"]).drop("_salt")


def two_phase_salted_agg(events: DataFrame, salts: int, row_key: list[str]) -> DataFrame:
    """Events and spend by user, first by (user, salt), then by user."""
    part = events.groupBy("user_id", bucket(salts, *row_key).alias("_salt")).agg(F.count("*").alias("n"), F.sum(money("price")).alias("s"))
    return part.groupBy("user_id").agg(F.sum("n").alias("events"), F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("spend"))


def tier_summary(joined: DataFrame) -> DataFrame:
    return joined.groupBy("tier").agg(F.count("*").alias("events"), F.coalesce(F.sum(money("price")), F.lit(0)).cast("double").alias("spend"))


def skew_compare(events: DataFrame, share: float = 0.02, salts: int = 4) -> DataFrame:
    """Join and aggregate three ways (sort-merge, adaptive, salted): a row per way and tier, which must agree."""
    hot = hot_keys(events, "user_id", share)
    dim = user_tier_dim(events, hot)
    ways = {"merge": user_join(events, dim, "merge"), "adaptive": user_join(events, dim), "salted": user_join_salted(events, dim, hot, salts, ["event_time", "product_id", "event_type"])}
    out = None
    for name, joined in ways.items():
        rows = tier_summary(joined).withColumn("way", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def final_plan(df: DataFrame) -> str:
    """The plan that a collected frame ended with, after adaptive execution."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def split_reads(df: DataFrame) -> int:
    """How many shuffle reads of a collected frame's final plan deal a skewed partition to several tasks."""
    return len(re.findall(r"AQEShuffleRead[^\n]*skewed", final_plan(df)))


@contextmanager
def adaptive_skew(spark: SparkSession, enabled: bool, partition_bytes: int, factor: float = 1.5):
    """Inside, a partition of more than `partition_bytes` and `factor` times the median is split in a sort-merge join, or none is."""
    wanted = {
        "spark.sql.adaptive.skewJoin.enabled": str(enabled).lower(),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": str(factor),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def skew_splits(events: DataFrame, share: float = 0.02, salts: int = 4, partition_bytes: int = 512) -> DataFrame:
    """A row per way of joining and tier: events, and whether the way's final plan splits skewed partitions.

    The plain sort-merge join may not, the adaptive one may, and the salted one must do without. Each way is run to its end
    and its summary, two rows, read from the driver; the threshold is a parameter as it goes with the table's size.
    """
    spark = events.sparkSession
    hot = hot_keys(events, "user_id", share)
    # Written first: adaptive execution splits what lies on an exchange of the join's own, not on an aggregate's.
    dim = stored(spark, user_tier_dim(events, hot), "tiers")
    ways = {
        "merge": (False, lambda: user_join(events, dim, "merge")),
        "adaptive": (True, lambda: user_join(events, dim, "merge")),
        "salted": (False, lambda: user_join_salted(events, dim, hot, salts, ["event_time", "product_id", "event_type"])),
    }
    out = []
    for name, (enabled, joined) in ways.items():
        with adaptive_skew(spark, enabled, partition_bytes):
            summary = tier_summary(joined())
            rows = summary.collect()
            out += [(name, r["tier"], r["events"], split_reads(summary) > 0) for r in rows]
    return spark.createDataFrame(out, "way string, tier string, events long, split boolean")
