"""Upkeep of the product dimension: new events are merged, and only the buckets that they change are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import portable_bucket
from ..storage import names, remove
from .layout import publish, published, versions
from .model import ATTRIBUTES, first_seen, versions_of, winners

KEY = ["product_id", *ATTRIBUTES]


def _merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every tuple of both with its first time; `changed` if it is new or seen earlier. Both are grouped once, not joined."""
    both = old.withColumn("_seen", F.col("valid_from_ts")).withColumn("_old", F.lit(True))
    both = both.unionByName(new, allowMissingColumns=True).groupBy("bucket", *KEY)
    starts = both.agg(F.min("valid_from_ts").alias("valid_from_ts"), F.min("_seen").alias("_seen"), F.count("_old").alias("_old"))
    return starts.withColumn("changed", (F.col("_old") == 0) | ~F.col("valid_from_ts").eqNullSafe(F.col("_seen"))).drop("_seen", "_old")


def merge_products(spark: SparkSession, path: str, silver: DataFrame, buckets: int = 64) -> list[int]:
    """Merge events into the dimension in `path`; returns the buckets of products that were written.

    Kept is every attribute tuple with its first time, the losers among those that start at one instant too, as a later
    event of theirs is no new version. So events may come in any order, late or twice, and the dimension is that of one build
    over all of them. A bucket's rows are read only if the events have products of it, and written only if a tuple is new
    or seen earlier. New files lie beside the old ones and count once the list of buckets' newest folders is published:
    readers, and a merge that dies, leave the old dimension in place. One merge runs at a time; `buckets` stays as at first.
    """
    listed = _listed(spark, path)
    new, starts = first_seen(silver).withColumn("bucket", portable_bucket(buckets, "product_id").cast("int")).persist(), None
    try:
        met = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # `buckets` numbers at most
        old = _folders(spark, path, {b: listed[b] for b in met if b in listed}, new)
        starts = _merged(old, new).persist()
        touched = sorted(r["bucket"] for r in starts.filter("changed").select("bucket").distinct().collect())
        if not touched:
            return []
        number = max([*listed.values(), *(int(n.split("=")[1]) for n in names(spark, f"{path}/rows"))], default=-1) + 1
        rows = starts.filter(F.col("bucket").isin(touched)).drop("changed")
        # By bucket, but a large bucket by several tasks of their advisory size.
        rows.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{path}/rows/merge={number}")
    finally:
        for kept in (new, starts):
            if kept is not None:
                kept.unpersist()
    listed |= dict.fromkeys(touched, number)
    publish(spark.createDataFrame(sorted(listed.items()), "bucket int, merge int").coalesce(1), f"{path}/list")
    _sweep(spark, path)
    return touched


def merged_products(spark: SparkSession, path: str) -> DataFrame:
    """The dimension as the last finished merge left it: rows as `dim_product_scd2` gives them."""
    listed = _listed(spark, path)
    if not listed:
        raise FileNotFoundError(f"no finished merge in {path}")
    return versions_of(winners(_folders(spark, path, listed).drop("bucket")))


def _listed(spark: SparkSession, path: str) -> dict[int, int]:
    """Bucket -> merge that wrote it last."""
    return {r["bucket"]: r["merge"] for r in published(spark, f"{path}/list").collect()} if versions(spark, f"{path}/list") else {}


def _folders(spark: SparkSession, path: str, listed: dict[int, int], like: DataFrame | None = None) -> DataFrame:
    """The rows of some buckets, each from its folder; none gives an empty frame as `like`."""
    if not listed:
        return like.limit(0)
    parts = [f"{path}/rows/merge={merge}/bucket={bucket}" for bucket, merge in sorted(listed.items())]
    rows = spark.read.option("basePath", f"{path}/rows").parquet(*parts).drop("merge")
    return rows.withColumn("bucket", F.col("bucket").cast("int"))


def _sweep(spark: SparkSession, path: str) -> None:
    """Delete folders that neither the newest list nor the one before it names: queries may still read the latter."""
    kept = {tuple(r) for v in versions(spark, f"{path}/list") for r in spark.read.parquet(f"{path}/list/version={v:08d}").collect()}
    for merge in names(spark, f"{path}/rows"):
        folders = [n for n in names(spark, f"{path}/rows/{merge}") if n.startswith("bucket=")]
        number = int(merge.split("=")[1])
        old = [f for f in folders if (int(f.split("=")[1]), number) not in kept]
        if len(old) == len(folders):
            remove(spark, f"{path}/rows/{merge}")
            continue
        for f in old:
            remove(spark, f"{path}/rows/{merge}/{f}")
