"""Jobs by layer: read, build, check, write. Counts come from the checks; nothing is computed twice for logging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import features, labels, layout, model, quality
from ..operators.events import stg_events


def paths(root: str) -> dict[str, str]:
    return {name: f"{root}/{layer}/{name}" for layer, names in {"bronze": ["raw_events"], "silver": ["stg_events"], "gold": ["dim_product", "dim_user", "fact_user_events", "feat_user_30d", "user_labels"]}.items() for name in names}


def write_bronze(spark: SparkSession, rows: DataFrame, root: str) -> None:
    """Write, then check what was written before anything reads it."""
    at = paths(root)["raw_events"]
    layout.write_dim(rows, at)
    quality.gate(quality.check_bronze(spark.read.parquet(at)))


def write_silver_and_gold(spark: SparkSession, root: str) -> None:
    at = paths(root)
    layout.write_partitioned(stg_events(spark.read.parquet(at["raw_events"])), at["stg_events"])
    silver = spark.read.parquet(at["stg_events"])
    quality.gate(quality.contract_silver_duplicates(silver))
    layout.write_dim(model.dim_product_scd2(silver), at["dim_product"])
    layout.write_dim(model.dim_user(silver), at["dim_user"])
    products = spark.read.parquet(at["dim_product"])
    quality.gate(quality.contract_scd2(products))
    layout.write_partitioned(model.fact_user_events(silver, products), at["fact_user_events"])
    quality.gate(quality.check_gold(silver, spark.read.parquet(at["fact_user_events"])))


def write_features_and_labels(spark: SparkSession, root: str, day: str, created: str) -> None:
    """Features and labels of one day; other days' partitions stay."""
    at = paths(root)
    silver = spark.read.parquet(at["stg_events"])
    layout.write_partitioned(features.user_features_30d(silver, day, created), at["feat_user_30d"])
    layout.write_partitioned(labels.user_labels(silver, day), at["user_labels"])
    quality.gate(quality.check_features(spark.read.parquet(at["feat_user_30d"])))
    quality.gate(quality.check_labels(spark.read.parquet(at["user_labels"])))
