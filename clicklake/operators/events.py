"""Staged events: deduplication, parsing, filling; and what deduplication did."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import event_timestamp, first_level
from ..schemas import KEYS



def _survivor_order(df: DataFrame, keys: list[str]) -> list:
    rest = [c for c in ("brand", "category_code", "user_session", "discount_percent") if c in df.columns and c not in keys]
    return [F.desc_nulls_last("price"), *(F.asc_nulls_last(c) for c in rest)]


def dedup_events(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row a key; of several the highest price stays, then the first brand, category, session and discount."""
    keys = keys or KEYS["stg_events"]
    w = Window.partitionBy(*keys).orderBy(*_survivor_order(df, keys))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def stg_events(bronze: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Silver: deduplicated, times parsed, nulls filled, first category level. Rows with unreadable times keep null times."""
    df = dedup_events(bronze, keys)
    df = df.withColumn("event_timestamp", event_timestamp("event_time")).withColumn("date", F.to_date("event_timestamp"))
    df = df.na.fill({"brand": "unknown", "category_code": "unknown.unknown", "discount_percent": 0})
    return df.withColumn("category_level1", first_level("category_code"))


def key_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or KEYS["stg_events"])).agg(F.count("*").alias("n"))


def dedup_effect(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows before, rows after, rows dropped: one pass over the counts of the keys."""
    return key_counts(df, keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"), F.count("*").alias("rows_after"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_dropped"))


def duplicate_rate(df: DataFrame, part: str, keys: list[str] | None = None) -> DataFrame:
    """Rows, duplicates and per cent of duplicates for each part and for all together (part `all`).

    The parts are added up for the total, so the keys are counted once; a key that occurs in two parts is a duplicate
    in neither.
    """
    by_part = df.groupBy(part, *(keys or KEYS["stg_events"])).agg(F.count("*").alias("n")).groupBy(part).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))
    total = by_part.agg(F.sum("rows").alias("rows"), F.sum("duplicates").alias("duplicates")).select(F.lit("all").alias("part"), "rows", "duplicates")
    return by_part.select(F.col(part).cast("string").alias("part"), "rows", "duplicates").unionByName(total).withColumn("duplicate_pct", F.round(100 * F.col("duplicates") / F.col("rows"), 4))


def duplicate_examples(df: DataFrame, k: int = 20, keys: list[str] | None = None) -> DataFrame:
    """The first k keys, in order, that occur more than once, with their number."""
    keys = keys or KEYS["stg_events"]
    return key_counts(df, keys).filter("n > 1").orderBy(*(F.asc_nulls_last(c) for c in keys)).limit(k)
