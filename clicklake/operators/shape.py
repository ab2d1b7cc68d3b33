"""Table scaling and fault shaping: pure functions of rows' keys, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import money, portable_bucket
from ..sources.canonical import DISCOUNTS



def _row() -> tuple:
    """What identifies a source row for hashing."""
    return ("user_id", "event_time", "product_id", "event_type", money("price"))


def replicate_time_shift(df: DataFrame, copies: int, days: int = 30) -> DataFrame:
    """Each row `copies` times, copy r later by r times `days`; adds replica."""
    out = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    t = F.try_to_timestamp("event_time", F.lit("yyyy-MM-dd HH:mm:ss 'UTC'"))
    return out.withColumn("event_time", F.concat(F.date_format(F.timestamp_add("DAY", F.col("replica") * days, t), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))


def remap_users(df: DataFrame, share: int = 30, offset: int = 1_000_000_000) -> DataFrame:
    """`share` per cent of the users of each replica become new users, the same for all their rows."""
    moved = (F.col("replica") > 0) & (portable_bucket(100, "user_id", "replica") < share)
    return df.withColumn("user_id", F.when(moved, F.col("user_id") + F.col("replica") * F.lit(offset)).otherwise(F.col("user_id")))


def jitter_prices(df: DataFrame, pct: int = 5) -> DataFrame:
    """Prices of replicas move by up to `pct` per cent, the same for a product within a replica, in cents."""
    ratio = 1 + (portable_bucket(20_001, "product_id", "replica") - 10_000) / 1_000_000 * pct
    return df.withColumn("price", F.when(F.col("replica") > 0, F.round((F.col("price") * ratio).cast("decimal(20,6)"), 2).cast("double")).otherwise(F.col("price")))


def suffix_sessions(df: DataFrame) -> DataFrame:
    return df.withColumn("user_session", F.when(F.col("replica") > 0, F.concat("user_session", F.lit("-r"), F.col("replica").cast("string"))).otherwise(F.col("user_session")))


def schema_split(df: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """Rows before a date and rows from it on: half-open, so no row is in both; rows without a date are in the first."""
    old = F.coalesce(F.substring("event_time", 1, 10) < day, F.lit(True))
    return df.filter(old), df.filter(~old)


def evolve_schema(df: DataFrame, day: str) -> tuple[DataFrame, DataFrame]:
    """The two file generations: nine columns before the date, ten with a discount from it on."""
    old, new = schema_split(df.drop("discount_percent"), day)
    return old, new.withColumn("discount_percent", F.element_at(F.array(*map(F.lit, DISCOUNTS)), (F.pmod(F.length("event_time") + F.coalesce("product_id", F.lit(0)), F.lit(5)) + 1).cast("int")))


def inject_hot_keys(df: DataFrame, ratio: float, users: list[int]) -> DataFrame:
    """A share of the rows goes to a few users, with sessions that say so."""
    hit = portable_bucket(10_000, *_row()) < int(ratio * 10_000)
    k = portable_bucket(len(users), F.lit("hot"), *_row())
    session = F.concat(F.lit("hot-"), k.cast("string"), F.lit("-"), portable_bucket(100, F.lit("session"), *_row()).cast("string"))
    return df.withColumns({"user_id": F.when(hit, F.element_at(F.array(*map(F.lit, users)), (k + 1).cast("int")).cast("bigint")).otherwise(F.col("user_id")), "user_session": F.when(hit, session).otherwise(F.col("user_session"))})


def drift_column(df: DataFrame, column: str = "price", factor: float = 1.5) -> DataFrame:
    return df.withColumn(column, F.round((F.col(column) * factor).cast("decimal(20,6)"), 2).cast("double"))


def inject_duplicates(df: DataFrame, one_in: int, key: str) -> DataFrame:
    """Rows whose key is divisible by `one_in` a second time, exact copies."""
    return df.withColumn("_copies", F.explode(F.when(F.col(key) % one_in == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copies")


def assign_arrival(df: DataFrame, key: str = "event_id", time: str = "event_timestamp", one_in: int = 20, least: int = 300, spread: int = 301) -> DataFrame:
    """When an event arrives: one in 20 is 5 to 10 minutes late. Order by arrival, delayed after others of the moment."""
    late = F.col(key) % one_in == 0
    delay = F.when(late, least + F.pmod(F.col(key) * 37, F.lit(spread))).otherwise(0).cast("int")
    return df.withColumns({"delay_seconds": delay, "is_delayed": late, "arrival": F.timestamp_add("SECOND", delay, F.col(time))})


def scaling_manifest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row on a shaped table: rows, duplicates, columns, greatest share of a user."""
    one = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicates"))
    users = df.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_user_rows"))
    return one.join(users).withColumn("columns", F.lit(len(df.columns))).withColumn("max_user_ratio", F.round(F.col("max_user_rows") / F.col("rows"), 6))
