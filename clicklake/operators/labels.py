"""Outcome labels: candidate minutes, right-censoring, and purchases within the hour after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOUR = 3600


def right_censor(rows: DataFrame, day_rows: DataFrame, time: str = "event_timestamp", hours: int = 1) -> DataFrame:
    """Rows whose outcome window has passed: not later than the day's last event less `hours`."""
    last = day_rows.agg(F.max("event_timestamp").alias("_last"))  # one row
    return rows.join(F.broadcast(last), F.col(time) <= F.col("_last") - F.expr(f"interval {int(hours)} hours")).drop("_last")


def active_user_minutes(silver: DataFrame, day: str, next_minute: bool = False) -> DataFrame:
    """Distinct (user, minute) with a view or cart on `day`, censored. The minute is the event's own, or the next."""
    rows = silver.filter(F.col("date") == F.lit(day).cast("date"))
    active = right_censor(rows.filter(F.col("event_type").isin("view", "cart")), rows)
    minute = F.date_trunc("minute", "event_timestamp")
    minute = minute + F.expr("interval 1 minute") if next_minute else minute
    return active.select("user_id", minute.alias("prediction_timestamp")).distinct()


def interval_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, seconds: int = HOUR) -> DataFrame:
    """Left join of (user_id, left_time) to right rows with right_time in [left_time, left_time + seconds), to be aggregated.

    Both sides carry buckets of `seconds`; a left row looks into its bucket and the next, and the range is checked on
    what meets there. So a user's rows meet hour by hour and never all with all. A left row appears once per bucket
    without partner, with nulls, beside its partners; a maximum or a count of partners per left key is exact.
    """
    number = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    l = left.withColumn("_bucket", F.explode(F.array(number(F.col(left_time)), number(F.col(left_time)) + 1)))
    r = right.withColumnRenamed("user_id", "_user").withColumn("_place", number(F.col(right_time)))
    inside = (F.unix_micros(right_time) >= F.unix_micros(left_time)) & (F.unix_micros(right_time) < F.unix_micros(left_time) + seconds * 1_000_000)
    on = (F.col("user_id") == F.col("_user")) & (F.col("_bucket") == F.col("_place")) & inside
    return l.join(r, on, "left").drop("_bucket", "_user", "_place")


def label_max(joined: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    return joined.groupBy(*keys).agg(F.max(F.when(hit, 1).otherwise(0)).alias("target_purchase_1h"))


def user_labels(silver: DataFrame, day: str, next_minute: bool = False) -> DataFrame:
    """(user, minute) of `day` with whether the user purchases within the hour from it."""
    c = active_user_minutes(silver, day, next_minute)
    bought = silver.filter("event_type = 'purchase'").select("user_id", F.col("event_timestamp").alias("_bought"))
    joined = interval_join(c, bought, "prediction_timestamp", "_bought")
    return label_max(joined, ["user_id", "prediction_timestamp"], F.col("_bought").isNotNull()).withColumn("date", F.lit(day).cast("date"))


def latest_date(df: DataFrame, day: str) -> DataFrame:
    """One row: `day` if the table has it, else its latest date."""
    d = F.lit(day).cast("date")
    return df.agg(F.when(F.count_if(F.col("date") == d) > 0, d).otherwise(F.max("date")).alias("date"))


def label_by_prediction_id(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Outcomes joined to persisted predictions by id."""
    return predictions.join(labels, "prediction_id", "left")


def prediction_labels(predictions: DataFrame, events: DataFrame, watermark: str, allowance_minutes: int = 15) -> DataFrame:
    """Outcome per prediction: pending until its hour and the allowance for late events have passed by the watermark.

    A purchase that is known already makes a matured 1; while pending the label is null.
    """
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("event_timestamp").alias("_bought"))
    joined = interval_join(predictions.select("prediction_id", "user_id", "prediction_timestamp"), bought, "prediction_timestamp", "_bought")
    hit = joined.groupBy("prediction_id", "prediction_timestamp").agg(F.max(F.col("_bought").isNotNull().cast("int")).alias("_hit"))
    end = F.col("prediction_timestamp") + F.expr("interval 1 hour")
    matures = end + F.expr(f"interval {int(allowance_minutes)} minutes")
    ripe = matures <= F.to_timestamp(F.lit(watermark))
    return hit.select(
        "prediction_id",
        F.col("prediction_timestamp").alias("label_window_start"),
        end.alias("label_window_end"),
        F.when(ripe, F.col("_hit")).alias("target_purchase_1h"),
        F.when(ripe, "matured").otherwise("pending").alias("label_status"),
        F.when(ripe, matures).alias("label_matured_timestamp"),
    )
