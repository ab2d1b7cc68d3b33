"""Stream sinks: staging files, messages, console, several at once, and pushes of features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.online import PushTarget
from ..sources.kafka import to_messages
from ..storage import exists

FEATURES = ["user_id", "f_views_15m", "f_carts_15m", "f_purchases_15m", "total_spend_15m", "event_timestamp", "created"]


def stage_events_sink(events: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Append every raw event to JSON files, a batch a minute."""
    return events.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).trigger(processingTime="1 minute")


def features_topic_sink(features: DataFrame, topic: str, checkpoint: str, fmt: str = "kafka", **options: str) -> DataStreamWriter:
    """Features as JSON messages keyed by user, to a Kafka topic, or by another connector to a place named `topic`."""
    name = {"topic": topic} if fmt == "kafka" else {"path": topic}
    return to_messages(features, FEATURES).writeStream.format(fmt).options(**name, **options).option("checkpointLocation", checkpoint)


def console_sink(features: DataFrame) -> DataStreamWriter:
    return features.writeStream.format("console").outputMode("update")


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that reads a batch once and gives it to every sink. Sinks must take a batch twice."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return run


def batch_folder(folder: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A sink that writes a batch under its id: written again, it replaces itself."""
    return lambda batch, batch_id: batch.write.mode("overwrite").format(fmt).save(f"{folder}/batch={batch_id}")


def micro_batch_push(features: DataFrame, target: PushTarget, checkpoint: str) -> DataStreamWriter:
    """Push each micro-batch, every two seconds; positions are committed after the write."""
    return features.writeStream.outputMode("update").foreachBatch(target.push).option("checkpointLocation", checkpoint).trigger(processingTime="2 seconds")


def late_side_output(folder: str, allowed_seconds: int) -> Callable[[DataFrame, int], None]:
    """A sink that writes rows apart that are behind the greatest time of all earlier batches by more than allowed.

    On time and late rows go to `on_time` and `late` under the batch's id, so late ones are counted and not lost. The greatest
    time up to each batch is kept beside them, a row a batch, so a batch that comes again is judged alike. `counts` has both numbers
    of each batch, observed as its rows are written, so no one reads them again to count.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            path = f"{folder}/last/batch={batch_id - 1}"
            seen = spark.read.schema("_last timestamp").parquet(path) if exists(spark, path) else spark.createDataFrame([(None,)], "_last timestamp")
            last = seen.unionByName(batch.select(F.col("row_time").alias("_last"))).agg(F.max("_last").alias("_last"))
            last.coalesce(1).write.mode("overwrite").parquet(f"{folder}/last/batch={batch_id}")
            behind = F.unix_timestamp("_last") - F.unix_timestamp("row_time") > allowed_seconds
            marked = batch.join(F.broadcast(seen)).withColumn("_late", F.coalesce(behind, F.lit(False)))
            seen_rows = Observation(f"late-{batch_id}")
            observed = marked.observe(seen_rows, F.count_if(F.col("_late")).alias("late"), F.count_if(~F.col("_late")).alias("on_time"))
            for name, rows in (("late", observed.filter("_late")), ("on_time", marked.filter("not _late"))):
                rows.drop("_late", "_last").write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
            counts = spark.createDataFrame([(seen_rows.get["late"], seen_rows.get["on_time"])], "late long, on_time long")
            counts.coalesce(1).write.mode("overwrite").parquet(f"{folder}/counts/batch={batch_id}")
        finally:
            batch.unpersist()

    return run
