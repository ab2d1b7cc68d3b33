"""Event topics: JSON messages as typed rows. The connector is a parameter; any frame with a text `value` will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import event_timestamp_prefix
from ..schemas import NEW_COLUMNS

_MESSAGE = "event_time string, event_type string, product_id bigint, category_id bigint, category_code string, brand string, price double, user_id bigint, user_session string, discount_percent int"


def parse_messages(df: DataFrame) -> DataFrame:
    """Messages (value) as events with row_time. Bad JSON, and messages without user or readable time, are dropped."""
    parsed = df.select(F.from_json(F.col("value").cast("string"), _MESSAGE, {"mode": "PERMISSIVE"}).alias("m")).select("m.*")
    return parsed.withColumn("row_time", event_timestamp_prefix("event_time")).filter("user_id is not null and row_time is not null")


def kafka_events_source(spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = None) -> DataFrame:
    """The stream of a topic from its first offset (a checkpoint resumes later); the key only deals messages to partitions."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest")
    return parse_messages((reader.option("maxOffsetsPerTrigger", max_per_trigger) if max_per_trigger else reader).load())


def text_events_source(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """The same from a folder of text files of JSON lines, `max_files` a micro-batch."""
    return parse_messages(spark.readStream.option("maxFilesPerTrigger", max_files).text(folder))


def kafka_records_with_metadata(df: DataFrame) -> DataFrame:
    """Records with partition, offset and broker time beside the parsed event, from spark.read.format("kafka") or alike."""
    m = F.from_json(F.col("value").cast("string"), _MESSAGE, {"mode": "PERMISSIVE"}).alias("m")
    out = df.select("partition", "offset", F.col("timestamp").alias("broker_timestamp"), F.col("key").cast("string").alias("key"), m).select("partition", "offset", "broker_timestamp", "key", "m.*")
    return out.withColumn("event_timestamp", event_timestamp_prefix("event_time"))


def to_messages(events: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows as messages: value is JSON, key the user, so that a user's messages stay in order in one partition."""
    return events.select(F.col("user_id").cast("string").alias("key"), F.to_json(F.struct(*(columns or NEW_COLUMNS))).alias("value"))
