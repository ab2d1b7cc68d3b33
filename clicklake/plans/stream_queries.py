"""Registered queries that run a stream over the driver's events to its end and return what it wrote."""

from __future__ import annotations

import math

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import shape
from ..operators.online import PushTarget
from ..schemas import NEW_COLUMNS
from ..sources import kafka, topic_log
from ..sources.canonical import canonical_events, plain, sql, table
from ..storage import put_in_order, shared_folder, stored
from ..streaming import features as stream
from ..streaming import sinks, state
from .queries import F15, HOPS, LABEL_DAY, QUERIES, RAW, features_15m, predictions, query, silver  # noqa: F401


#: Rows a file of messages, and files a micro-batch: what a batch and its state hold does not grow with the events.
FILE_ROWS, BATCH_FILES = 125_000, 8
#: A message after all others: it moves the watermark past every window of the events, and its own windows stay open.
END = '{"event_time":"9999-12-31 00:00:00 UTC","event_type":"end","user_id":0}'


def messages(spark: SparkSession, sf: str, closed: bool = False) -> str:
    """The canonical events as files of JSON messages, in order of time, a range a file; `closed` by a message of the end."""
    folder = shared_folder(spark, "messages")
    files = max(4, math.ceil(table(spark, sf, "events").count() / FILE_ROWS))
    rows = kafka.to_messages(canonical_events(spark, sf).repartitionByRange(files, "event_time").sortWithinPartitions("event_time"), NEW_COLUMNS)
    rows.select("value").write.option("compression", "gzip").text(folder)
    put_in_order(spark, folder)
    if closed:
        spark.createDataFrame([(END,)], "value string").coalesce(1).write.mode("append").text(folder)
    return folder


def source(spark: SparkSession, sf: str, closed: bool = False) -> DataFrame:
    """The messages as a stream, about a million a micro-batch: few events are one batch."""
    return kafka.text_events_source(spark, messages(spark, sf, closed), max_files=BATCH_FILES)


def finished(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Run a stream to its end and read what it wrote: each window once, when the watermark has passed it.

    The windows of a closed source all come out. State is that of a micro-batch and the watermark's delay.
    """
    folder = shared_folder(spark, "sink")
    with state.short_history(spark):
        stream.run_to_end(df, folder, shared_folder(spark, "checkpoint"))
    return spark.read.schema(df.schema).parquet(folder)


@query("hopping_features_15m", HOPS)
def _(spark, sf):
    return finished(spark, stream.hopping_features_15m(source(spark, sf, closed=True)))


TUMBLE = sql("""SELECT user_id, count(*) FILTER (event_type = 'view') AS f_views_15m, count(*) FILTER (event_type = 'cart') AS f_carts_15m, count(*) FILTER (event_type = 'purchase') AS f_purchases_15m,
  coalesce(sum(price::DECIMAL(18,2)) FILTER (event_type = 'purchase'), 0)::DOUBLE AS total_spend_15m, $T(time_bucket(INTERVAL 15 MINUTE, t) + INTERVAL 15 MINUTE) AS event_timestamp, $T(time_bucket(INTERVAL 15 MINUTE, t) + INTERVAL 15 MINUTE) AS created
  FROM (SELECT *, strptime(event_time, '%Y-%m-%d %H:%M:%S UTC') AS t FROM raw WHERE user_id IS NOT NULL) GROUP BY user_id, time_bucket(INTERVAL 15 MINUTE, t)""", "raw")


@query("tumbling_features_15m", TUMBLE)
def _(spark, sf):
    return finished(spark, stream.tumbling_features_15m(source(spark, sf, closed=True)))


@query("stream_dedup", sql("SELECT user_id, event_time, product_id, event_type FROM silver"))
def _(spark, sf):
    rows = stream.stream_dedup(stream.event_time_watermark(source(spark, sf))).select("user_id", "event_time", "product_id", "event_type")
    return finished(spark, rows)


@query("stream_batch_parity", "SELECT 0::BIGINT AS only_stream, 0::BIGINT AS only_batch")
def _(spark, sf):
    """Rows of the stream that the batch lacks and the other way round, repeats counted, from one grouping of both."""
    s = finished(spark, stream.hopping_features_15m(source(spark, sf, closed=True))).drop("created")
    both = s.withColumn("n", F.lit(1)).unionByName(features_15m(spark, sf).drop("created").withColumn("n", F.lit(-1)))
    more = both.groupBy(*s.columns).agg(F.sum("n").alias("n"))
    total = lambda n, name: F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias(name)
    return more.agg(total(F.col("n"), "only_stream"), total(-F.col("n"), "only_batch"))


@query("stage_events_sink", sql("SELECT event_type, count(*) AS n FROM raw WHERE user_id IS NOT NULL GROUP BY 1", "raw"))
def _(spark, sf):
    folder = shared_folder(spark, "staging")
    sinks.stage_events_sink(source(spark, sf), folder, shared_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string").json(folder).groupBy("event_type").agg(F.count("*").alias("n"))


@query("features_topic_sink", sql("""SELECT user_id, f_views_15m, f_purchases_15m, $T(event_timestamp) AS event_timestamp
  FROM features_15m
  WHERE user_id IS NOT NULL AND event_timestamp <= (SELECT max(event_timestamp) - INTERVAL 15 MINUTE
  FROM silver
  WHERE user_id IS NOT NULL)""", "features_15m"))
def _(spark, sf):
    """Features of windows that the watermark has passed, streamed as messages to files in place of a topic."""
    topic = shared_folder(spark, "topic")
    features = stream.hopping_features_15m(source(spark, sf))
    with state.short_history(spark):
        sinks.features_topic_sink(features, topic, shared_folder(spark, "checkpoint"), "json", compression="gzip").trigger(availableNow=True).start().awaitTermination()
    m = spark.read.schema("key string, value string").json(topic)
    f = F.from_json("value", "user_id bigint, f_views_15m bigint, f_purchases_15m bigint, event_timestamp timestamp").alias("f")
    return m.filter(F.col("key").isNotNull()).select(f).select("f.*")


@query("fan_out", sql("SELECT 2 * count(*) AS n FROM raw WHERE user_id IS NOT NULL", "raw"))
def _(spark, sf):
    folder = shared_folder(spark, "fan")
    both = sinks.fan_out(sinks.batch_folder(f"{folder}/a"), sinks.batch_folder(f"{folder}/b", "json"))
    source(spark, sf).writeStream.foreachBatch(both).option("checkpointLocation", shared_folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    a = spark.read.parquet(f"{folder}/a").select("user_id")
    return a.unionAll(spark.read.schema("user_id bigint").json(f"{folder}/b").select("user_id")).agg(F.count("*").alias("n"))


#: Which part of the events arrives when: ten days after ten days, and every seventh row of all with the last.
PART = """CASE WHEN (length(event_time) + coalesce(product_id,
    0)) % 7 = 0 THEN 3 WHEN event_time < '2024-01-11' THEN 0 WHEN event_time < '2024-01-21' THEN 1 ELSE 2 END"""
ARRIVED = f"""(SELECT *, max(t) OVER (ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT *, {PART} AS part, strptime(event_time, '%Y-%m-%d %H:%M:%S UTC') AS t
  FROM raw
  WHERE user_id IS NOT NULL))"""


def in_turns(spark: SparkSession, sf: str, start, bounded: bool = False) -> None:
    """Part after part of the events arrives, and start(stream) runs over what is new, each time on its one checkpoint.

    A part is one micro-batch; `bounded`, it is files in order of time, about a million rows a micro-batch.
    """
    folder = shared_folder(spark, "arriving")
    rows = stored(spark, canonical_events(spark, sf).withColumn("part", F.expr(PART)), "parts") if bounded else canonical_events(spark, sf).withColumn("part", F.expr(PART))
    for part in range(4):
        arrived = rows.filter(F.col("part") == part)
        if bounded:
            files = max(1, math.ceil(arrived.count() / FILE_ROWS))
            arrived = arrived.repartitionByRange(files, "event_time").sortWithinPartitions("event_time")
        kafka.to_messages(arrived, NEW_COLUMNS).select("value").write.mode("append").text(folder)
        if bounded:
            put_in_order(spark, folder)
        start(kafka.text_events_source(spark, folder, max_files=BATCH_FILES if bounded else 1_000))


@query("late_row_metrics", sql(f"""SELECT part::BIGINT AS batch, count_if(late) AS late, count_if(NOT late) AS on_time
  FROM (SELECT part, coalesce(t < seen - INTERVAL 5 MINUTE, false) AS late
  FROM {ARRIVED})
  GROUP BY 1""", "raw"))
def _(spark, sf):
    """Rows behind all that came before their micro-batch: apart and counted, four micro-batches with restarts between."""
    folder, checkpoint = shared_folder(spark, "late"), shared_folder(spark, "checkpoint")
    sink = sinks.late_side_output(folder, 300)
    in_turns(spark, sf, lambda s: s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    sides = [spark.read.schema("user_id bigint, batch bigint").parquet(f"{folder}/{side}").select("batch", F.lit(side).alias("side")) for side in ("late", "on_time")]
    both = sides[0].unionByName(sides[1])
    return both.groupBy("batch").agg(F.count_if(F.col("side") == "late").alias("late"), F.count_if(F.col("side") == "on_time").alias("on_time"))


@query("late_rows_observed", sql(f"""SELECT part::BIGINT AS batch, count_if(late) AS late, count_if(NOT late) AS on_time
  FROM (SELECT part, coalesce(t < seen - INTERVAL 5 MINUTE, false) AS late
  FROM {ARRIVED})
  GROUP BY 1""", "raw"))
def _(spark, sf):
    """The same numbers as the micro-batches' own runs observed them while they wrote."""
    folder, checkpoint = shared_folder(spark, "late"), shared_folder(spark, "checkpoint")
    sink = sinks.late_side_output(folder, 300)
    in_turns(spark, sf, lambda s: s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema("late bigint, on_time bigint, batch bigint").parquet(f"{folder}/counts")


@query("event_time_watermark", sql(f"""SELECT DISTINCT user_id, event_time, product_id, event_type
  FROM {ARRIVED}
  WHERE coalesce(t > seen - INTERVAL 15 MINUTE, true)""", "raw"))
def _(spark, sf):
    """What a stream with a watermark keeps of events that arrive in turns: late ones are dropped, each key comes once."""
    folder, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")
    kept = lambda s: stream.stream_dedup(stream.event_time_watermark(s)).select("user_id", "event_time", "product_id", "event_type")
    in_turns(spark, sf, lambda s: stream.run_to_end(kept(s), folder, checkpoint))
    return spark.read.parquet(folder)


@query("short_watermark", sql(f"""SELECT (SELECT count(*) FROM (SELECT DISTINCT user_id, event_time, product_id, event_type FROM {ARRIVED} WHERE coalesce(t > seen - INTERVAL 2 SECOND, true))) AS kept,
    count(*) AS dropped
  FROM {ARRIVED} WHERE t <= seen - INTERVAL 2 SECOND""", "raw"))
def _(spark, sf):
    """A watermark of two seconds over events that arrive in turns: keys kept, and late rows dropped as the runs' own progress counts them."""
    folder, checkpoint, dropped = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint"), []
    kept = lambda s: stream.stream_dedup(stream.event_time_watermark(s, "2 seconds")).select("user_id", "event_time", "product_id", "event_type")
    in_turns(spark, sf, lambda s: dropped.append(stream.dropped_by_watermark(stream.run_to_end(kept(s), folder, checkpoint))))
    return spark.read.parquet(folder).agg(F.count("*").alias("kept"), F.lit(sum(dropped)).cast("bigint").alias("dropped"))


@query("exactly_once_restart", sql("SELECT event_type, count(*) AS n FROM raw WHERE user_id IS NOT NULL GROUP BY 1", "raw"))
def _(spark, sf):
    """A stream whose second micro-batch fails after its write, started again on its checkpoint: every row once."""
    folder, checkpoint = shared_folder(spark, "once"), shared_folder(spark, "checkpoint")
    write, failed = sinks.batch_folder(folder), []

    def sink(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        if batch_id == 1 and not failed:
            failed.append(batch_id)
            raise RuntimeError("the write is done, its commit is not")

    def start(s: DataFrame) -> None:
        run = lambda: s.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        try:
            run()
        except StreamingQueryException:
            run()

    in_turns(spark, sf, start)
    return spark.read.schema("event_type string").parquet(folder).groupBy("event_type").agg(F.count("*").alias("n"))


@query("earliest_replay", """SELECT (user_id % 5)::INTEGER AS partition, count(*) AS n, 0::BIGINT AS first_offset, count(*) - 1 AS last_offset, count(*) AS offsets, true AS bounded
  FROM events WHERE user_id IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    """A topic of five partitions, appended in two segments: read from its first offset, stopped, taken up at the saved one, until all is read."""
    topic, folder, checkpoint = shared_folder(spark, "topic"), shared_folder(spark, "read"), shared_folder(spark, "checkpoint")
    e = table(spark, sf, "events").filter("user_id is not null")
    records = e.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("timestamp"), F.to_json(F.struct("event_id", "user_id")).alias("value"))
    parts = [records.filter("timestamp < '2024-01-11'"), records.filter("timestamp >= '2024-01-11'")]
    topic_log.append(parts[0], topic, 5, "cast(key as bigint) % {n}")
    most, left = -(-e.count() // 6), True
    while left:
        s = topic_log.topic_stream(spark, topic, checkpoint, most).select("partition", "offset", "key")
        q = s.writeStream.foreachBatch(sinks.batch_folder(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        left = sum(p["numInputRows"] for p in q.recentProgress) > 0
        if parts[1:]:  # the second segment comes while the first is being read
            topic_log.append(parts.pop(), topic, 5, "cast(key as bigint) % {n}")
    rows = spark.read.parquet(folder)
    bounded = rows.groupBy("partition", "batch").count().groupBy("partition").agg((F.max("count") <= most).alias("bounded"))
    return rows.groupBy("partition").agg(F.count("*").alias("n"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count_distinct("offset").alias("offsets")).join(bounded, "partition")


@query("micro_batch_push", QUERIES["push_features"][1])
def _(spark, sf):
    target = PushTarget(spark, shared_folder(spark, "push"), "online")
    w = sinks.micro_batch_push(stream.hopping_features_15m(source(spark, sf)), target, shared_folder(spark, "checkpoint"))
    with state.short_history(spark):
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
    return target.online(q.lastProgress["batchId"]).drop("created")


#: What a watermark of fifteen minutes admits of the events that arrive in turns, each key once.
ADMITTED = f"""(SELECT DISTINCT user_id, event_time, product_id, event_type, part, t
  FROM {ARRIVED}
  WHERE coalesce(t > seen - INTERVAL 15 MINUTE, true))"""


@query("running_user_state", sql(f"""SELECT a.user_id, $T(a.t) AS row_time, count(b.user_id) FILTER (b.event_type = 'view') AS f_views_15m, count(b.user_id) FILTER (b.event_type = 'purchase') AS f_purchases_15m
  FROM (SELECT *, row_number() OVER () AS id FROM {ADMITTED}) a
  LEFT JOIN {ADMITTED} b ON a.user_id = b.user_id AND b.part <= a.part AND b.t >= a.t - INTERVAL 15 MINUTE AND b.t < a.t
  GROUP BY a.id, a.user_id, a.t""", "raw"))
def _(spark, sf):
    """Four parts with restarts and late rows between, each in micro-batches in order of time: each event with what had come until then."""
    folder, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")
    rows = lambda s: state.running_user_state(stream.stream_dedup(stream.event_time_watermark(s)))
    with state.rocksdb_state(spark), state.short_history(spark):
        in_turns(spark, sf, lambda s: stream.run_to_end(rows(s), folder, checkpoint), bounded=True)
    return spark.read.parquet(folder).select("user_id", "row_time", "f_views_15m", "f_purchases_15m")


@query("state_ttl", sql("SELECT DISTINCT user_id, event_time, product_id, event_type FROM raw WHERE user_id IS NOT NULL", "raw"))
def _(spark, sf):
    """Dedup by state that lives an hour after its last use: late rows count, and each key comes once in the four micro-batches."""
    folder, checkpoint = shared_folder(spark, "sink"), shared_folder(spark, "checkpoint")
    keys = ["user_id", "event_time", "product_id", "event_type"]
    with state.rocksdb_state(spark, False):
        in_turns(spark, sf, lambda s: stream.run_to_end(state.state_ttl(s.select(*keys), keys), folder, checkpoint))
    return spark.read.parquet(folder)


@query("stream_prediction_outcome", sql(f"""SELECT p.user_id, $T(p.prediction_timestamp) AS prediction_timestamp, (b.user_id IS NOT NULL)::INTEGER AS target_purchase_1h, count(*) AS n FROM candidates p
  LEFT JOIN (SELECT user_id, strptime(event_time, '%Y-%m-%d %H:%M:%S UTC') AS t FROM raw WHERE event_type = 'purchase' AND user_id IS NOT NULL) b ON b.user_id = p.user_id AND b.t >= p.prediction_timestamp AND b.t < p.prediction_timestamp + INTERVAL 1 HOUR
  WHERE b.user_id IS NOT NULL OR p.prediction_timestamp + INTERVAL 1 HOUR <= (SELECT max(prediction_timestamp) - INTERVAL 15 MINUTE FROM candidates) GROUP BY ALL""", "candidates"))
def _(spark, sf):
    folder = shared_folder(spark, "predictions")
    predictions(spark, sf).write.parquet(folder)
    p = spark.readStream.schema("user_id bigint, prediction_timestamp timestamp, prediction_id string").parquet(folder)
    bought = source(spark, sf).filter("event_type = 'purchase'").select("user_id", "row_time")
    # Outcomes that are known; a prediction without a purchase whose hour's end the watermark has not reached is still open.
    out = finished(spark, state.stream_prediction_outcome(p, bought))
    return out.groupBy("user_id", "prediction_timestamp", "target_purchase_1h").agg(F.count("*").alias("n"))


@query("arrival_order_lateness", "SELECT count(*) AS events, count_if(event_id % 20 = 0) AS delayed FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("event_timestamp"))
    return plain(shape.assign_arrival(e).agg(F.count("*").alias("events"), F.count_if("is_delayed").alias("delayed")))
