"""Streaming features: watermark, dedup, windows; the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.features import hopping_features
from ..schemas import KEYS

WATERMARK = "15 minutes"


def event_time_watermark(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Rows later than the greatest time seen less `delay` are late; state older than that is dropped, which bounds it."""
    return events.withWatermark("row_time", delay)


def stream_dedup(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The first row of each key; a key is forgotten once the watermark has passed its time by the delay."""
    return events.dropDuplicatesWithinWatermark(keys or KEYS["stg_events"])


def hopping_features_15m(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Deduplicated 15-minute features each minute."""
    return hopping_features(stream_dedup(event_time_watermark(events, delay)), time="row_time")


def tumbling_features_15m(events: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """15-minute features without overlap and without dedup; the short watermark drops late rows."""
    return hopping_features(event_time_watermark(events, delay), time="row_time", slide=None)


def run_to_end(df: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over all there is, then stop: Parquet for append mode, else a table in memory named by `sink`.

    The checkpoint holds the positions read and the state; a run after a crash goes on from the last finished batch.
    """
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.format("parquet").start(sink) if mode == "append" else w.format("memory").queryName(sink).start()
    q.awaitTermination()
    return q


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that stateful operators of a finished query dropped as late."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])
