"""Custom state: a user's last fifteen minutes at each event, keys that are forgotten when idle, outcomes joined to predictions as they come."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType

from ..functions.columns import bucket

_NAMES = ["user_id", "at", "f_views_15m", "f_carts_15m", "f_purchases_15m", "cents"]
_WINDOW, _MARK, _CELLS = 900_000_000, 16, 32
_PROVIDER, _EMPTY = "spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled"
_RETAINED = "spark.sql.streaming.minBatchesToRetain"


@contextmanager
def rocksdb_state(spark: SparkSession, empty_batches: bool = True):
    """Queries started inside keep their state in RocksDB: on disk, and written key by key. Typed state needs that.

    With `empty_batches` a query also runs without new rows, so that timers fire; a query in processing time, which could
    always do so, would then never end by itself.
    """
    with _settings(spark, {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", _EMPTY: str(empty_batches).lower()}):
        yield


@contextmanager
def short_history(spark: SparkSession, batches: int = 2):
    """Queries started inside keep the state of the last few micro-batches only, so a long run's checkpoint stays small."""
    with _settings(spark, {_RETAINED: str(batches)}):
        yield


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _facts(kinds: list, prices: list) -> tuple[np.ndarray, np.ndarray]:
    """Each event's kind as a number (0: none that counts) and what it spends, in cents."""
    number = {"view": 1, "cart": 2, "purchase": 3}
    spent = [round(p * 100) if k == "purchase" and not pd.isna(p) else 0 for k, p in zip(kinds, prices)]
    return np.array([number.get(k, 0) for k in kinds], "int64"), np.array(spent, "int64")


def _windows(events: list[np.ndarray], users: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """Views, carts, purchases and cents over [t - 15 min, t) of a user, for each user and t that is asked for.

    `events` are users, microseconds, kinds and cents. Both ends of each window are sorted among the events, before those of
    their own time; a window's sum is the difference of two running sums. All users are done at once.
    """
    n = len(users)
    at, of = np.concatenate([times - _WINDOW, times, events[1]]), np.concatenate([users, users, events[0]])
    order = np.lexsort((np.arange(len(at)) >= 2 * n, at, of))
    out = []
    for amounts in (events[2] == 1, events[2] == 2, events[2] == 3, events[3]):
        sums = np.empty(len(at), "int64")
        sums[order] = np.cumsum(np.concatenate([np.zeros(2 * n, "int64"), amounts])[order])
        out.append(sums[n : 2 * n] - sums[:n])
    return out


def window_features(old: tuple[list, list, list], new: tuple[list, list, list]) -> list[tuple]:
    """The four features over [t - 15 min, t) for each new event of one user in order of time; old events count, and so do new ones.

    Events are (microseconds, kinds, prices).
    """
    at = np.array(old[0] + new[0], "int64")
    times = np.array(sorted(new[0]), "int64")
    found = _windows([np.zeros_like(at), at, *_facts(old[1] + new[1], old[2] + new[2])], np.zeros_like(times), times)
    return [(t, v, c, p, cents / 100) for t, v, c, p, cents in zip(times.tolist(), *(x.tolist() for x in found))]


class RecentEvents(StatefulProcessor):
    """The events of a group of users that can still count: what a micro-batch brings lies under the quarter of an hour of
    its newest event, as rows of users, microseconds, kinds and cents. It stays until no row that the watermark admits can see
    that quarter, then a timer removes it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.minutes = handle.getMapState("minutes", "quarter long", "events binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        new = [frame["user"].to_numpy("int64"), frame["at"].to_numpy("int64"), *_facts(frame["event_type"].tolist(), frame["price"].tolist())]
        held = {quarter[0]: np.frombuffer(events[0], "<i8").reshape(4, -1) for quarter, events in self.minutes.iterator()}
        found = _windows([np.concatenate(c) for c in zip(new, *held.values())], new[0], new[1])
        users = [None] * len(frame) if key[0] is None else new[0]
        yield pd.DataFrame(dict(zip(_NAMES, (pd.array(users, "Int64"), new[1], *found))))
        admitted = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [c[(new[2] > 0) & (new[1] + _WINDOW > admitted)] for c in new]
        if len(fresh[0]):
            quarter = int(fresh[1].max()) // _WINDOW
            both = np.hstack([held.get(quarter, np.empty((4, 0), "<i8")), fresh])
            self.minutes.updateValue((quarter,), (both[:, both[1] + _WINDOW > admitted].astype("<i8").tobytes(),))
            self.handle.registerTimer(self.due(quarter))

    @staticmethod
    def due(quarter: int) -> int:
        """The watermark (ms) from which on no row sees a quarter's events."""
        return (quarter + 2) * _WINDOW // 1000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.minutes.removeKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // _WINDOW - 2,))
        return iter(())

    def close(self) -> None:
        pass


def running_user_state(events: DataFrame, groups: int = 251) -> DataFrame:
    """For each event, as it comes, the four features over [t - 15 min, t) from all events of the user that have come.

    `events` has a watermark on row_time, and late rows are right too: a user's state reaches back from the watermark by
    the window, and the watermark lies behind the newest event by the admitted lateness. Results are not taken back when a
    later row would have changed them. Events of one microsecond do not count for each other. Spend is summed in
    cents. State is kept for the users that agree in user_id modulo `groups` (the key's user_id is that remainder), so calls of
    Python and of the state follow groups and micro-batches, not users or events; a group has a micro-batch's rows by `groups`.
    A prime spreads ids that go in steps; it stays as at first for a checkpoint. A timer removes what is out of use, so
    a group without events leaves nothing. Start it under `rocksdb_state`.
    """
    rows = events.select(F.pmod("user_id", F.lit(groups)).alias("user_id"), F.coalesce("user_id", F.lit(0)).alias("user"), "row_time", F.unix_micros("row_time").alias("at"), "event_type", "price")
    kinds = ", ".join(f"{n} long" for n in _NAMES)
    out = rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=RecentEvents(), outputStructType=kinds, outputMode="Append", timeMode="EventTime")
    return out.select("user_id", F.timestamp_micros("at").alias("row_time"), *_NAMES[2:5], (F.col("cents") / 100).alias("total_spend_15m"))


class SeenKeys(StatefulProcessor):
    """Which keys of a group have come and when last, by cells of keys; each is forgotten when it has not come for the time to live."""

    def __init__(self, columns: list[str], ttl_ms: int):
        self.columns, self.ttl_ms = columns, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "cell int", "marks binary, times binary", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, cells = timerValues.getCurrentProcessingTimeInMs(), {}
        for frame in rows:
            new = []
            for mark in map(bytes, frame["seen_mark"]):
                cell = mark[0] % _CELLS
                if cell not in cells:
                    cells[cell] = self._alive(cell, now)
                new.append(mark not in cells[cell])
                cells[cell][mark] = now  # also starts its time anew
            yield frame.loc[new, self.columns]
        for cell, held in cells.items():
            self.seen.updateValue((cell,), (b"".join(held), np.fromiter(held.values(), "<i8").tobytes()))

    def _alive(self, cell: int, now: int) -> dict[bytes, int]:
        marks, times = map(bytes, self.seen.getValue((cell,)) or (b"", b""))
        each = (marks[i : i + _MARK] for i in range(0, len(marks), _MARK))
        return {m: t for m, t in zip(each, np.frombuffer(times, "<i8").tolist()) if t + self.ttl_ms > now}

    def close(self) -> None:
        pass


def state_ttl(events: DataFrame, keys: list[str], ttl: str = "1 hour", groups: int = 256) -> DataFrame:
    """The first row of each key, while the key is remembered: for `ttl` of processing time after it last came.

    Unlike dedup by watermark it drops no late row, and its state is bounded by what comes within `ttl`, whatever the
    rows' times are. A key is known by 128 bits of its SHA-256. Rows are dealt by them to `groups` of 32 cells (as at first,
    for a checkpoint), and a cell is read and written once a micro-batch, so many rows cost no more calls than there are cells;
    a micro-batch of few rows writes the cells of these whole.
    Start it under `rocksdb_state(spark, False)`.
    """
    long = [f.name for f in events.schema if f.dataType == LongType()]  # in pandas a null would make doubles of them
    mark = F.unhex(F.substring(F.sha2(F.to_json(F.struct(*keys)), 256), 1, 2 * _MARK))
    rows = events.withColumn("seen_mark", mark).withColumns({c: F.col(c).cast("string") for c in long}).withColumn("seen_group", bucket(groups, "seen_mark"))
    processor = SeenKeys(events.columns, int(pd.Timedelta(ttl).total_seconds() * 1000))
    out = rows.groupBy("seen_group").transformWithStateInPandas(statefulProcessor=processor, outputStructType=rows.select(*events.columns).schema, outputMode="Append", timeMode="ProcessingTime")
    return out.withColumns({c: F.col(c).cast("long") for c in long})


def stream_prediction_outcome(predictions: DataFrame, purchases: DataFrame, lateness: str = "15 minutes") -> DataFrame:
    """Predictions (prediction_id, user_id, prediction_timestamp) with purchases (user_id, row_time) within the hour after.

    A stream-stream left outer join: the time range and both watermarks bound its state, and a prediction without a
    purchase comes out once the watermark has passed its hour.
    """
    p = predictions.withWatermark("prediction_timestamp", lateness)
    b = purchases.select(F.col("user_id").alias("buyer"), F.col("row_time").alias("bought")).withWatermark("bought", lateness)
    on = F.expr("user_id = buyer and bought >= prediction_timestamp and bought < prediction_timestamp + interval 1 hour")
    return p.join(b, on, "leftOuter").withColumn("target_purchase_1h", F.col("bought").isNotNull().cast("int"))
