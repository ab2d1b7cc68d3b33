"""Online features: newest value by key, materialization, push and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.columns import any_timestamp, range_end
from ..storage import exists, names, remove


def newest(df: DataFrame, key: str = "user_id", time: str = "event_timestamp", created: str = "created") -> DataFrame:
    """The newest row by key: (time, created), further ties by the other columns. A map-side combined aggregate."""
    rest = [c for c in df.columns if c not in (key, time, created)]
    best = F.max(F.struct(F.col(time), F.col(created), *rest)).alias("_best")
    return df.groupBy(key).agg(best).select(*(F.col(c) if c == key else F.col(f"_best.{c}").alias(c) for c in df.columns))


def materialize_range(features: DataFrame, start: str, end: str) -> DataFrame:
    """The newest row by user with feature time in [start, end); an end that is a date alone includes that day."""
    t = F.col("event_timestamp")
    return newest(features.filter((t >= any_timestamp(F.lit(start))) & (t < range_end(F.lit(end)))))


def materialize_incremental(features: DataFrame, online: DataFrame, cursor: str, now: str) -> DataFrame:
    """The online table after the rows since the cursor, [cursor, now), are merged into it; the newest wins."""
    t = F.col("event_timestamp")
    fresh = features.filter((t >= any_timestamp(F.lit(cursor))) & (t < any_timestamp(F.lit(now))))
    return upsert(online, fresh)


def upsert(online: DataFrame, batch: DataFrame) -> DataFrame:
    """Online table and batch merged: repeated and reordered batches come to the same table."""
    return newest(online.unionByName(batch.select(*online.columns)))


def online_lookup(online: DataFrame, keys: DataFrame, at: str, ttl: str) -> DataFrame:
    """The latest vector for each asked key; null without one, or with one older than the TTL at the time of asking."""
    fields = [c for c in online.columns if c != "user_id"]
    now = F.to_timestamp(F.lit(at))
    ok = (F.col("event_timestamp") <= now) & (F.col("event_timestamp") >= now - F.expr(f"interval {ttl}"))
    return keys.select("user_id").distinct().join(online, "user_id", "left").select("user_id", *(F.when(ok, F.col(c)).alias(c) for c in fields))


def freshness_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys before, keys after, and keys that were added."""
    added = after.select("user_id").join(before.select("user_id"), "user_id", "left_anti").agg(F.count("*").alias("keys_added"))
    return before.agg(F.count("*").alias("keys_before")).join(after.agg(F.count("*").alias("keys_after"))).join(added)


def offline_feature_upgrade(df: DataFrame | None, template: DataFrame) -> DataFrame:
    """A feature table in the template's columns: missing ones are 0 (features) or null; no table gives an empty one."""
    empty = template.limit(0)
    if df is None:
        return empty
    out = empty.unionByName(df, allowMissingColumns=True).select(*template.columns)
    new = [c for c in template.columns if c not in df.columns]
    return out.na.fill(0, new) if new else out


class PushTarget:
    """Online and offline tables in a folder. Each batch is written under its id, so a batch that comes again replaces itself.

    The online table is dealt to buckets by the hash of the key. A batch rewrites the buckets that it has keys of, as a
    version named by its id, beside the versions before; a bucket's content is its newest version. Once a version is
    finished, all but the two newest of its buckets' versions go: the last one for readers, the one before for a batch
    that comes again. So a push costs what its buckets hold, and the folder stays within twice the table.
    """

    def __init__(self, spark: SparkSession, folder: str, mode: str = "both", buckets: int = 64):
        if mode not in ("online", "offline", "both"):
            raise ValueError(f"unknown push mode {mode}")
        self.spark, self.folder, self.mode, self.buckets = spark, folder, mode, buckets

    def push(self, batch: DataFrame, batch_id: int) -> None:
        if self.mode == "online":
            batch = newest(batch)  # a row a key, before anything is kept
        batch = batch.persist()
        try:
            if self.mode != "online":
                batch.write.mode("overwrite").parquet(f"{self.folder}/offline/batch={batch_id}")
            if self.mode != "offline":
                self._merge(batch, batch_id)
        finally:
            batch.unpersist()

    def _merge(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(self.buckets)).cast("int")
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most `buckets` numbers
        before = self._read(batch_id - 1, set(touched))
        merged = newest(batch) if before is None else upsert(before, batch)
        path = f"{self.folder}/online/version={batch_id}"
        merged.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        at = self._versions(batch_id)
        for b in touched:
            for old in at.get(b, [])[2:]:
                remove(self.spark, f"{self.folder}/online/version={old}/bucket={b}")

    def _versions(self, last_batch: int) -> dict[int, list[int]]:
        """Each bucket's finished versions up to a batch, newest first: names of folders, as many as twice the buckets."""
        out: dict[int, list[int]] = {}
        for version in sorted((int(n.split("=")[1]) for n in names(self.spark, f"{self.folder}/online") if n.startswith("version=")), reverse=True):
            path = f"{self.folder}/online/version={version}"
            if version <= last_batch and exists(self.spark, f"{path}/_SUCCESS"):
                for n in names(self.spark, path):
                    if n.startswith("bucket="):
                        out.setdefault(int(n.split("=")[1]), []).append(version)
        return out

    def _read(self, last_batch: int, buckets: set[int] | None = None) -> DataFrame | None:
        at = self._versions(last_batch)
        paths = [f"{self.folder}/online/version={v[0]}/bucket={b}" for b, v in sorted(at.items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def online(self, last_batch: int) -> DataFrame | None:
        """The table after a batch: the last one pushed, or the one before it."""
        return self._read(last_batch)

    def offline(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/offline").drop("batch")


class Materializer:
    """Incremental materialization whose cursor is saved: each run takes the rows since the last finished one.

    A run's number names both the version of the online table that it writes and its row of cursors; the row is written
    last, so a run that failed is done again from the same cursor.
    """

    def __init__(self, spark: SparkSession, folder: str, start: str):
        self.spark, self.folder, self.start = spark, folder, start
        self.target = PushTarget(spark, folder, "online")

    def cursors(self) -> list[tuple[int, str]]:
        """(run, end of its range), oldest first; one row a run."""
        if not names(self.spark, f"{self.folder}/cursors"):
            return []
        rows = self.spark.read.schema("run int, upto string").json(f"{self.folder}/cursors/run=*").orderBy("run").collect()
        return [(r["run"], r["upto"]) for r in rows]

    def run(self, features: DataFrame, now: str) -> DataFrame | None:
        """Merge the rows with feature time in [cursor, now) and move the cursor; returns the online table."""
        done = self.cursors()
        number, cursor = (done[-1][0] + 1, done[-1][1]) if done else (0, self.start)
        t = F.col("event_timestamp")
        self.target.push(features.filter((t >= any_timestamp(F.lit(cursor))) & (t < any_timestamp(F.lit(now)))), number)
        row = self.spark.createDataFrame([(number, now)], "run int, upto string")
        row.coalesce(1).write.mode("overwrite").json(f"{self.folder}/cursors/run={number}")
        return self.target.online(number)
