"""A topic kept as files: partitions of records with offsets, appended in segments, read as a stream from any offset."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..storage import names

RECORD = "partition int, offset bigint, timestamp timestamp, key string, value string"


def append(records: DataFrame, topic: str, partitions: int, partition: str = "pmod(xxhash64(key), {n})", order: str = "timestamp") -> int:
    """Append records (key, value, timestamp) as a segment of the topic; returns its number.

    A record goes to the partition that the SQL expression names, {n} their number, and there gets the next offset in
    the given order. The segment's data is written first and its index, a row a partition, last: readers take what is in an index,
    so a segment is there whole or not at all, and one that failed is written over by the next.
    """
    spark = records.sparkSession
    ends = {int(p): n for p, n in ends_of(indexes(spark, topic)).items()}
    number = len(indexes(spark, topic))
    dealt = records.withColumn("partition", F.expr(partition.format(n=partitions)).cast("int"))
    place = Window.partitionBy("partition").orderBy(order, "key", "value")
    start = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in ends.items() for x in p)), F.col("partition")), F.lit(0)) if ends else F.lit(0)
    numbered = dealt.withColumn("offset", (F.row_number().over(place) - 1 + start).cast("bigint"))
    path = f"{topic}/segments/{number:08d}"
    numbered.select("offset", "timestamp", "key", "value", "partition").write.mode("overwrite").partitionBy("partition").parquet(path)
    counts = spark.read.parquet(path).groupBy("partition").agg(F.min("offset").alias("first"), (F.max("offset") + 1).alias("next"))
    counts.coalesce(1).write.mode("overwrite").json(f"{topic}/index/{number:08d}")
    return number


def indexes(spark: SparkSession, topic: str) -> list[dict[int, tuple[int, int]]]:
    """Per finished segment the first and next offset of its partitions."""
    out: list[dict[int, tuple[int, int]]] = []
    for name in names(spark, f"{topic}/index"):
        if "_SUCCESS" in names(spark, f"{topic}/index/{name}"):
            rows = spark.read.schema("partition int, first bigint, next bigint").json(f"{topic}/index/{name}").collect()
            out.append({r["partition"]: (r["first"], r["next"]) for r in rows})
    return out


def ends_of(segments: list[dict[int, tuple[int, int]]]) -> dict[str, int]:
    """The offset after the last one, by partition."""
    out: dict[str, int] = {}
    for segment in segments:
        for partition, (_, following) in segment.items():
            out[str(partition)] = max(out.get(str(partition), 0), following)
    return out


class Range(InputPartition):
    """Offsets [first, next) of one partition."""

    def __init__(self, partition: int, first: int, following: int):
        self.partition, self.first, self.following = partition, first, following


def _files(folder: str) -> tuple:
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class TopicReader(DataSourceStreamReader):
    """Offsets are the positions by partition. A batch has at most `max_per_partition` records of each, if that is set.

    Where a query goes on, Spark asks for the newest offset without saying where it stands; with the option `checkpoint` the
    reader looks it up in the query's own log, and its first batch is bounded too.
    """

    def __init__(self, options: dict):
        self.topic = options["path"]
        self.latest = options.get("starting_offsets", "earliest") == "latest"
        self.most = int(options.get("max_per_partition", 0))
        self.position = (self._saved(options["checkpoint"]) or self.initialOffset()) if options.get("checkpoint") else None

    @staticmethod
    def _saved(checkpoint: str) -> dict[str, int] | None:
        from pyarrow import fs

        store, base = _files(checkpoint)
        found = [f.path for f in store.get_file_info(fs.FileSelector(f"{base}/offsets", allow_not_found=True)) if f.base_name.isdigit()]
        if not found:
            return None
        with store.open_input_stream(max(found, key=lambda p: int(p.rsplit("/", 1)[1]))) as log:
            return json.loads(log.read().decode().strip().split("\n")[-1])

    def _segments(self) -> list[tuple[str, dict[int, tuple[int, int]]]]:
        from pyarrow import fs

        store, base = _files(self.topic)
        out = []
        for folder in sorted(store.get_file_info(fs.FileSelector(f"{base}/index", allow_not_found=True)), key=lambda f: f.path):
            parts = store.get_file_info(fs.FileSelector(folder.path))
            if any(f.base_name == "_SUCCESS" for f in parts):
                rows = {}
                for f in parts:
                    if f.base_name.startswith("part-"):
                        with store.open_input_stream(f.path) as lines:
                            rows |= {r["partition"]: (r["first"], r["next"]) for r in map(json.loads, lines.read().decode().splitlines())}
                out.append((folder.base_name, rows))
        return out

    def initialOffset(self) -> dict:
        ends = ends_of([rows for _, rows in self._segments()])
        self.position = ends if self.latest else dict.fromkeys(ends, 0)
        return self.position

    def latestOffset(self) -> dict:
        ends = ends_of([rows for _, rows in self._segments()])
        if not self.most or self.position is None:
            return ends
        return {p: min(n, self.position.get(p, 0) + self.most) for p, n in ends.items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.position = end
        return [Range(int(p), start.get(p, 0), n) for p, n in sorted(end.items()) if n > start.get(p, 0)]

    def commit(self, end: dict) -> None:
        self.position = end

    def read(self, partition: Range) -> Iterator:
        """The range's records in order of offset, from the segments that have some of it."""
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, base = _files(self.topic)
        for name, rows in self._segments():
            first, following = rows.get(partition.partition, (0, 0))
            if first < partition.following and following > partition.first:
                folder = f"{base}/segments/{name}/partition={partition.partition}"
                files = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("part-")]
                place = ds.field("offset")
                table = ds.dataset(files, filesystem=store, format="parquet").to_table(filter=(place >= partition.first) & (place < partition.following)).sort_by("offset")
                number = pa.array([partition.partition] * table.num_rows, pa.int32())
                kind = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us", "UTC")), ("key", pa.string()), ("value", pa.string())])
                yield from table.add_column(0, "partition", number).select(kind.names).cast(kind).to_batches()


class TopicLog(DataSource):
    """spark.dataSource.register(TopicLog), then spark.readStream.format("topic_log").load(folder)."""

    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> TopicReader:
        return TopicReader(dict(self.options))


def topic_stream(spark: SparkSession, topic: str, checkpoint: str, max_per_partition: int = 0, starting: str = "earliest") -> DataFrame:
    """The topic's records from its first offset, or from the newest as the query starts; one that goes on with `checkpoint` takes up its saved one."""
    spark.dataSource.register(TopicLog)
    options = {"starting_offsets": starting, "max_per_partition": str(max_per_partition), "checkpoint": checkpoint}
    return spark.readStream.format("topic_log").options(**options).load(topic)
